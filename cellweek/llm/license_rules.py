"""Signature rules for licence texts over normalised words (lower case, one space between).

Fixed values: names, identifiers and sentences of well-known licences. Rules are built from
each name and the contexts in which a name is written.
"""

# label, keyword that must occur, pattern of the name, whether the bare name is a finding
NAMES = [
    ("mit", "mit", r"mit", False),
    ("mit-0", "mit", r"mit (?:0|no attribution)", True),
    ("apache-1", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version)? (?:1 0|1 1)", True),
    ("apache-2", "apache", r"apache(?: software)?(?: licen[cs]e)?(?: version)? 2(?: 0)?", True),
    ("bsd-0", "bsd", r"(?:0 clause bsd|0bsd|bsd 0 clause)", True),
    ("bsd-2", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", True),
    ("bsd-3", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", True),
    ("bsd-4", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)", True),
    ("isc", "isc", r"isc", False),
    ("gpl", "gnu", r"gnu general public", False),
    ("gpl-1", "gnu", r"gnu general public licen[cs]e(?: version)? 1(?: 0)?", True),
    ("gpl-2", "gnu", r"gnu general public licen[cs]e(?: version)? 2(?: 0)?", True),
    ("gpl-3", "gnu", r"gnu general public licen[cs]e(?: version)? 3(?: 0)?", True),
    ("gpl-2", "gpl", r"gpl ?(?:v|version )?2(?: 0)?(?: only| or later)?", True),
    ("gpl-3", "gpl", r"gpl ?(?:v|version )?3(?: 0)?(?: only| or later)?", True),
    ("gpl-2", "gplv2", r"gplv2", True),
    ("gpl-3", "gplv3", r"gplv3", True),
    ("lgpl", "gnu", r"gnu (?:lesser|library) general public", False),
    ("lgpl-2", "lgpl", r"lgpl ?(?:v|version )?2(?: 0| 1)?(?: only| or later)?", True),
    ("lgpl-3", "lgpl", r"lgpl ?(?:v|version )?3(?: 0)?(?: only| or later)?", True),
    ("lgpl-2", "gnu", r"gnu (?:lesser|library) general public licen[cs]e(?: version)? 2(?: 0| 1)?", True),
    ("lgpl-3", "gnu", r"gnu lesser general public licen[cs]e(?: version)? 3(?: 0)?", True),
    ("agpl-3", "agpl", r"agpl ?(?:v|version )?3(?: 0)?(?: only| or later)?", True),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e(?: version)?(?: 3(?: 0)?)?", True),
    ("mpl-1", "mozilla", r"mozilla public licen[cs]e(?: version)? (?:1 0|1 1)", True),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e(?: version)? 2(?: 0)?", True),
    ("mpl-2", "mpl", r"mpl 2(?: 0)?", True),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e(?: version)?(?: v)? 1(?: 0)?", True),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e(?: version)?(?: v)? 2(?: 0)?", True),
    ("cddl", "common", r"common development and distribution licen[cs]e", True),
    ("eupl", "european", r"european union public licen[cs]e", True),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: version)? 2(?: 0)?", True),
    ("artistic-1", "artistic", r"artistic licen[cs]e(?: version)? 1(?: 0)?", True),
    ("zlib", "zlib", r"zlib(?: libpng)?", False),
    ("boost", "boost", r"boost software(?: licen[cs]e)?(?: version)?(?: 1(?: 0)?)?", True),
    ("python", "python", r"python software foundation", False),
    ("unlicense", "unlicense", r"unlicense", True),
    ("wtfpl", "wtfpl", r"wtfpl", True),
    ("ofl", "sil", r"sil open font licen[cs]e", True),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", True),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", True),
    ("postgresql", "postgresql", r"postgresql", False),
    ("openssl", "openssl", r"openssl", False),
    ("php", "php", r"php(?: licen[cs]e)?(?: version)? 3(?: 0| 01)", True),
    ("odbl", "open", r"open (?:data commons open )?database licen[cs]e", True),
    ("cc0", "cc0", r"cc0(?: 1 0)?", True),
    ("cc0", "creative", r"creative commons (?:zero|cc0)", True),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: \d 0)?", True),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d 0)?", True),
    ("cc-by-nc", "cc", r"cc by nc(?: \d 0)?", True),
    ("cc-by-nd", "cc", r"cc by nd(?: \d 0)?", True),
    ("cc-by-sa", "cc", r"cc by sa(?: \d 0)?", True),
    ("cc-by", "cc", r"cc by(?: \d 0)?", True),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?", True),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike", True),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial", True),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s?", True),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike", True),
    ("cc-by", "creative", r"creative commons attribution", True),
]

# keyword, identifiers of the machine-readable tag
TAGS = [
    "mit", "mit 0", "apache 1 1", "apache 2 0", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd", "isc", "gpl 1 0", "gpl 2 0",
    "gpl 3 0", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "agpl 3 0", "mpl 1 1", "mpl 2 0", "epl 1 0", "epl 2 0", "cddl 1 0", "cddl 1 1",
    "eupl 1 2", "artistic 2 0", "zlib", "bsl 1 0", "python 2 0", "psf 2 0", "unlicense", "wtfpl", "ofl 1 1", "ms pl", "ms rl",
    "postgresql", "openssl", "php 3 01", "odbl 1 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "cc by nc 4 0", "cc by nd 4 0",
    "cc by nc sa 4 0", "cc by nc nd 4 0", "cc by 3 0", "cc by sa 3 0", "cc by nc 3 0", "cc by nd 3 0",
]

# label, keyword, pattern, priority, confidence: sentences and notices
SENTENCES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 4, 0.95),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 4, 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 4, 0.9),
    ("bsd-3", "endorse", r"neither the name of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse", 4, 0.9),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event", 4, 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 5, 0.95),
    ("wtfpl", "want", r"do what the fuck you want to public license", 4, 0.95),
    ("boost", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 5, 0.95),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 4, 0.9),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e", 4, 0.9),
    ("public-domain", "domain", r"(?:in|into|to) the public domain", 3, 0.8),
    ("public-domain", "domain", r"public domain", 2, 0.6),
    ("all-rights-reserved", "reserved", r"all rights reserved", 3, 0.8),
    ("proprietary", "proprietary", r"proprietary and confidential", 3, 0.8),
    ("proprietary", "permission", r"(?:may not be|no part of this [^ ]+ may be) (?:reproduced|copied|distributed) without (?:prior )?(?:written )?permission", 3, 0.8),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", 2, 0.5),
    ("copyright", "copyright", r"copyright c", 1, 0.4),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial use only", 3, 0.7),
    ("research-only", "research", r"for research (?:use|purposes) only", 3, 0.7),
]

_GRANT = (
    r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|dual licen[cs]ed|shared)"
    r" under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
)


def _tag_label(tag: str) -> str:
    words = tag.replace(" clause", "").split()
    if words[0] in ("apache", "bsd", "gpl", "lgpl", "agpl", "mpl", "epl", "artistic") and len(words) > 1:
        return f"{words[0]}-{words[1]}"
    named = {"0bsd": "bsd-0", "bsl": "boost", "psf": "python", "python": "python"}
    return named.get(words[0]) or "-".join(w for w in words if not w[0].isdigit() or words[0] == "mit")


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """id, label, keyword, pattern, priority, confidence of every rule, in order."""
    made = [(_tag_label(t), t.split()[0], f"spdx licen[cs]e identifier {t}(?: only| or later)?", 5, 1.0) for t in TAGS]
    for label, keyword, name, bare in NAMES:
        made.append((label, keyword, f"{_GRANT}{name}(?: licen[cs]e)?", 4, 0.95))
        made.append((label, keyword, f"(?:under|with|see|read) (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e", 4, 0.9))
        made.append((label, keyword, f"{name} licen[cs]e", 3, 0.8))
        made.append((label, keyword, f"licen[cs]e {name}", 3, 0.7))
        if bare:
            made.append((label, keyword, name, 3, 0.7))
    made += SENTENCES
    return [(i, label, keyword, rf"(?<![^ ]){pattern}(?![^ ])", priority, sure) for i, (label, keyword, pattern, priority, sure) in enumerate(made)]
