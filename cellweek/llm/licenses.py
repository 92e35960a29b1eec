"""Licence scan by ordered signature rules, in DataFrame operations only.

One pass counts words and keeps the normalised words of texts with any gate word. Of these,
each text meets only the rules whose keyword it holds. Every match is an interval. An interval
that lies within another one of the same or a higher priority is suppressed; of equal intervals
the rule that comes first in the order of priority and number stays. The labels of what is left
join those of the base phrases, which always stay.

Words are runs of characters other than ASCII punctuation, white space and controls, with A-Z
lower-cased. A null or empty text has no words and no labels; its score is 0. Repeated rows are
scanned each; rows without doc_id are, too. An empty table gives an empty table. Extra columns
are ignored.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellweek.llm.common import ascii_lower, is_small, materialize, text_column
from cellweek.llm.license_rules import rules

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
BASE_SURE = 0.9
# Words without which no rule and no base phrase can match; ASCII letters in either case. The
# tests hold every rule against it.
_GATE_WORDS = [
    "licen", "copyright", "spdx", "reserved", "permission", "redistribut", f"public{BREAK}domain", "proprietary", "unencumbered",
    "warranty", "endorse", "wtfpl", "gpl", "cc0", f"cc{BREAK}by", "gnu", "commons", "clause", "commercial", "research", "mpl", "bsd",
    "apache", f"mit{BREAK}(?:0|no)", "boost", "php", f"(?:released|distributed|available|published|provided|covered|shared){BREAK}under",
]
GATE = "(?i)" + "|".join(_GATE_WORDS)
PRIORITIES = (1, 2, 3, 4, 5)


def rule_table(spark: SparkSession) -> DataFrame:
    """rule, label, keyword, pattern, priority, sure; its size is fixed by the code."""
    names = ["rule", "label", "keyword", "pattern", "priority", "sure"]
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule, strict=True)]) for rule in rules()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _places(words: str, phrase: str) -> tuple[Column, Column, Column]:
    """Count, first word and last word of a phrase in a text of single-spaced words."""
    own = len(phrase.split())
    padded = F.concat(F.lit(" "), F.col(words), F.lit(" "))
    count = F.regexp_count(padded, F.lit(f"(?<= ){phrase}(?= )")).cast("long")
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    before = F.substring_index(padded, f" {phrase} ", 1)
    after = F.substring_index(padded, f" {phrase} ", -1)
    total = spaces(padded) - 1
    first = F.when(count > 0, spaces(before))
    last = F.when(count > 0, total - own - spaces(after))
    return count, first.cast("long"), last.cast("long")


def prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, n_words and the words of gated texts, stored once."""
    body = text_column(text)
    words = F.trim(F.regexp_replace(ascii_lower(body), BREAK, " "))
    return materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.regexp_count(body, F.lit(WORD)).cast("long").alias("n_words"),
            F.when(body.rlike(GATE), words).alias("words"),
        )
    )


def intervals(texts: DataFrame) -> DataFrame:
    """row, rule, label, priority, sure, start, end of every match; texts has row and words."""
    table = rule_table(texts.sparkSession)
    keywords = sorted({r[2] for r in rules()})
    held = F.filter(F.lit(keywords), lambda k: F.contains(F.col("words"), k))
    met = texts.select("row", "words", F.explode(held).alias("keyword")).join(F.broadcast(table), "keyword")
    hits = met.where(F.rlike(F.col("words"), F.col("pattern")))
    found = F.regexp_extract_all("words", F.col("pattern"), F.lit(0))
    gaps = F.split("words", F.col("pattern"))
    pairs = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("own"))
    parts = hits.select("row", "rule", "label", "priority", "sure", F.posexplode(pairs).alias("i", "p")).where("p.own IS NOT NULL")
    order = Window.partitionBy("row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("p.gap") + F.col("p.own")).over(order)
    return parts.select("row", "rule", "label", "priority", "sure", (end - F.col("p.own")).alias("start"), end.alias("end"))


def outermost(found: DataFrame) -> DataFrame:
    """The intervals that no interval of the same or a higher priority contains."""
    order = (
        Window.partitionBy("row")
        .orderBy("start", F.desc("end"), F.desc("priority"), "rule")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for p in PRIORITIES:
        found = found.withColumn(f"_reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order))
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"_reach{p}")) for p in PRIORITIES], F.lit(-1))
    return found.where(reach < F.col("end")).drop(*(f"_reach{p}" for p in PRIORITIES))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, n_found, score."""
    stored = prepared(docs, doc_id, text)
    gated = stored.where("words IS NOT NULL")
    counts = {label: _places("words", phrase) for phrase, label in BASE}
    flat = [c.alias(f"_{label}_{i}") for label, places in counts.items() for i, c in enumerate(places)]
    base = gated.select("row", *flat)
    all_of = lambda i: [F.col(f"`_{label}_{i}`") for _, label in BASE]
    present = F.array_compact(F.array(*[F.when(F.col(f"`_{label}_0`") > 0, F.lit(label)) for _, label in BASE]))
    base = base.select(
        "row",
        sum(all_of(0)).alias("n_base"),
        F.least(*all_of(1)).alias("first_word"),
        F.greatest(*all_of(2)).alias("last_word"),
        present.alias("base"),
    )
    kept = outermost(intervals(gated.select("row", "words")))
    found = kept.groupBy("row").agg(F.collect_set("label").alias("more"), F.count(F.lit(1)).alias("n_found"), F.max("sure").alias("sure"))
    details = materialize(base.join(found, "row", "left"))
    rows = stored.select("row", "doc_id", "n_words")
    joined = rows.join(F.broadcast(details), "row", "left") if is_small(details) else rows.join(details, "row", "left")
    none = F.array().cast("array<string>")
    own, more = F.coalesce("base", none), F.coalesce("more", none)
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    certain = F.when(F.size(own) > 0, BASE_SURE).otherwise(0.0)
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        text_of(own).alias("base_labels"),
        text_of(F.concat(own, more)).alias("labels"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
        F.greatest(certain, F.coalesce("sure", F.lit(0.0))).alias("score"),
    )
