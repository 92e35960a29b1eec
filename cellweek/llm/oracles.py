"""DuckDB twins of the queries that SQL can express."""

from cellweek.llm.decontaminate import MIN_CONSISTENT, MIN_ITEM, MIN_LITERAL, MIN_WINDOWS, UNITS, WINDOW
from cellweek.llm.raking import ALPHA, KEEP, ROUNDS, SEED

_LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), gone AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(gone.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone USING (key) GROUP BY doc_id
"""


def _mix_sources() -> str:
    steps, last = [], "w0"
    for i in range(ROUNDS):
        for column in ("source", "lang", "topic"):
            name = f"w{i}_{column}"
            steps.append(
                f"{name} AS (SELECT c.source, c.lang, c.topic, c.tokens, "
                f"CASE WHEN m.mass > 0 THEN c.w * coalesce(t.share, 0) * n.total / m.mass ELSE 0 END AS w "
                f"FROM {last} c JOIN (SELECT {column}, sum(w * tokens) AS mass FROM {last} GROUP BY 1) m USING ({column}) "
                f"LEFT JOIN t_{column} t USING ({column}) CROSS JOIN n)"
            )
            last = name
    targets = ",\n".join(
        f"t_{c} AS (SELECT {c}, pow(s, {ALPHA}) / sum(pow(s, {ALPHA})) OVER () AS share "
        f"FROM (SELECT {c}, sum(tokens)::DOUBLE AS s FROM w0 GROUP BY 1) WHERE s > 0)"
        for c in ("source", "lang", "topic")
    )
    body = ",\n".join(f"{s.replace(' AS (', ' AS MATERIALIZED (', 1)}" for s in steps)
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
         CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#$%&*!]{{2,}}') THEN 'noisy'
              WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, 1.0::DOUBLE AS w FROM d GROUP BY ALL),
n AS (SELECT sum(tokens)::DOUBLE AS total FROM w0),
{targets},
{body},
s AS (
  SELECT *, coalesce(sum(tokens) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(tokens * w) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {last}
), f AS (
  SELECT coalesce(arg_max(({KEEP} * n.total - capped) / rest, w), 'inf'::DOUBLE) AS factor FROM s CROSS JOIN n
  WHERE rest > 0 AND w * ({KEEP} * n.total - capped) / rest <= 1
), p AS (
  SELECT source, lang, topic, w, CASE WHEN tokens = 0 THEN 1.0 WHEN w > 0 THEN least(1.0, w * factor) ELSE 0.0 END AS probability FROM s CROSS JOIN f
)
SELECT doc_id, n_tokens, round(w, 6) AS weight, round(probability, 6) AS probability
FROM d JOIN p USING (source, lang, topic)
WHERE ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < probability
"""


def _decontaminate() -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    template = f"""list_transform(range(1, len(s) + 1), lambda i: CASE
      WHEN regexp_matches(s[i], '^[0-9]') THEN '<num>'
      WHEN lower(s[i]) IN ({units}) AND i > 1 AND regexp_matches(s[i - 1], '^[0-9]') THEN '<unit>'
      WHEN s[i][1] <> lower(s[i])[1] AND len(s[i]) > 1 AND s[i][2:] = lower(s[i][2:]) THEN '<name>'
      ELSE lower(s[i]) END)"""
    token = r"\p{L}+|\p{Nd}+(?:[.,]\p{Nd}+)*"
    kinds = ", ".join(f"'{k}'" for k in ("<num>", "<name>", "<unit>"))
    return f"""
WITH b0 AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '{token}') AS s FROM benchmark WHERE item_id IS NOT NULL),
b1 AS (SELECT item_id, s, {template} AS f, least(len(s), {WINDOW}) AS size FROM b0 WHERE len(s) > 0),
b2 AS (SELECT *, unnest(range(0, len(s) - size + 1)) AS item_pos FROM b1),
b3 AS (SELECT item_id, item_pos, size, f[item_pos + 1:item_pos + size] AS template, s[item_pos + 1:item_pos + size] AS words FROM b2),
b4 AS (SELECT *, len(list_filter(template, lambda t: t NOT IN ({kinds}))) < least({MIN_LITERAL}, size) AS exact FROM b3),
b AS MATERIALIZED (SELECT DISTINCT item_id, item_pos, size, exact, words,
  CASE WHEN exact THEN list_transform(words, lambda t: lower(t)) ELSE template END AS form FROM b4),
d0 AS (SELECT DISTINCT doc_id, text, regexp_extract_all(coalesce(text, ''), '{token}') AS s FROM documents WHERE doc_id IS NOT NULL),
d1 AS (SELECT doc_id, text, s, {template} AS f FROM d0 WHERE len(s) > 0),
d2 AS (SELECT *, unnest(range(0, len(s) - size + 1)) AS pos FROM d1 JOIN (SELECT DISTINCT size, exact FROM b) k
  ON len(s) >= size AND (size >= {MIN_ITEM} OR len(s) = size)),
d AS (SELECT doc_id, hash(text) AS copy, pos, size, exact, s[pos + 1:pos + size] AS words,
  CASE WHEN exact THEN list_transform(s[pos + 1:pos + size], lambda t: lower(t)) ELSE f[pos + 1:pos + size] END AS form FROM d2),
m AS MATERIALIZED (SELECT doc_id, copy, item_id, pos - item_pos AS diagonal, pos, item_pos, form, d.words AS words, b.words AS item_words
  FROM d JOIN b USING (size, exact, form)),
sizes AS (SELECT item_id, CASE WHEN bool_and(exact) THEN count(DISTINCT item_pos) ELSE count(DISTINCT item_pos) FILTER (WHERE NOT exact) END AS n_item
  FROM b GROUP BY 1),
runs AS (SELECT doc_id, copy, item_id, diagonal, count(DISTINCT item_pos) AS n_windows FROM m GROUP BY ALL),
slots AS (SELECT doc_id, copy, item_id, diagonal, count(*) AS n_slots, count(*) FILTER (WHERE n = 1) AS single FROM (
  SELECT doc_id, copy, item_id, diagonal, form[i] AS kind, item_words[i] AS value, count(DISTINCT words[i]) AS n
  FROM (SELECT *, unnest(range(1, len(form) + 1)) AS i FROM m) WHERE form[i] IN ('<num>', '<name>', '<unit>') GROUP BY ALL) GROUP BY ALL),
judged AS (SELECT r.*, coalesce(n_slots, 0) AS n_slots, coalesce(single / n_slots, 1.0) AS consistent
  FROM runs r JOIN sizes USING (item_id) LEFT JOIN slots USING (doc_id, copy, item_id, diagonal)
  WHERE n_windows >= least({MIN_WINDOWS}, n_item))
SELECT doc_id, item_id, n_windows, n_slots::BIGINT AS n_slots, round(consistent, 6) AS consistent FROM judged WHERE consistent >= {MIN_CONSISTENT}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_slots DESC, consistent DESC) = 1
"""


_TOPK_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS parts FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.parts, c.parts) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER s AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW s AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER s <= 5
"""

_SPELLING = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1
    THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), runs AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS bytes FROM found GROUP BY id, run),
coded AS (
  SELECT run, c, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, length(bytes), 2),
    lambda i: ('0x' || substr(bytes, i + 1, 2))::BIGINT)),
    lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc_table
), counted AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
              ELSE run END AS word, c FROM coded
), v AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM counted WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), less AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM v)
), pairs AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM v)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM v)
), around AS (
  SELECT p.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, encode(o.word)) AS best, max(o.n) AS best_n
  FROM pairs p JOIN v o ON o.word = p.other GROUP BY p.word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form,
         CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
  FROM v LEFT JOIN around USING (word)
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

_TREAP_SEARCH = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), total AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d WHERE len(terms) > 0),
q AS (
  SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (SELECT item_id, text, term, count(*) AS times FROM q GROUP BY ALL),
tf AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf CROSS JOIN total GROUP BY term, docs
), sized AS (
  SELECT row, doc_id, 100 - 25 + (25 * len(terms) * docs) // all_terms AS m FROM d CROSS JOIN total WHERE len(terms) > 0
), scored AS (
  SELECT item_id, text, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sized USING (row) GROUP BY item_id, text, row, doc_id
)
SELECT item_id, CAST(row_number() OVER s AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW s AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER s <= 20
"""


ORACLES: dict[str, str] = {
    "op4_line_dedup": _LINE_DEDUP,
    "op6_mix_sources": _mix_sources(),
    "op9_decontaminate": _decontaminate(),
    "op11_topk_search": _TOPK_SEARCH,
    "op12_spelling": _SPELLING,
    "op13_treap_search": _TREAP_SEARCH,
}
