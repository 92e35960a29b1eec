"""Exact top-k search, spelling variants and treap search against brute force on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellweek.llm import queries, spelling, topk_search, treap_search
from cellweek.llm.common import bounded_groups

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def stored(rows, schema, spark, folder, name):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# Exact top-k search


def brute_topk(rows, k, every, scale=256):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    out = []
    for qi, q in usable:
        if qi % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), i) for i, c in usable if i != qi]
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def vectors():
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 12)]) for i in range(160)]
    sparse = [(200 + i, [float(x) if j % 5 == i % 5 else 0.0 for j, x in enumerate(rng.normal(0, 1, 12))]) for i in range(60)]
    tied = [(300 + i, [0.5, -0.25]) for i in range(40)]
    odd = [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf"), 1.0]), (404, []), (None, [9.0] * 12)]
    twice = [(50, rows[7][1]), (450, rows[8][1]), (450, rows[8][1]), (-50, rows[9][1])]
    return rows + sparse + tied + odd + twice


@pytest.mark.parametrize("block, pack, group", [(8192, 1 << 17, 1 << 23), (7, 40, 300)])
def test_topk_equals_brute_force(spark, monkeypatch, block, pack, group):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    monkeypatch.setattr(topk_search, "PACK_COMPONENTS", pack)
    monkeypatch.setattr(topk_search, "QUERY_BYTES", group)
    rows = vectors()
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = as_rows(topk_search.search(table, F.col("vec_id") % 25 == 0), "query_id", "rank", "vec_id", "score")
    assert got == brute_topk(rows, 5, 25)


def test_topk_query_on_a_stored_table(spark, tmp_path):
    rows = vectors()
    stored([(i, v, 0) for i, v in rows], VECTORS, spark, tmp_path, "embeddings")
    found = queries.op11_topk_search(spark, str(tmp_path))
    assert as_rows(found, "query_id", "rank", "vec_id", "score") == brute_topk(rows, 5, 50)


def test_topk_few_candidates_large_values_and_clashing_names(spark):
    rows = [(0, [3.0e6, -2.0e6]), (1, [1.5e6, 1.0]), (2, [-1.0e6, 4.0e6])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    table = table.select("*", F.lit("x").alias("id"), F.lit(1).alias("asks"), F.lit(2).alias("query_no"), F.lit(0).alias("rank"))
    got = as_rows(topk_search.search(table, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score")
    assert got == sorted((0, r, i, s) for r, (s, i) in enumerate(sorted(((sum(int(256 * a) * int(256 * b) for a, b in zip(rows[0][1], v)), i) for i, v in rows[1:]), reverse=True), 1))


def test_topk_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert topk_search.search(empty, F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 0)], VECTORS)
    assert topk_search.search(alone, F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.search(alone, F.lit(None).cast("boolean")).count() == 0


def test_topk_postings_give_the_inner_products():
    values = [[1.0, 0.0, -2.0], [0.0, 0.0, 3.0], [], [0.5, 0.25, 0.125]]
    queries_ = topk_search.Queries(
        [{"number": np.array([0]).tobytes(), "ids": np.array([9]).tobytes(), "ends": np.array([2]).tobytes(), "terms": np.array([0, 2], np.int32).tobytes(), "vals": np.array([2, -3]).tobytes()}]
    )
    block = topk_search.Block(np.array([4, 3, 2, 1]), pa.array(values, pa.list_(pa.float64())), queries_, 8)
    out, spare = np.empty(4, block.kind), np.empty(4, block.kind)
    block.scores(queries_.terms[0], queries_.values[0], out, spare)
    assert block.ids.tolist() == [1, 2, 3, 4] and out.tolist() == [2 * 4 - 3 * 1, 0, -3 * 24, 2 * 8 + 3 * 16]


# Spelling variants


def brute_variants(rows, least_letters=5, least=3, modulus=97):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least}
    less = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in words}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return a in less[b] or b in less[a]

    around = {w: [v for v in words if abs(len(w) - len(v)) <= 1 and v != w and near(w, v)] for w in words}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), None if form[w] is None else words[form[w]]))
    return sorted(out, key=repr)


def spelled():
    rng = np.random.default_rng(8)
    stems = ["".join(rng.choice(list("abcdeé"), n)) for n in rng.integers(4, 9, 60)]
    words = [*stems]
    for w in stems:
        for _ in range(4):
            i = int(rng.integers(len(w)))
            letter = str(rng.choice(list("abcdxÿÀ")))
            words += [w[:i] + w[i + 1 :], w[:i] + letter + w[i + 1 :], w[:i] + letter + w[i:]]
    weights = rng.zipf(1.4, len(words)).clip(1, 300).astype(float)
    rows = [(i, " ".join(rng.choice(words, 120, p=weights / weights.sum()))) for i in range(40)]
    rows = [(i, t.upper() if i % 7 == 0 else t.replace(" ", ", ") if i % 3 else t) for i, t in rows]
    chain = " ".join(["aaaaa"] * 48 + ["aaaab"] * 24 + ["aaabb"] * 12 + ["aabbb"] * 6 + ["abbbb"] * 3)
    long = "x" * 30_000
    extra = [(100, None), (101, ""), (None, chain), (102, "日本 ×÷ 12 don't Ābcdef"), (103, f"{long} {long}y {long[1:]} " * 3)]
    return rows + extra + [rows[3], rows[3]]


def doc_table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.mark.parametrize("chunk, most, step, held", [(4096, 32 << 20, 1 << 20, 400_000), (8, 64 * 32, 700, 50)])
def test_variants_equal_brute_force(spark, monkeypatch, chunk, most, step, held):
    monkeypatch.setattr(spelling, "CHUNK_BLOCKS", chunk)
    monkeypatch.setattr(spelling, "STEP_EDITS", max(step, 1 << 18))
    monkeypatch.setattr(spelling, "MOST_WORDS", held)
    whole = spelling.filter_ranges
    monkeypatch.setattr(spelling, "filter_ranges", lambda sizes: whole(sizes, most))
    rows = spelled()
    got = as_rows(spelling.variants(doc_table(spark, rows).repartition(4)), "word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(rows)
    assert got == want
    assert sum(f is not None for _, f, *_ in want) > 20 and any(r != f for _, f, r, *_ in want if f)
    assert dict((w, r) for w, _, r, *_ in got)["abbbb"] == "aaaaa"


def test_variants_query_on_a_stored_table(spark, tmp_path):
    rows = spelled()
    stored([(i, t, "en", "s", 0) for i, t in rows], DOCS, spark, tmp_path, "documents")
    got = as_rows(queries.op12_spelling(spark, str(tmp_path)), "word", "form", "root", "n", "n_near", "form_n")
    assert got == brute_variants(rows)


def test_variants_empty_and_clashing_names(spark):
    empty = spelling.variants(spark.createDataFrame([], DOCS))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
    rows = [(1, "house house house house house house horse horse horse")]
    clash = doc_table(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("key", "word", "n", "near", "_salt")])
    assert as_rows(spelling.variants(clash), "word", "form", "root", "n", "n_near", "form_n") == brute_variants(rows)


def test_edit_hashes_are_those_of_the_edited_words():
    alphabet = np.array(sorted(b"abcx"), np.uint8)
    word = b"aabca"
    hashed = lambda w: int(spelling.place_values(np.arange(len(w)), spelling.letters_of([w])).sum(dtype=np.uint64))
    codes = spelling.letters_of([word])
    values = spelling.place_values(np.arange(5), codes)
    _, at, hashes = spelling.deletions(codes, values, np.arange(5))
    assert {int(p): int(h) for p, h in zip(at, hashes)} == {p: hashed(word[:p] + word[p + 1 :]) for p in (0, 2, 3, 4)}
    _, at, letter, hashes = spelling.replacements(codes, values, np.arange(5), alphabet)
    want = {(p, c): hashed(word[:p] + bytes([c]) + word[p + 1 :]) for p in range(5) for c in alphabet.tolist() if c > word[p]}
    assert {(int(p), int(c)): int(h) for p, c, h in zip(at, letter, hashes)} == want


def test_filters_admit_all_words_and_few_others(spark):
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abcdefghij"), 7)) for _ in range(20_000)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    sizes = spelling.filter_sizes(table)
    (spans,) = spelling.filter_ranges(sizes)
    filters = spelling.build_filters(spelling.hashed_words(table, sizes), sizes, spans)
    hashed = lambda ws: spelling.place_values(np.arange(7), spelling.letters_of([w.encode() for w in ws])).sum(axis=1, dtype=np.uint64)
    assert len(spelling.admitted(filters, 7, hashed(words))) == len(words)
    others = ["k" + "".join(rng.choice(list("abcdefghij"), 6)) for _ in range(20_000)]
    assert len(spelling.admitted(filters, 7, hashed(others))) < 40


def test_bounded_groups():
    assert list(bounded_groups([3, 4, 9, 1, 1], lambda x: x, 7)) == [[3, 4], [9], [1, 1]]
    assert list(bounded_groups([], lambda x: x, 7)) == []


# Treap search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))


def brute_ranking(docs, items, k=20):
    held = [(i, Counter(ts), len(ts)) for i, t in docs if (ts := terms_of(t))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, counts, _ in held for t in counts)
    out = []
    for item, text in set(items):
        scored = []
        for i, counts, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = 0
            for t, times in Counter(terms_of(text)).items():
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def ranked_texts():
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.25, n) % 300)
    docs = [(int(i), text(int(n))) for i, n in zip(rng.permutation(400) - 50, rng.integers(1, 90, 400), strict=True)]
    copies = [(1000 + i, docs[5][1]) for i in range(60)]
    odd = [(2000, None), (2001, ""), (2002, "... !"), (None, docs[7][1]), (2003, "Straße ÉTÉ 日本 w1_w2-w3 İ x"), (2004, text(20_000)), (3, docs[9][1]), (3, docs[9][1])]
    items = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 60, 25))]
    items += [(30, docs[5][1]), (31, None), (32, "--"), (33, "nowhere"), (34, "STRASSE straße été ÉTÉ W1"), (None, docs[7][1]), (35, "w1 w1 w1 w2"), (35, "w1 w1 w1 w2"), (36, text(3_000))]
    return docs + copies + odd, items


@pytest.mark.parametrize("block, cells, step, group", [(1 << 14, 1 << 21, 1 << 13, 1 << 22), (37, 500, 64, 400)])
def test_ranking_equals_brute_force(spark, monkeypatch, block, cells, step, group):
    for name, value in (("BLOCK_DOCS", block), ("BLOCK_CELLS", cells), ("STEP_CELLS", step), ("ITEM_BYTES", group)):
        monkeypatch.setattr(treap_search, name, value)
    docs, items = ranked_texts()
    asked = spark.createDataFrame(items, ITEMS)
    got = as_rows(treap_search.search(doc_table(spark, docs).repartition(3), asked), "item_id", "rank", "doc_id", "score")
    assert got == brute_ranking(docs, items)


def test_ranking_query_on_stored_tables(spark, tmp_path):
    docs, items = ranked_texts()
    stored([(i, t, "en", "s", 0) for i, t in docs], DOCS, spark, tmp_path, "documents")
    stored(items, ITEMS, spark, tmp_path, "benchmark")
    found = queries.op13_treap_search(spark, str(tmp_path))
    assert as_rows(found, "item_id", "rank", "doc_id", "score") == brute_ranking(docs, items)


def test_ranking_of_empty_tables_and_clashing_names(spark):
    docs, items = doc_table(spark, [(1, "a b"), (2, "b c"), (4, "d d e f")]), spark.createDataFrame([(7, "a b")], ITEMS)
    assert treap_search.search(docs.limit(0), items).count() == 0
    assert treap_search.search(docs, items.limit(0)).count() == 0
    extra = ("item_no", "n", "terms", "tfs", "score", "rank", "item_id")
    got = treap_search.search(docs.select("*", *[F.lit("x").alias(c) for c in extra]), items.withColumn("terms", F.lit(1)))
    assert as_rows(got, "item_id", "rank", "doc_id", "score") == brute_ranking([(1, "a b"), (2, "b c"), (4, "d d e f")], [(7, "a b")])


def test_treap_quadrants_hold_their_maxima():
    rng = np.random.default_rng(6)
    cells = sorted({(int(r), int(c)) for r, c in rng.integers(0, 50, (300, 2))})
    rows, columns = np.array(cells).T
    impact = rng.integers(1, 1000, len(cells))
    treap = treap_search.Treap(rows, columns, impact, 50, 50)
    grid = np.zeros((64, 64), int)
    grid[rows, columns] = impact
    assert treap.height == 6
    for r, c in [*cells[:40], (63, 63), (0, 49), (49, 0)]:
        node = np.zeros(1, np.int32)
        for level in range(7):
            width = 64 >> level
            y, x = r // width * width, c // width * width
            assert int(treap.value[node[0]]) == grid[y : y + width, x : x + width].max()
            if level < 6:
                shift = 5 - level
                node = treap.child(node, np.array([2 * (r >> shift & 1) + (c >> shift & 1)]))


def test_treap_reads_part_of_the_grid_only(monkeypatch):
    monkeypatch.setattr(treap_search, "STEP_CELLS", 4)
    rng = np.random.default_rng(7)
    rows, columns = np.repeat(np.arange(4), 4096), np.tile(np.arange(4096), 4)
    impact = rng.integers(1, 1000, len(rows))
    impact[columns == 77] += 5000
    treap = treap_search.Treap(rows, columns, impact, 4, 4096)
    seen = []
    plain = treap.child
    treap.child = lambda nodes, quadrants: seen.append(len(nodes)) or plain(nodes, quadrants)
    top = treap_search.Top(1)
    treap.best(np.arange(4), np.ones(4, np.int64), np.arange(4096), top)
    assert top.ids.tolist() == [77] and sum(seen) < 100
