"""Every query on tables with extra columns, nulls, repeated rows and no rows; the pipeline stages."""

import hashlib
import math
import warnings
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_fingerprint

import corpus_pipeline
from cellweek.llm import hmm, line_dedup, queries, raking, toxicity

EXTRA = ["_text", "_row", "_gone", "gone", "_mix0", "row", "items", "spans", "key", "score", "weight", "fingerprint", "root", "copy", "range", "c", "n", "word", "term", "label"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"
TABLES = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, vec array<float>",
}


def fixture_rows():
    rng = np.random.default_rng(21)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    body = lambda n: " ".join(words[int(x)] for x in rng.zipf(1.4, n) % 300)
    texts = [None, "", " ", *(body(int(n)) for n in rng.integers(5, 120, 50))]
    texts += [f"{t}\nthe line that all share\n" for t in texts[3:16]]
    texts += [f"{body(30)} zorgs awfulness" for _ in range(20)]
    texts += ['token = "0123456789abcdef0123456789abcdef01" mit license', texts[5], texts[5]]
    item = "If Anna walks 12 km to the old harbour and then Anna rows 3 miles with Bert, how far is that today?"
    texts.append(f"{body(20)} {item} {body(20)}")
    ids = [*range(len(texts) - 2), None, len(texts)]
    documents = [(i, t, "en" if n % 3 else None, f"s{n % 2}", len(t or "")) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    documents += [documents[7], documents[7]]
    labels = [(i, 1, int("zorgs" in (t or ""))) for i, t, *_ in documents if i is not None] + [(3, None, None), (None, 1, 1)]
    vectors = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(120)] + [(500, None), (550, [None] * 8), (600, [float("nan")] * 8)]
    pages = [(1, "u", "<article><p>one</p></article>"), (1, "u", "<article><p>one</p></article>"), (None, None, None), (3, "v", "")]
    return {"documents": documents, "labels": labels, "benchmark": [(1, item), (2, None), (None, texts[9]), (3, "")], "pages": pages, "embeddings": vectors}


def write(spark, folder, rows, extra=()):
    schemas = dict(TABLES)
    names = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").columns
    schemas["embeddings"] = f"{names[0]} long, {names[1]} array<float>"
    for name, schema in schemas.items():
        made = spark.createDataFrame(rows.get(name, []), schema)
        for column in extra:
            if column not in made.columns:
                made = made.withColumn(column, F.lit(1))
        made.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    at = lambda name: str(tmp_path_factory.mktemp(name))
    return write(spark, at("plain"), fixture_rows()), write(spark, at("extra"), fixture_rows(), EXTRA), write(spark, at("none"), {})


def comparable(rows):
    number = lambda v: round(v, 5) if isinstance(v, float) else v
    return Counter(str(sorted((k, str(number(v))) for k, v in r.asDict().items())) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_extra_columns_change_nothing_and_empty_tables_stay_empty(spark, folders, name):
    plain, extra, none = folders
    rows = queries.QUERIES[name](spark, plain).collect()
    assert comparable(rows) == comparable(queries.QUERIES[name](spark, extra).collect())
    assert queries.QUERIES[name](spark, none).count() == 0
    documents = len(fixture_rows()["documents"])
    if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op5", "op7", "op8"):
        assert len(rows) == documents
    if name in ("op2_hmm", "op7_toxicity"):
        assert all(r.held_out is not None for r in rows)


def test_line_dedup_keeps_columns_with_its_own_names(spark, folders, monkeypatch):
    monkeypatch.setattr(line_dedup, "is_small", lambda *a, **k: False)
    docs = spark.read.parquet(f"{folders[1]}/documents.parquet")
    kept = line_dedup.drop_repeated_lines(docs, min_docs=10, min_chars=1)
    assert {(r["_row"], r["_gone"], r["gone"], r["_text"]) for r in kept.collect()} == {(1, 1, 1, 1)}
    assert not kept.where("text LIKE '%line that all share%'").count()


@pytest.mark.parametrize("local", [True, False])
def test_mixing_meets_given_targets(spark, local):
    rng = np.random.default_rng(22)
    rows = [(i, "x " * int(rng.integers(1, 30)), f"s{int(rng.zipf(1.5)) % 3}", str(rng.choice(["en", "de"]))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("_mix0", F.lit(7))
    wanted = {"s0": 1.0, "s1": 2.0, "s2": 1.0, "unseen": 5.0}
    mixed = raking.mix(docs, {"source": F.col("source"), "lang": F.col("lang")}, targets={"source": wanted, "lang": {"en": 3, "de": 1}}, keep=0.1, rounds=40, local=local).collect()
    weight = {(r.source, r.lang): r.weight for r in mixed}
    tokens, total = Counter(), 0
    for _, t, source, lang in rows:
        tokens[source, lang] += len(t.split())
        total += len(t.split())
    for n, part in ((0, {"s0": 0.25, "s1": 0.5, "s2": 0.25}), (1, {"en": 0.75, "de": 0.25})):
        for value, share in part.items():
            assert abs(sum(c * weight.get(k, 0) for k, c in tokens.items() if k[n] == value) / total - share) < 1e-3
    assert {r["_mix0"] for r in mixed} == {7}
    only = raking.mix(docs, {"source": F.col("source")}, targets={"source": {"s1": 1}}, local=local).collect()
    assert {r.source for r in only} == {"s1"}
    for bad in ({"lang": {"en": 1}}, {"source": {"s1": -1.0}}, {"source": {"unseen": 1.0}}):
        with pytest.raises(ValueError):
            raking.mix(docs, {"source": F.col("source")}, targets=bad, local=local).collect()


@pytest.mark.parametrize("local", [True, False])
def test_mixing_goes_on_until_the_shares_meet(spark, local, monkeypatch):
    # Halves with little in common: a sweep moves little between them.
    tokens = {("a", "u"): 5000, ("a", "v"): 300, ("b", "u"): 200, ("b", "v"): 3000}
    cells = raking.materialize(spark.createDataFrame([(*k, n) for k, n in tokens.items()], "x string, y string, tokens long"))
    weights = {"x": {"a": 6, "b": 4}, "y": {"u": 55, "v": 45}}
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        rows = raking.cell_probabilities(cells, ["x", "y"], 0.7, 0.4, 1, local=local, weights=weights).collect()
    mass = lambda f: sum(r.tokens * r.weight for r in rows if f(r)) / 8500
    assert abs(mass(lambda r: r.x == "a") - 0.6) < 1e-5 and abs(mass(lambda r: r.y == "u") - 0.55) < 1e-5
    # Columns that always agree cannot have different shares.
    monkeypatch.setattr(raking, "MOST_ROUNDS", 3)
    cells = raking.materialize(spark.createDataFrame([("a", "u", 10), ("b", "v", 30)], "x string, y string, tokens long"))
    with pytest.warns(UserWarning, match="may not fit together"):
        rows = raking.cell_probabilities(cells, ["x", "y"], 0.7, 0.4, 2, local=local, weights=weights).collect()
    assert {r.y: round(r.tokens * r.weight / 40, 9) for r in rows} == {"u": 0.55, "v": 0.45}


def test_scores_equal_the_sum_over_pairs():
    rng = np.random.default_rng(23)
    machine = toxicity.Machine({}, -0.3, rng.normal(0, 1, 12), rng.normal(0, 0.5, (12, toxicity.FACTORS)))
    rows = [set(), {3}, *({int(x) for x in rng.integers(0, 12, 6)} for _ in range(30))]
    for row, got in zip(rows, machine.scores(rows), strict=True):
        terms = sorted(row)
        margin = machine.bias + sum(machine.weights[i] for i in terms)
        margin += sum(machine.factors[i] @ machine.factors[j] for n, i in enumerate(terms) for j in terms[n + 1 :])
        assert math.isclose(got, 1 / (1 + math.exp(-margin)), rel_tol=1e-9)


def test_factors_learn_what_no_linear_weights_can():
    rows, labels = [[0, 2], [0, 3], [1, 2], [1, 3]] * 150, np.array([1.0, 0, 0, 1] * 150)
    machine = toxicity.fit_machine(rows, labels, {i: i for i in range(4)})
    assert all((s > 0.5) == bool(y) for s, y in zip(machine.scores([set(r) for r in rows[:4]]), labels[:4], strict=True))


def test_pipeline_stages_equal_brute_force(spark, folders, tmp_path):
    folder = folders[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made, seen = docs, [docs.collect()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, made, folder).write.parquet(f"{tmp_path}/{n}")
        made = spark.read.parquet(f"{tmp_path}/{n}")
        seen.append(made.collect())
    start, toxic, lines, near, clean, mixed = seen

    labels = spark.read.parquet(f"{folder}/labels.parquet").where(toxicity.learns(F.col("doc_id")))
    scores = Counter({r: p for r, p in ((tuple(r)[:5], r.predicted) for r in toxicity.score_texts(docs, toxicity.train(docs, labels)).collect())})
    assert Counter(map(tuple, toxic)) == Counter(tuple(r) for r in start if not scores[tuple(r)])
    assert sum("zorgs" in (r.text or "") for r in toxic) == 0 and len(toxic) >= len(start) - 22

    key = lambda line: line.strip(" \t\n\r\x0b\x0c").lower()
    holders = defaultdict(set)
    for place, r in enumerate(toxic):
        for line in (r.text or "").split("\n"):
            holders[key(line)].add(place)
    away = {k for k, v in holders.items() if k and len(v) >= 10}
    stripped = lambda t: "\n".join(x for x in (t or "").split("\n") if key(x) not in away)
    assert away and Counter((r.doc_id, r.text) for r in lines) == Counter((r.doc_id, stripped(r.text)) for r in toxic)
    assert all(r.n_chars == len(r.text) for r in lines)

    # Rows without doc_id stay, whatever they resemble.
    assert [r for r in near if r.doc_id is None] == [r for r in lines if r.doc_id is None]
    rows = [(r, brute_fingerprint(r.text)) for r in lines if r.doc_id is not None]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            group[i] = min(group[j] for j in range(len(rows)) if (rows[i][1] ^ rows[j][1]).bit_count() <= 3)
    kept = [group[next(i for i, (r, _) in enumerate(rows) if r == k)] for k in near if k.doc_id is not None]
    assert sorted(kept) == sorted(set(group)) and len(near) < len(lines)

    assert {r.text for r in near} - {r.text for r in clean} >= {r.text for r in near if "old harbour" in r.text}
    assert all("old harbour" not in r.text for r in clean) and len(clean) >= len(near) - 2

    for r in mixed:
        draw = int(hashlib.md5(f"{raking.SEED}:{r.text if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        assert draw < r.probability <= 1 and r.n_tokens == len(r.text.split())
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and mixed


def test_held_out_share_of_rows_without_id(spark):
    made = spark.createDataFrame([(None,), (1,)], "doc_id long").select(hmm.held_out(F.col("doc_id")).alias("a"), toxicity.learns(F.col("doc_id")).alias("b"))
    assert [tuple(r) for r in made.collect()][0] == (True, True)
