"""Each stage of the pipeline on its predecessor's rows, against plain versions."""

import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import quality, secret_scan

from .test_similar import alike, said

DATA = "/root/testdata/sf0.001"


SECRETS = {
    "password = hunter2secret": True, 'api_key: "abcdef-123456"': True, "AKIA" + "Q7" * 9: True, "0123456789abcdef" * 2: True,
    "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK": True, "token=abc": False, "AKIAQ7": False, "0123456789abcdef": False,
}


def with_secrets(docs):
    """docs with a secret, or what almost is one, within every fourth text."""
    said = F.array(*map(F.lit, SECRETS))
    own = F.element_at(said, (F.pmod(F.col("doc_id"), F.lit(4 * len(SECRETS))) / 4 + 1).cast("int"))
    planted = F.concat_ws(" ", "text", own, F.lit("and so on."))
    rows = docs.withColumn("text", F.when(F.col("text").isNotNull() & (F.col("doc_id") % 4 == 0), planted).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("pipeline"), {}
    docs = with_secrets(spark.read.parquet(f"{DATA}/documents.parquet"))
    out["documents"] = docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(root / name.replace(" ", "_")))
        docs = spark.read.parquet(str(root / name.replace(" ", "_")))
        out[name] = docs.toPandas()
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near-duplicates", "secrets", "mixing", "packing"]
    for n in names[:-1]:
        assert list(stages[n].columns) == list(stages["documents"].columns)


def test_quality(spark, stages):
    docs = spark.createDataFrame(stages["documents"])
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    assert set(stages["quality rules"].doc_id) == kept and 0 < len(kept) < len(stages["documents"])


def test_near_duplicates(stages):
    """Against all pairs: of two texts alike in their 5-word shingles one goes, and none goes that is like no other."""
    text = stages["quality rules"].set_index("doc_id").text.to_dict()
    sets = {i: said(t) for i, t in text.items()}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if alike(sets[a], sets[b])]
    kept = set(stages["near-duplicates"].doc_id)
    assert near and not [p for p in near if set(p) <= kept]
    assert set(text) - {i for p in near for i in p} <= kept and all(min(p) in kept or any(min(p) == b for _, b in near) for p in near)


def redacted(text):
    """The rules as Python's own patterns."""
    name = "|".join(secret_scan.either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
    rules = [(rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24)]
    rules += [(r.pattern, 0, r.min_chars) for r in secret_scan.EXTRA]
    gone = sorted({m.span() for p, g, n in rules for m in re.finditer(p, text) if len(m[g]) >= n})
    out, at = "", 0
    while gone:
        a, b = gone.pop(0)
        while gone and gone[0][0] <= b:
            b = max(b, gone.pop(0)[1])
        out, at = out + text[at:a] + "[redacted]", b
    return out + text[at:]


def test_secrets(stages):
    before, after = stages["near-duplicates"].set_index("doc_id").text, stages["secrets"].set_index("doc_id")
    assert sorted(before.index) == sorted(after.index)
    assert all(after.text[i] == redacted(before[i]) and after.n_chars[i] == len(after.text[i]) for i in before.index)
    for s, real in SECRETS.items():
        held = [i for i in before.index if f" {s} and so on." in before[i]]
        assert held and all((s in after.text[i]) != real for i in held)


def test_mixing(stages):
    before, after = stages["secrets"], stages["mixing"]
    n = Counter(after.doc_id)
    assert set(n) <= set(before.doc_id) and set(n.values()) <= {1, 2}
    size = before.set_index("doc_id").text.map(lambda t: len(t.split()))
    assert abs(sum(size[i] * k for i, k in n.items()) - 1.5 * size.sum()) <= size.sum() * 0.2


def test_packing(stages):
    got = stages["packing"]
    assert set(got.doc_id) == set(stages["mixing"].doc_id)
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and 1 - used.sum() / (2048 * len(used)) < 0.05
    whole = got.drop_duplicates(["doc_id"]).set_index("doc_id").doc_tokens
    assert got.length.sum() == sum(whole[i] for i in stages["mixing"].doc_id)


def test_run_hands_each_stage_the_rows_of_the_one_before(spark):
    got = corpus_pipeline.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert got.columns == docs.columns and got.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0] > 0


def test_odd_rows_and_empty_tables(spark, odd_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, findings string, row long"
    odd = spark.createDataFrame([(i, t, g, s, len(t or ""), 1, "x", 1) for i, t, g, s in odd_rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, DATA)
        rows, none = got.collect(), stage(spark, odd.limit(0), DATA)
        assert none.columns == got.columns and none.count() == 0
        if name != "packing":
            assert got.columns == list(corpus_pipeline.COLUMNS)
            known = {(i, t) for i, t, *_ in odd_rows}
            assert {(r.doc_id, r.text) for r in rows} <= known
        n = Counter((r.doc_id, r.text) for r in rows) if name != "packing" else Counter(r.doc_id for r in rows)
        if name == "secrets":
            assert n == Counter((i, t) for i, t, *_ in odd_rows)
        if name == "near-duplicates":
            assert n[1, None] == 1 and sum(v for (_, t), v in n.items() if not (t or "").strip()) == 1
        if name == "mixing":
            assert not any(not (t or "").split() for _, t in n)
        if name == "packing":
            assert set(n) == {i for i, *_ in odd_rows}
