"""Neighbours against brute force: recall, how many vectors are verified, and odd vectors."""

import numpy as np
import pytest

from strandline.llm import neighbours, queries


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(ids, m, q, k=10):
    d = np.sqrt(((m - m[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
    d[ids == q] = np.inf
    return ids[np.lexsort((ids, d))[:k]], np.sort(d)[:k]


def vectors(kind):
    r = np.random.default_rng(1)
    if kind == "random":
        return r.standard_normal((6000, 32))
    centers = r.standard_normal((200, 32)) * 4
    return centers[r.integers(0, 200, 6000)] + r.standard_normal((6000, 32)) * 0.3


def test_one_far_vector_widens_no_other_block(spark):
    m = vectors("clusters")[:3000]
    m[7] = 1e12
    rows = [(int(i), v.tolist()) for i, v in enumerate(m)]
    got = neighbours.answers(table(spark, rows), block_rows=512).toPandas()
    far = got[got.vec_id.isna()].groupby("query_id").verified.sum()
    assert far.median() / len(m) <= 0.2
    ids = np.arange(len(m))
    hit = sum(len(set(brute(ids, m, q)[0]) & set(g.sort_values(["score", "vec_id"]).vec_id[:10])) for q, g in got.dropna(subset=["vec_id"]).groupby("query_id"))
    assert hit >= 0.9 * 300


@pytest.mark.parametrize("kind,most", [("random", 0.15), ("clusters", 0.05)])
def test_recall_and_share_verified(spark, kind, most):
    m = vectors(kind)
    ids = np.arange(len(m))
    got = neighbours.answers(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, m, strict=True)]), block_rows=512).toPandas()
    share = got[got.vec_id.isna()].groupby("query_id").verified.sum().mean() / len(m)
    hit = 0
    for q, g in got.dropna(subset=["vec_id"]).groupby("query_id"):
        best, far = brute(ids, m, q)
        g = g.sort_values(["score", "vec_id"]).head(10)
        hit += len(set(best) & set(g.vec_id))
        assert (g.score.to_numpy() >= far - 1e-9).all() and q not in set(g.vec_id)
    assert got.query_id.nunique() == 60 and hit >= 0.9 * 600 and share <= most


def test_the_query_on_the_given_table(spark):
    data = "/root/testdata/sf0.001"
    df = queries.op8_neighbours(spark, data)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    p = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    ids, m = p.vec_id.to_numpy(), np.stack(p.embedding).astype(float)
    got, hit = df.toPandas(), 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and g[["score", "vec_id"]].apply(tuple, axis=1).is_monotonic_increasing
        assert np.allclose(g.score, np.sqrt(((m[np.searchsorted(ids, g.vec_id)] - m[np.searchsorted(ids, q)]) ** 2).sum(1)))
        hit += len(set(brute(ids, m, q)[0]) & set(g.vec_id))
    assert set(got.query_id) == {i for i in ids if i % 100 == 0} and hit >= 0.9 * len(got)


def test_huge_tiny_and_repeated_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [-1e200, 1.0]), (2, [1.0, 2.0]), (100, [1e-200, 1e-200]), (3, [1e308, -1e308]), (4, [-1e308, 1e308])]
    got = {(r.query_id, r.vec_id): r.score for r in neighbours.nearest(table(spark, rows)).collect()}
    assert {v for q, v in got if q == 0} == {1, 2, 100, 3, 4} and {v for q, v in got if q == 100} == {0, 1, 2, 3, 4}
    assert got[0, 1] == pytest.approx(2e200) and got[0, 2] == pytest.approx(1e200) and got[100, 2] == pytest.approx(5**0.5)
    same = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(7, [1.0, 2.0, 3.0]), (200, [9.0, 9.0, 9.0]), (500, [5.0, 5.0, 5.0])]
    got = neighbours.nearest(table(spark, same)).toPandas()
    first = got[got.query_id == 0].sort_values("rank")
    assert first.vec_id.tolist() == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9] and (first.score == 0).all()
    assert got[got.query_id == 500].sort_values("rank").vec_id.tolist()[:1] == [0] and set(got.query_id) == {0, 100, 200, 500}
