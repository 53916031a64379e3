"""Ids beyond 2**53 beside null ones, which doubles would round; and joins that must not rest on a reused shuffle."""

import datetime
import random

from strandline.llm import alignment, packing, resampling, spans, suffixes, warc

BIG = [2**53 + 1, 2**60 + 1, 2**62 + 3, -(2**60) - 1]


def test_ids_stay_exact(spark):
    said = "a stone in the river and a light in the night, over the water. Under the house is a small green walk. "
    rows = [(i, f"{said * (k + 1)} {k}") for k, i in enumerate([*BIG, None, None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(map(str, [*BIG, None, None]))
    assert {str(r.doc_id) for r in packing.pack(docs).collect()} == set(want)
    for found in (alignment.align(docs), spans.drop_repeats(docs), suffixes.drop_repeats(docs), resampling.resample(docs, docs)):
        assert sorted(str(r.doc_id) for r in found.collect()) == want


def test_the_first_by_id_stays_beside_null_ids(spark):
    said = " ".join(f"word{k}" for k in range(60)) + "."
    ids = [2**53 + 1, 2**53, None]
    docs = spark.createDataFrame([(i, f"{said} {said}"[: len(said)]) for i in ids], "doc_id long, text string").coalesce(1)
    docs = docs.withColumn("text", docs.text)
    kept = {r.doc_id: r.n_removed for r in suffixes.drop_repeats(docs).collect()}
    assert kept[2**53] == 0 and kept[2**53 + 1] == kept[None] == len(said)
    two = spark.createDataFrame([(i, said + f" Other{k} words {k}. {said}") for k, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    removed = {r.doc_id: r.n_removed for r in spans.drop_repeats(two).collect()}
    assert removed[2**53] < removed[2**53 + 1] == removed[None]


def test_packer_places_as_plain_best_fit():
    """The rule over plain lists: where the least room remains; else a new window; else the fullest goes, its gap filled from the piece if wide."""
    r = random.Random(3)
    length, windows, min_cut = 50, 4, 7
    packer = packing.Packer(length, windows, min_cut, 0)
    open_, out = [], []

    def put(window, doc, start, n):
        window.append((doc, start, n))

    def full(window):
        return sum(n for *_, n in window)

    for doc in range(400):
        total = r.choice([1, 3, 9, 20, 33, 48, 50, 120])
        packer.add((doc, False), b"\0\0\0\0" * total)
        start = 0
        while total - start >= length:
            out.append([(doc, start, length)])
            start += length
        while start < total:
            n = total - start
            fits = [w for w in open_ if full(w) + n <= length]
            if fits:
                window = sorted(fits, key=full, reverse=True)[0]
            elif len(open_) < windows:
                window = []
                open_.append(window)
            else:
                window = sorted(open_, key=full, reverse=True)[0]
                gap = length - full(window)
                if gap >= min_cut:
                    put(window, doc, start, gap)
                    start += gap
                open_.remove(window)
                out.append(window)
                continue
            put(window, doc, start, n)
            start += n
            if full(window) == length:
                open_.remove(window)
                out.append(window)
    got = {}
    for (doc, _), start, ids, _, window, at in packer.out:
        got.setdefault(window, []).append((at, doc, start, len(ids) // 4))
    assert sorted([x[1:] for x in sorted(w)] for w in got.values()) == sorted(out)


def test_revisits_without_a_reused_exchange(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, "http://hot/", start + datetime.timedelta(seconds=k), "response" if k % 100 == 0 else "revisit", 200, {"etag": "x"}, "d", 1) for k in range(6000)]
    schema = "record_id long, url string, capture_ts timestamp, kind string, status int, headers map<string,string>, payload_digest string, payload_length long"
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.record_id: r.response_id for r in warc.resolve(spark.createDataFrame(rows, schema).repartition(7), part_rows=300).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert got == {k: k // 100 * 100 for k in range(6000) if k % 100}
