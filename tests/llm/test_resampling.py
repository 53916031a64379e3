"""Importance resampling against a plain version: joined words, zlib's CRC, sums in Python."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np

from strandline.llm import resampling

from .conftest import WORDS


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target):
    bucket = lambda f: crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    total_s, total_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t)))
    out = []
    for i, text in docs:
        n, found = features(text)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * 5 // 100]
    ranks = {}
    for k, r in enumerate(drawn):
        ranks.setdefault(r[0], []).append(k + 1)
    return out, ranks


def test_grams_of_all_lengths_have_zlibs_crc():
    r = random.Random(3)
    texts = [[bytes(r.choices(range(128, 256), k=n)) for n in sizes] for sizes in ([], [1], [5, 1000, 3], [200_000, 2, 127, 128, 129], [1] * 50)]
    who, crc = resampling.gram_crcs(texts, 3)
    want = [(k, crc32(b" ".join(t[i : i + n]))) for n in (1, 2, 3) for k, t in enumerate(texts) for i in range(len(t) - n + 1)]
    assert list(zip(who.tolist(), crc.tolist(), strict=True)) == want
    assert resampling.gram_crcs([], 3)[0].tolist() == []


def test_shift_cancels_any_prefix():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 4095, 1_000_003):
        a, b = r.bytes(33), r.bytes(n)
        assert crc32(a + b) ^ int(resampling.shifted(np.array([crc32(a)], np.uint32), np.array([n]))[0]) == crc32(b)


def test_against_plain_version(spark, odd_rows, docs_of):
    r = random.Random(8)
    rows = [*odd_rows, (2**60 + 1, "Big-ID " * 30, None, None)] + [(1000 + k, " ".join(r.choice(WORDS).title() for _ in range(r.choice([5, 19, 20, 60]))), None, None) for k in range(300)]
    target = ["The river stone, the RIVER stone!", None, "", "light 42 night — straße"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(docs_of(rows).repartition(4), bench).collect()
    want, ranks = plain([(i, t) for i, t, *_ in rows], target)
    assert sorted(map(repr, [(x.doc_id, x.n_features, x.weight, x.score) for x in got])) == sorted(map(repr, [(i, n, w, s) for i, _, n, w, s in want]))
    found = {}
    for x in got:
        if x["rank"] is not None:
            found.setdefault(x.doc_id, []).append(x["rank"])
    assert {i: sorted(v) for i, v in found.items()} == ranks and sum(map(len, found.values())) == sum(n >= 20 for _, n, *_ in want) * 5 // 100


def test_ranks_over_many_parts(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS score")
    got = resampling.ranked(rows, [rows.score.desc(), rows.id], part_rows=50).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and [r.id for r in got] == sorted(range(1000), key=lambda i: (-(i % 7), i))


def test_empty_tables(spark, docs_of):
    none = docs_of([(1, "x", None, None)]).limit(0)
    assert resampling.resample(none, none).count() == 0
