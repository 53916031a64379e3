"""Repeated byte strings against a plain version that remembers every window; suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest

from strandline.llm import suffixes


def plain(docs, length):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, kept)}; of equal ids the order is that of the operator, so tests have none."""
    seen, out = set(), {}
    for i, text in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = [True] * length
            seen.add(w)
        n = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, text] = (len(raw), sum(gone), n, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def same(spark, rows, length, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, gram string, place long").repartition(3)
    got = suffixes.drop_repeats(df, length=length, **options).collect()
    want = sorted((repr(i), *v) for (i, _), v in ((r, plain(rows, length)[r]) for r in rows))
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in got)


@pytest.mark.parametrize("letters", [2, 3, 300, 10**6])
def test_suffix_array(letters):
    r = np.random.default_rng(letters)
    for n in [*range(0, 40), 200]:
        s = r.integers(1, letters, n) if n % 5 else np.ones(n, np.int64)
        assert suffixes.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def near_copies(r, n):
    words = ["stone", "river", "é", "night", "of", "日本", "the", "a"]
    base = [" ".join(r.choice(words) for _ in range(40)) for _ in range(3)]
    out = []
    for _ in range(n):
        said = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            said[r.randrange(len(said))] = r.choice("xyz é")
        k = r.randrange(len(said))
        out.append("".join(said[k:] + said[:k]) if r.random() < 0.3 else "".join(said))
    return out


@pytest.mark.parametrize("crowded", [3, 5000])
def test_near_copies_and_low_entropy(spark, crowded):
    r = random.Random(crowded)
    texts = near_copies(r, 80) + ["".join(r.choice("ab") for _ in range(150)) for _ in range(40)] + ["a" * 90, "a" * 200, "ab" * 70, "", None, "short"]
    rows = list(enumerate(texts)) + [(2**60, texts[3]), (2**60 + 1, "z" + texts[4]), (None, texts[5])]
    same(spark, rows + rows[:2], 20, core=8, crowded=crowded)


def test_hundred_bytes(spark, odd_rows):
    r = random.Random(1)
    own = [(i, t) for i, t, *_ in odd_rows if i is not None]
    own += [(500 + k, t * 3) for k, t in enumerate(near_copies(r, 30))]
    same(spark, own, 100)


def test_slabs_of_a_long_text(spark, monkeypatch):
    """Windows over a slab's end are found once; here within the driver, since workers read the module afresh."""
    r = random.Random(2)
    text = bytes(r.choices(b"abcdefgh", k=5000))
    text += text[100:4000]
    import pandas as pd

    def runs():
        (frame,) = [pd.concat(suffixes._cores(100, 40)(iter([pd.DataFrame({"id": [1], "h": [2], "text": [text]})])))]
        at = frame["place"].to_numpy()
        begin = at // suffixes.REACH - at // 64 % 64
        return {(int(b) + k, int(c // suffixes.REACH)) for b, c in zip(begin, at, strict=True) for k in range(c % 64 + 1)}

    whole = runs()
    monkeypatch.setattr(suffixes, "SLAB", 1000)
    assert runs() == whole and len(whole) == len(text) - 99


def test_empty_table(spark):
    assert suffixes.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
