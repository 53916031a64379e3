"""Alignment of two tokenizers against a plain version over sets of ends and all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from strandline.llm import alignment

from .conftest import WORDS


def plain(texts):
    """Per text (ids of A, ids of B, groups, links), by the vocabulary's other file and by comparing all pairs of tokens."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in own]
    byte = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(rest)}
    out = []
    for text in texts:
        ids_a, ids_b = ([], []) if not text else (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text))
        said_a = [bytes(byte[c] for c in t.id_to_token(i)) for i in ids_a]
        pieces = [sp.id_to_piece(i) for i in ids_b]
        said_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        if text and not b"".join(said_a) == b"".join(said_b) == b" " + text.encode():
            ids_a, ids_b, said_a, said_b = [], [], [], []

        def ranges(said):
            at, found = 0, []
            for x in said:
                found.append((at, at + len(x)))
                at += len(x)
            return found

        ra, rb = ranges(said_a), ranges(said_b)
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, start = [], 0
        for end in shared:
            pick = [",".join(str(i) for i, (_, e) in zip(ids, r, strict=True) if start < e <= end) for ids, r in ((ids_a, ra), (ids_b, rb))]
            groups.append("|".join(pick))
            start = end
        links = [(i, j) for i, (s, e) in zip(ids_a, ra, strict=True) for j, (s2, e2) in zip(ids_b, rb, strict=True) if s < e2 and s2 < e]
        out.append((ids_a, ids_b, groups, links))
    docs = Counter(p for *_, links in out for p in set(links))
    top = {}
    for (i, _), n in docs.items():
        top[i] = max(top.get(i, 0), n)
    return [
        (len(a), len(b), len(g), len(p), sum(docs[x] == top[x[0]] for x in p), sum(docs[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, p in out
    ]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    odd = [None, "", " ", "\n\n a  b\t", "<|endoftext|> </s><s>", "<0x41> ▁x", "ﬁn é é", "😀🎉 日本語 text", "a" * 700, " " * 300 + "x", "\x00\x01", "ñandú straße œuvre"]
    return odd + [" ".join(r.choice(WORDS) + r.choice(["", "ing", "'s", "é", "123"]) for _ in range(r.randint(1, 60))) for _ in range(40)] * 2


def test_against_all_pairs(spark, texts, docs_of):
    rows = [(k, t, None, None) for k, t in enumerate(texts)] + [(None, texts[20], None, None), (2**60 + 1, texts[21], None, None)]
    got = {r.doc_id: r for r in alignment.digest(docs_of(rows).repartition(5)).collect()}
    want = plain([t for _, t, *_ in rows])
    for (i, *_), w in zip(rows, want, strict=True):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w
    assert len(got) == len(rows)


def test_groups_of_any_ends():
    """Cuts found by halves are those that both sides have, on ends of all kinds."""
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 40, 400):
        for share in (0.02, 0.3, 0.9):
            ends = np.arange(1, n + 1)
            a, b = (np.append(ends[:-1][r.random(n - 1) < share], n) for _ in range(2))
            got = alignment.leaf_groups(a, b, np.array([[0, len(a), 0, len(b)]]))
            cuts = sorted({0, *np.intersect1d(a, b)[:-1]})
            assert got.tolist() == [[int((a <= c).sum()), int((b <= c).sum())] for c in cuts]


def test_empty_table_and_groups_as_text(spark, docs_of):
    assert alignment.align(docs_of([(1, "x", None, None)]).limit(0)).count() == 0
    (row,) = alignment.align(docs_of([(1, "stone", None, None)])).collect()
    a, b = alignment.tokenizers("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")
    assert row.groups == f"{','.join(map(str, a.ids(' stone')))}|{','.join(map(str, b.ids('stone')))}"
