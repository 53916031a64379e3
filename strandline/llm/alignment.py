"""Two tokenizers side by side: the smallest groups of their tokens that cover the same bytes, found by divide and conquer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_batches

#: Bytes of text whose tokens are aligned at a time; a longer text is aligned alone.
TOGETHER = 1_000_000
#: An id pair as one number: id of A * IDS + id of B.
IDS = 1 << 20


class Byte:
    """The byte-level tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for said, i in ranks.items():
            self.bytes[i] = said

    def ids(self, text: str) -> list[int]:
        return self.plain.encode_ordinary(text)


class Pieces:
    """The sentence-piece tokenizer, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        said = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(said)]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


@cache
def tokenizers(a: str, b: str) -> tuple[Byte, Pieces]:
    """a, b: paths, or names of public tokenizers that every machine has."""
    import public_tokenizers

    at = [x if os.path.isabs(x) else public_tokenizers.path(x) for x in (a, b)]
    return Byte(at[0]), Pieces(at[1])


def leaf_groups(ends_a: np.ndarray, ends_b: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Starts (a, b) of all groups, in order. spans: rows (a0, a1, b0, b1) of token ranges that cover the same bytes.

    All intervals of a level are cut at once. The end of an A token nearest to an interval's middle byte is found by bisection, and so is
    whether a B token ends there too; where none does, ends farther from the middle are tried, one on each side a step. An interval is cut
    at the first shared end and both halves go on to the next level; one without a shared end inside is a group.
    """
    done, todo = [], spans[(spans[:, 0] < spans[:, 1]) & (spans[:, 2] < spans[:, 3])]
    while len(todo):
        one = (todo[:, 1] - todo[:, 0] == 1) | (todo[:, 3] - todo[:, 2] == 1)
        done.append(todo[one][:, [0, 2]])
        todo = todo[~one]
        a0, a1, b0, b1 = todo.T
        first = np.where(a0 > 0, ends_a[a0 - 1], 0)
        middle = (first + ends_a[a1 - 1]) // 2
        near = np.clip(np.searchsorted(ends_a, middle), a0, a1 - 2)
        cut_a, cut_b = np.full(len(todo), -1), np.full(len(todo), -1)
        live, step = np.arange(len(todo)), 0
        while len(live):
            for at in (near[live] + step, near[live] - step - 1):
                inside = (at >= a0[live]) & (at <= a1[live] - 2) & (cut_a[live] < 0)
                who, at = live[inside], at[inside]
                met = np.searchsorted(ends_b, ends_a[at])
                same = ends_b[np.minimum(met, len(ends_b) - 1)] == ends_a[at]
                cut_a[who[same]], cut_b[who[same]] = at[same], met[same]
            step += 1
            live = live[(cut_a[live] < 0) & ((near[live] + step <= a1[live] - 2) | (near[live] - step - 1 >= a0[live]))]
        cut = cut_a >= 0
        done.append(todo[~cut][:, [0, 2]])
        left = np.stack([a0, cut_a + 1, b0, cut_b + 1], 1)[cut]
        right = np.stack([cut_a + 1, a1, cut_b + 1, b1], 1)[cut]
        todo = np.concatenate([left, right])
    starts = np.concatenate(done) if done else np.empty((0, 2), np.int64)
    return starts[np.argsort(starts[:, 0], kind="stable")]


def counted(sizes: list[int]) -> np.ndarray:
    """Starts of lists of these sizes, laid end to end, and their end."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@cache
def _labels(n_a: int, n_b: int) -> list[str]:
    """What is said of an id that goes on or ends its side of a group: A's with , and |, then B's with , and ;."""
    return [f"{i}{s}" for n, stops in ((n_a, ",|"), (n_b, ",;")) for i in range(n) for s in stops]


def align_texts(texts: list[str | None], a: Byte, b: Pieces) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """For each text (n_a, n_b, n_groups, n_links, groups); and the links of all: number of the text, id pair, how often."""
    ids_a: list[list[int]] = []
    ids_b: list[list[int]] = []
    for text in texts:
        x: list[int] = []
        y: list[int] = []
        if text:
            whole = b" " + text.encode()
            x, y = a.ids(" " + text), b.ids(text)
            if b"".join(map(a.bytes.__getitem__, x)) != whole or b"".join(map(b.bytes.__getitem__, y)) != whole:
                x, y = [], []
        ids_a.append(x)
        ids_b.append(y)
    at_a, at_b = counted([len(x) for x in ids_a]), counted([len(x) for x in ids_b])
    flat_a, flat_b = (np.fromiter((i for x in ids for i in x), np.int64, at[-1]) for ids, at in ((ids_a, at_a), (ids_b, at_b)))
    ends_a = np.cumsum(np.fromiter(map(len, a.bytes), np.int64, len(a.bytes))[flat_a])
    ends_b = np.cumsum(np.fromiter(map(len, b.bytes), np.int64, len(b.bytes))[flat_b])
    starts = leaf_groups(ends_a, ends_b, np.stack([at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]], 1))
    # Between two neighbouring ends of either side lies one link: of the tokens that cover these bytes.
    ends = np.union1d(ends_a, ends_b)
    of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    text_of = np.searchsorted(at_a[1:], of_a, side="right")
    n_links = np.bincount(text_of, minlength=len(texts))
    n_groups = np.bincount(np.searchsorted(at_a[1:], starts[:, 0], side="right"), minlength=len(texts))
    pairs = (text_of << 40) + flat_a[of_a] * IDS + flat_b[of_b] if len(ends) else np.empty(0, np.int64)
    pairs, times = np.unique(pairs, return_counts=True)
    # The groups as text: A's ids of a group, then B's; each with the stop that follows.
    last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
    close = np.concatenate([starts[1:], [[len(flat_a), len(flat_b)]]]) if len(starts) else starts
    last_a[close[:, 0] - 1] = 1
    last_b[close[:, 1] - 1] = 1
    said = np.empty(len(flat_a) + len(flat_b), np.int64)
    said[np.arange(len(flat_a)) + np.repeat(starts[:, 1], close[:, 0] - starts[:, 0])] = flat_a * 2 + last_a
    said[np.arange(len(flat_b)) + np.repeat(close[:, 0], close[:, 1] - starts[:, 1])] = (flat_b + len(a.bytes)) * 2 + last_b
    label, rows = _labels(len(a.bytes), len(b.bytes)).__getitem__, []
    for k, (x, y) in enumerate(zip(ids_a, ids_b, strict=True)):
        groups = "".join(map(label, said[at_a[k] + at_b[k] : at_a[k + 1] + at_b[k + 1]].tolist()))[:-1]
        rows.append((len(x), len(y), int(n_groups[k]), int(n_links[k]), groups))
    return rows, pairs >> 40, pairs & ((1 << 40) - 1), times


def _packed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(values.astype(kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind).astype(np.int64)


ROWS = "block long, doc_id long, nameless boolean, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary, counts binary"


def _chunks(texts: list) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about TOGETHER characters."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= TOGETHER:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _align(names: tuple[str, str], keep_groups: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A batch is a block: its id pairs are kept once, in order, and each text's links as places in that list."""
        from pyspark import TaskContext

        a, b = tokenizers(*names)
        for number, batch in enumerate(batches):
            rows, who, pairs, times = [], [], [], []
            texts = batch["text"].tolist()
            for start, end in _chunks(texts):
                found, w, p, t = align_texts(texts[start:end], a, b)
                rows += found
                who.append(w + start)
                pairs.append(p)
                times.append(t)
            if not rows:
                continue
            who, pairs, times = np.concatenate(who), np.concatenate(pairs), np.concatenate(times)
            known, place, docs = np.unique(pairs, return_inverse=True, return_counts=True)
            at = np.searchsorted(who, np.arange(len(rows) + 1))
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups"])
            if not keep_groups:
                out["groups"] = [sha256(g.encode()).hexdigest() if g else "" for g in out["groups"]]
            out["pairs"] = [_packed(np.diff(place[i:j], prepend=0), "<u4") for i, j in zip(at[:-1], at[1:], strict=True)]
            out["times"] = [_packed(times[i:j], "<u4") for i, j in zip(at[:-1], at[1:], strict=True)]
            out["doc_id"], out["nameless"] = batch["doc_id"].array, batch["nameless"].array
            out["counts"] = None
            block = (TaskContext.get().partitionId() << 32) + number
            head = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": -1, "groups": "", "pairs": known.astype("<i8").tobytes(), "times": b"", "doc_id": 0, "nameless": True, "counts": docs.astype("<i8").tobytes()}
            yield pd.concat([out, pd.DataFrame([head])]).assign(block=block)

    return run


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield pd.DataFrame({"pair": np.frombuffer(row.pairs, "<i8"), "docs": np.frombuffer(row.counts, "<i8")}).assign(block=row.block)


def _scored(key: tuple, docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    known = known.sort_values("pair")
    docs_of, best = known["docs"].to_numpy(), known["best"].to_numpy()
    n_best, count_sum = [], []
    for pairs, times in zip(docs["pairs"], docs["times"], strict=True):
        place, often = np.cumsum(_unpacked(pairs, "<u4")), _unpacked(times, "<u4")
        n_best.append(int((often * best[place]).sum()) if len(place) else 0)
        count_sum.append(int((often * docs_of[place]).sum()) if len(place) else 0)
    return docs[["doc_id", "nameless", "n_a", "n_b", "n_groups", "n_links", "groups"]].assign(n_best=n_best, count_sum=count_sum)


def align(docs: DataFrame, *, a: str = "byte_bpe_50k.tiktoken", b: str = "piece_bpe_32k.model", keep_groups: bool = True) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups.

    a is a byte-level vocabulary, b a sentence-piece model. Both encode the text with one space before it; special tokens' strings are
    plain text. Places where tokens of both end cut the bytes into groups (leaf_groups), given as `a1,a2|b1;a3|b2,b3`, or by their SHA-256
    if not keep_groups. A link is a pair of tokens with common bytes; its count is the number of documents, repeated rows included, that
    hold its pair of ids. n_best counts the links whose count is the highest of their A id, ties included; count_sum adds all counts.

    Each Arrow batch is a block with one list of its id pairs and their documents. These lists are summed over all blocks, and each
    block gets back the counts of its own pairs only, so that nothing larger than a block's list meets in one task.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and ''. Very long texts are
    aligned whole, each alone. Null doc_ids are kept, repeated rows are rows like any other, other columns are ignored whatever their
    names, and an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "text")
    made = stored(named.mapInPandas(_align((a, b), keep_groups), ROWS), "aligned")
    texts, lists = made.filter("n_links >= 0").drop("counts"), made.filter("n_links < 0").select("block", "pairs", "counts")
    listed = stored(lists.mapInPandas(_pairs, "pair long, docs long, block long"), "pairs")
    total = listed.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # An A id has a bounded number of pairs: one for each id of B at most.
    total = total.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy(F.shiftrightunsigned("pair", 20))))
    known = listed.select("block", "pair").join(total.hint("merge"), "pair")
    schema = "doc_id long, nameless boolean, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    scored = texts.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_scored, schema)
    return scored.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def digest(docs: DataFrame, **options) -> DataFrame:
    """align(), with the groups' SHA-256 in their place."""
    return align(docs, keep_groups=False, **options).withColumnRenamed("groups", "groups_sha256")
