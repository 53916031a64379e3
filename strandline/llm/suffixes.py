"""Repeated byte strings by suffix arrays: stretches that may repeat are dealt by a shared core, and each deal's suffixes are sorted by DC3."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from .common import stored, text_batches

#: Bytes of text read together, and the most of one text at a time.
TOGETHER, SLAB = 1_000_000, 4_000_000
#: Letters whose suffixes are sorted together; distinct stretches around one core from which on they meet by shuffle instead.
LETTERS, CROWDED = 1_000_000, 5_000
#: Letters that fit three into a number.
WIDE = 1 << 21


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of s (whole numbers from 1 up) in order, by difference cover modulo 3 (Kaerkkaeinen, Sanders 2003).

    Triples at places 1 and 2 modulo 3 are sorted and named; if names repeat, the string of names is sorted in the same way. The other
    suffixes are sorted by first letter and the rank of what follows, and merged with these.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    if t.max() >= WIDE:
        t[:n] = np.unique(t[:n], return_inverse=True)[1] + 1
    if n >= WIDE - 2:
        raise ValueError(f"{n} letters are too many to sort together")
    # A sample of length n % 3 == 1 ends with an empty triple, which parts the two halves of the string of names.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    triple = (t[sample] * WIDE + t[sample + 1]) * WIDE + t[sample + 2]
    order = np.argsort(triple, kind="stable")
    new = np.append(True, np.diff(triple[order]) != 0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(names)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * WIDE + rank[rest + 1], kind="stable")]
    one = sampled[sampled % 3 == 1]
    two = sampled[sampled % 3 == 2]
    near = lambda i: t[i] * WIDE + rank[i + 1]
    far = lambda i: (t[i] * WIDE + t[i + 1]) * WIDE + rank[i + 2]
    at = np.arange(len(rest)) + np.searchsorted(near(one), near(rest)) + np.searchsorted(far(two), far(rest))
    out = np.empty(n, np.int64)
    others = np.ones(n, bool)
    others[at] = False
    out[at] = rest
    out[others] = sampled
    return out


def first_elsewhere(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Those of the starts (in order) whose `length` letters also begin at an earlier of them, by comparing neighbours in the suffix array."""
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_array(text)
    order = order[wanted[order]]
    if not len(order):
        return order
    same = np.ones(len(order) - 1, bool)
    live = np.arange(len(order) - 1)
    for k in range(length):
        live = live[text[order[live] + k] == text[order[live + 1] + k]]
    same[:] = False
    same[live] = True
    heads = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(order, heads)
    group = np.cumsum(np.append(True, ~same)) - 1
    return np.sort(order[order != least[group]])


def _hashes(a: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on, put together from spans of powers of two."""
    m1, m2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    span, h = 1, (a.astype(np.uint64) + np.uint64(1)) * m1
    out: np.ndarray | None = None
    done = 0
    while size:
        if size & 1:
            if out is None:
                out = h
            else:
                k = len(h) - done
                out = out[:k] * m2 + h[done : done + k]
                out = (out ^ (out >> np.uint64(32))) * m1
            done += span
        size >>= 1
        if size:
            k = len(h) - span
            h = h[:k] * m2 + h[span:]
            h = (h ^ (h >> np.uint64(29))) * m1
            span *= 2
    return out ^ (out >> np.uint64(31))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if span < width else h


def cores(text: bytes, ends: np.ndarray, length: int, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, core, first, last): runs of windows of `length` bytes with the same core, over texts laid end to end.

    A window's core is the place in it whose `core` bytes hash least, the leftmost of equals: equal windows have equal
    cores at equal places. first and last are the starts of the run's windows.
    """
    a = np.frombuffer(text, np.uint8)
    n = len(a) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    h = _hashes(a, core)
    least = _least((h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64), length - core + 1)
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(n), side="right")
    inside = np.arange(n) + length <= ends[owner]
    new = np.append(True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    return h[at[first]].view(np.int64), at[first], first, last


#: What names a document: its id (null as the greatest) and a hash of id and text.
DOC = ["id", "h"]
#: A core's place in its text, the windows' reach to its left and their number less one, in one number that rises with the place.
REACH = 1 << 12


def _packed_place(core: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (core * 64 + (core - first)) * 64 + (last - first)


def _chunks(texts: list, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, place, bytes): whole texts, and slabs of long ones, in which each window lies once."""
    chunk, size = [], 0
    for k, text in enumerate(texts):
        for start in range(0, len(text) - length + 1 if text else 0, SLAB):
            part = text[start : start + SLAB + length - 1]
            chunk.append((k, start, part))
            size += len(part)
            if size >= TOGETHER:
                yield chunk
                chunk, size = [], 0
    if chunk:
        yield chunk


def _cores(length: int, core: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, hs = batch["id"].to_numpy(), batch["h"].to_numpy()
            for chunk in _chunks(batch["text"].tolist(), length):
                whole = b"".join(part for *_, part in chunk)
                ends = np.cumsum([len(part) for *_, part in chunk])
                gram, at, first, last = cores(whole, ends, length, core)
                owner = np.searchsorted(ends, first, side="right")
                view = memoryview(whole)
                around = [xxh3_64_intdigest(view[i:j]) for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)]
                shift = (np.array([start for _, start, _ in chunk]) - ends + np.array([len(part) for *_, part in chunk]))[owner]
                row = np.array([k for k, *_ in chunk])[owner]
                yield pd.DataFrame(
                    {"gram": gram, "around": np.array(around, np.uint64).view(np.int64), "id": ids[row], "h": hs[row], "place": _packed_place(at + shift, first + shift, last + shift)}
                )

    return run


def _squeezed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield batch.assign(text=[pack.compress(t) if t else b"" for t in batch["text"]])


def _text(z: bytes) -> bytes:
    return zstandard.decompress(z) if z else b""


STRETCH = "gram long, id long, h long, place long, stretch binary"


def _stretches(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h, z, wanted in zip(batch["id"], batch["h"], batch["text"], batch["wanted"], strict=True):
                text = _text(z)
                for w in wanted:
                    at, left, more = w["place"] // REACH, w["place"] // 64 % 64, w["place"] % 64
                    out.append((w["gram"], i, h, w["place"], text[at - left : at - left + more + length]))
            yield pd.DataFrame(out, columns=["gram", "id", "h", "place", "stretch"])

    return run


def _spans(who: np.ndarray, starts: np.ndarray, rows: pd.DataFrame, at: np.ndarray, length: int) -> pd.DataFrame:
    """Spans of bytes that windows cover: starts, in order, are places in stretches laid out from `at` on; who names their rows."""
    if not len(starts):
        return pd.DataFrame({"id": [], "h": [], "start": [], "size": []}, dtype=np.int64)
    new = np.append(True, (np.diff(starts) != 1) | (np.diff(who) != 0))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    own = who[head]
    place = rows["place"].to_numpy()[own]
    begin = place // REACH - place // 64 % 64
    return pd.DataFrame({"id": rows["id"].to_numpy()[own], "h": rows["h"].to_numpy()[own], "start": begin + starts[head] - at[own], "size": starts[tail] - starts[head] + length})


def repeats_among(rows: pd.DataFrame, length: int, core: int) -> pd.DataFrame:
    """(id, h, start, size): what windows cover that an earlier row of the same gram has too. rows: as STRETCH, by gram and document.

    The bytes of each core are one letter, the same for all rows of a gram, so a window has length - core + 1 letters.
    """
    letter = np.cumsum(np.append(True, np.diff(rows["gram"].to_numpy()) != 0)) + 256
    place = rows["place"].to_numpy()
    left, more = place // 64 % 64, place % 64
    sizes = more + length - core + 1
    at = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int(sizes.sum() + len(sizes)), np.int64)
    for k, said in enumerate(rows["stretch"]):
        a, i = np.frombuffer(said, np.uint8).astype(np.int64) + 2, left[k]
        text[at[k] : at[k] + i] = a[:i]
        text[at[k] + i] = letter[k] + 2
        text[at[k] + i + 1 : at[k] + sizes[k]] = a[i + core :]
    who = np.repeat(np.arange(len(rows)), more + 1)
    starts = np.arange(len(who)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1) + at[who]
    again = first_elsewhere(text, starts, length - core + 1)
    return _spans(np.searchsorted(at, again, side="right") - 1, again, rows, at, length)


def _sorted_suffixes(length: int, core: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by gram; whole grams are taken until they have LETTERS letters."""
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += int(batch["stretch"].str.len().sum())
            if size < LETTERS:
                continue
            rows = pd.concat(held, ignore_index=True)
            gram = rows["gram"].to_numpy()
            cut = np.searchsorted(gram, gram[-1])  # the last gram may go on
            if cut:
                yield repeats_among(rows[:cut], length, core)
            held = [rows[cut:]]
            size = int(held[0]["stretch"].str.len().sum())
        if held and sum(map(len, held)):
            yield repeats_among(pd.concat(held, ignore_index=True), length, core)

    return run


def _windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h, place, said in zip(batch["id"], batch["h"], batch["place"], batch["stretch"], strict=True):
                begin = place // REACH - place // 64 % 64
                for k in range(len(said) - length + 1):
                    d = xxh3_128_intdigest(said[k : k + length])
                    out.append(((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), i, h, begin + k))
            yield pd.DataFrame(out, columns=["w1", "w2", "id", "h", "start"])

    return run


CUT = "id long, h long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, doc_id long"


def _removed(keep: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, h, z, spans, none in zip(batch["id"], batch["h"], batch["text"], batch["spans"], batch["nameless"], strict=True):
                text, kept, at, gone, n = _text(z), [], 0, 0, 0
                end = -1
                for start, size in sorted((s["start"], s["size"]) for s in spans) if spans is not None else ():
                    if start > end:
                        kept.append(text[at:start])
                        n += 1
                        at = start
                    end = max(end, start + size)
                    gone += max(0, end - at)
                    at = max(at, end)
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((i, h, len(text), gone, n, rest if keep else None, sha256(rest).hexdigest(), None if none else i))
            frame = pd.DataFrame(out, columns=["id", "h", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "doc_id"])
            frame["doc_id"] = pd.array([r[-1] for r in out], "Int64")
            yield frame

    return run


def drop_repeats(docs: DataFrame, *, length: int = 100, core: int = 40, crowded: int = CROWDED, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) for every row of docs (doc_id, text).

    A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document with a smaller id (null last; equal
    ids by a hash of the text), or earlier in the same. n_spans counts the runs that went; kept holds what is left, as bytes, since a
    character may be cut.

    Each window of `length` bytes has a core, chosen by hash from its bytes alone. Cores that occur once settle their windows: no other
    window is equal. Of those that occur again, with the same bytes around, all but the first go at once. What is left are stretches of
    different bytes around one core; they meet by core, and DC3 sorts the suffixes of whole groups of them (repeats_among), where equal
    windows are neighbours. Stretches around a core with more than `crowded` different ones meet by a 128-bit hash of each window.

    Texts are bytes of UTF-8. Null texts are empty, texts below `length` bytes stay whole, very long ones are read in slabs that overlap.
    Rows with the same doc_id and text are one document and get the same result; other columns are ignored whatever their names; an
    empty table gives no rows.
    """
    if not 0 < length - core <= 63:
        raise ValueError("a core is shorter than the length by 1 to 63 bytes")
    text_batches(docs.sparkSession)
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("h"),
        F.col("doc_id").isNull().alias("nameless"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    known = named.select(*DOC, "text").mapInPandas(_cores(length, core), "gram long, around long, id long, h long, place long")
    of_gram = Window.partitionBy("gram").orderBy("around").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = known.withColumns({"n": F.count("*").over(of_gram), "mixed": F.first("around").over(of_gram) != F.last("around").over(of_gram)}).filter("n > 1")
    first = F.min(F.struct(*DOC, "place")).over(Window.partitionBy("gram", "around"))
    again = stored(again.withColumn("is_first", F.struct(*DOC, "place") == first).filter("mixed OR NOT is_first").drop("n", "around"), "cores")
    begin = F.floor(F.col("place") / REACH) - F.floor(F.col("place") / 64) % 64
    spans = again.filter("NOT is_first").select(*DOC, begin.alias("start"), (F.col("place") % 64 + length).alias("size"))

    squeezed = named.mapInPandas(_squeezed, "id long, h long, nameless boolean, text binary")
    open_ = again.filter("is_first").dropDuplicates([*DOC, "gram", "place"])
    wanted = open_.groupBy(*DOC).agg(F.collect_list(F.struct("gram", "place")).alias("wanted"))
    pieces = squeezed.drop("nameless").join(wanted.hint("merge"), DOC).mapInPandas(_stretches(length), STRETCH)
    pieces = stored(pieces.dropDuplicates([*DOC, "gram", "place"]), "stretches")
    crowds = pieces.groupBy("gram").count().filter(F.col("count") > crowded).select("gram")
    usual = pieces.join(crowds.hint("merge"), "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", *DOC, "place")
    span = "id long, h long, start long, size long"
    spans = spans.unionByName(usual.mapInPandas(_sorted_suffixes(length, core), span))
    windows = pieces.join(crowds.hint("merge"), "gram", "left_semi").mapInPandas(_windows(length), "w1 long, w2 long, id long, h long, start long")
    earliest = windows.groupBy("w1", "w2").agg(F.min(F.struct(*DOC, "start")).alias("first"))
    later = windows.join(earliest.hint("merge"), ["w1", "w2"]).filter(F.struct(*DOC, "start") != F.col("first"))
    spans = spans.unionByName(later.select(*DOC, "start", F.lit(length).cast("long").alias("size")))

    by_doc = spans.groupBy(*DOC).agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    cut = squeezed.join(by_doc.hint("merge"), DOC, "left").mapInPandas(_removed(keep), CUT)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", *["kept"] * keep, "kept_sha256")
