"""Substring dedup by sliding sentence spans: runs of sentences that came before, anywhere, are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .common import durable, salt, stored, text_batches

#: A sentence: words, with the stops and white space that follow. Every character is in exactly one.
SENTENCE = re.compile(r"(?:[^\s.!?]+[^\S\n]*)+[.!?\s]*|[.!?\s]+")
WORD = re.compile(r"\S+\s*")
#: Sentences of more words are cut into parts of LEAST to LONG words, after words whose hash is divisible by CUT if there are such.
LONG, LEAST, CUT = 24, 6, 6
#: Runs with more occurrences are hot. Hot runs are looked up in a table that is broadcast if it has at most SMALL rows.
HOT, SMALL = 10_000, 10_000


def sentences(text: str) -> list[str]:
    out = []
    for s in SENTENCE.findall(text):
        if len(s) <= 2 * LONG or s.count(" ") + s.count("\t") < LONG:
            out.append(s)
            continue
        part: list[str] = []
        for word in WORD.findall(s):
            part.append(word)
            if len(part) == LONG or len(part) >= LEAST and crc32(word.rstrip().encode("utf-8", "surrogatepass")) % CUT == 0:
                out.append("".join(part))
                part = []
        if part:
            out.append("".join(part))
    return out


def shortest_runs(n: list[int], span: int, min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the shortest runs of `span` sentences or more with min_words words or more, from each sentence on and up
    to each sentence; n: words of the sentences. They depend on nothing outside them, and all sentences of a passage
    with enough words are in one that lies within it."""
    found, total = set(), list(accumulate(n, initial=0))
    ahead = 0
    for k in range(len(n)):
        ahead = max(ahead, k + span)
        while ahead <= len(n) and total[ahead] - total[k] < min_words:
            ahead += 1
        if ahead > len(n):
            break
        found.add((k, ahead))
    back = 0
    for end in range(span, len(n) + 1):
        while back + 1 <= end - span and total[end] - total[back + 1] >= min_words:
            back += 1
        if total[end] - total[back] >= min_words:
            found.add((back, end))
    return sorted(found)


def long_runs(text: str, span: int, min_words: int) -> tuple[list[int], list[int], list[int]]:
    """(128-bit hashes, places, lengths) of the shortest runs of sentences, white space normalised.

    A piece without a word is no sentence; places count the others.
    """
    from xxhash import xxh128_intdigest as digest

    said, n = [], []
    for s in sentences(text):
        words = s.split()
        if words and any(c.isalnum() for c in s):
            said.append(" ".join(words))
            n.append(len(words))
    runs = shortest_runs(n, span, min_words)
    hashes = [digest("\n".join(said[a:b]).encode("utf-8", "surrogatepass")) for a, b in runs]
    return hashes, [a for a, _ in runs], [b - a for a, b in runs]


#: Of the 128 bits of a run's hash, 64 deal it and 32 more tell it from others.
LOW = (1 << 64) - 1
RUN = ["run", "check"]


def _runs(span: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [long_runs(t, span, min_words) if t else ([], [], []) for t in batch["text"].tolist()]
            n = [len(h) for h, *_ in found]
            yield pd.DataFrame(
                {
                    "run": np.fromiter((x & LOW for h, *_ in found for x in h), np.uint64, sum(n)).view(np.int64),
                    "check": np.fromiter((x >> 96 for h, *_ in found for x in h), np.uint32, sum(n)).view(np.int32),
                    "doc_id": np.repeat(batch["doc_id"].to_numpy(), n),
                    "nameless": np.repeat(batch["nameless"].to_numpy(), n),
                    "row": np.repeat(batch["row"].to_numpy(), n),
                    "place": np.fromiter((x for _, p, _ in found for x in p), np.int32, sum(n)),
                    "length": np.fromiter((x for *_, c in found for x in c), np.int32, sum(n)),
                }
            )

    return run


CLEANED = StructType([StructField("text", StringType()), StructField("n_sentences", IntegerType()), StructField("n_removed", IntegerType()), StructField("removed", StringType())])


@F.pandas_udf(CLEANED)
def _without(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for text, found in zip(texts.tolist(), runs.tolist(), strict=True):
        pieces = sentences(text) if text else []
        real = [i for i, s in enumerate(pieces) if any(c.isalnum() for c in s)]
        gone = {real[k] for s, n in (found if found is not None else ()) for k in range(s, s + n)}
        kept, cut, at = [], [], 0
        for i, s in enumerate(pieces):
            if i not in gone:
                kept.append(s)
            elif cut and cut[-1][1] == at:
                cut[-1][1] = at + len(s)
            else:
                cut.append([at, at + len(s)])
            at += len(s)
        out.append((text if not gone else "".join(kept), len(real), len(gone), ",".join(f"{a}:{b}" for a, b in cut)))
    return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "removed"])


def meet(runs: DataFrame, hot: DataFrame, columns: list[str], how: str) -> DataFrame:
    """runs joined with the hot ones among them: by a broadcast table if it is small, counted before, or else by run and salt."""
    if hot.count() <= SMALL:
        return runs.join(F.broadcast(hot.select(*RUN, *columns)), RUN, how)
    salted = hot.select(*RUN, *columns, F.explode(F.sequence(F.lit(0), F.lit(255))).alias("salt"))
    return runs.withColumn("salt", salt("row", 256)).join(salted.hint("merge"), [*RUN, "salt"], how).drop("salt")


def drop_repeats(docs: DataFrame, *, span: int = 2, min_words: int = 25, hot: int = HOT) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed) for every row of docs (doc_id, text).

    Runs of `span` consecutive sentences with min_words words in all, and of as many more as it takes to reach min_words
    where sentences are short, are hashed and joined over all documents (shortest_runs). The
    first, by doc_id (null last), row hash and place, stays; sentences that any later one covers are removed.
    removed lists the spans that went, as start:end in code points of the original text. Sentences of more than 24 words
    count as several, cut by content, so that a passage which begins inside one is cut as elsewhere.

    Repeats of fewer than min_words words (common lines, phrases) stay. A run with more than `hot` occurrences is looked up apart
    (meet()); the others are joined by shuffle, where each is rare. Runs are told apart by 96 bits of hash.

    Very long texts are read whole. Null, empty and short texts have no runs and stay as they are. Rows with the same doc_id and text
    are one document, other columns are ignored, and an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    # A column with nulls would reach Python as doubles, which round ids.
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "text")
    rows = named.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    doc = ["nameless", "doc_id", "row"]
    runs = stored(rows.mapInPandas(_runs(span, min_words), "run long, check int, doc_id long, nameless boolean, row long, place int, length int"), "runs")
    # Who repeats is found by hashes and counts alone; only repeated runs are joined with their places.
    again = durable(runs.groupBy(*RUN).agg(F.count("*").alias("n")).filter("n > 1"))
    many, few = again.filter(F.col("n") > hot), again.filter(F.col("n") <= hot).select(*RUN)
    where = F.struct(*doc, "place")
    later = where != F.col("first")
    rare = meet(runs, many, [], "left_anti").join(few.hint("merge"), RUN).withColumn("first", F.min(where).over(Window.partitionBy(*RUN)))
    common = meet(runs, many, ["n"], "inner").drop("n")
    common = meet(common, durable(common.groupBy(*RUN).agg(F.min(where).alias("first"))), ["first"], "inner")
    again = rare.unionByName(common).filter(later).select(*doc, "place", "length")
    cuts = again.groupBy(*doc).agg(F.sort_array(F.collect_set(F.array("place", "length"))).alias("runs"))
    joined = rows.join(cuts.hint("merge"), doc, "left").withColumn("x", _without("text", "runs"))
    return joined.select(F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "x.*")
