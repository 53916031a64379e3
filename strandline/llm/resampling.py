"""Importance resampling towards a target: hashed n-grams weigh documents, and the highest scores with Gumbel noise are drawn."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import accumulate
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_batches

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: A-Z become a-z; digits, letters and all bytes from 0x80 on belong to words, all others part them.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text whose n-grams are held at a time; a longer text is taken alone.
TOGETHER = 1_000_000
#: Shifts by fewer bytes have a table each, others are put together from powers of two.
NEAR = 128


@cache
def _byte_table() -> np.ndarray:
    """What a CRC register's low byte becomes when a zero byte passes."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


def _through(tables: np.ndarray, c: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
    """The linear map of tables (four bytes by 256 values, at row `at` of them) applied to c."""
    flat, base = tables.reshape(-1), np.asarray(at) * 1024
    out = flat[base + (c & 255)]
    for k in (1, 2, 3):
        out = out ^ flat[base + 256 * k + ((c >> np.uint32(8 * k)) & 255)]
    return out


@cache
def _near_shifts() -> np.ndarray:
    """[n, byte, value]: what a register becomes when n zero bytes pass, for n below NEAR."""
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [now]
    for _ in range(NEAR - 1):
        now = _byte_table()[now & 255] ^ (now >> np.uint32(8))
        out.append(now)
    return np.stack(out)


@cache
def _power_shift(k: int) -> np.ndarray:
    """As one of _near_shifts(), for 2**k bytes."""
    if 1 << k < NEAR:
        return _near_shifts()[1 << k]
    half = _power_shift(k - 1)
    return _through(half, half)


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The share of a prefix with this CRC in the CRC of a text that goes on for n bytes more."""
    out = _through(_near_shifts(), crc, np.where(n < NEAR, n, 0))
    far = np.flatnonzero(n >= NEAR)
    if len(far):
        left, c = n[far], crc[far]
        for k in range(int(left.max()).bit_length()):
            c = np.where((left >> k) & 1, _through(_power_shift(k), c), c)
        out[far] = c
    return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLDED).split() if text else []


def gram_crcs(texts: list[list[bytes]], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, CRC-32) of every run of 1 to `longest` words of each text, the words joined by one space.

    Each text is scanned once, and the running CRC is kept before and after each word. A run's CRC is that after its
    last word without the share of what stands before its first, which is the CRC there, shifted by the run's length.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(sizes.sum())
    text = np.repeat(np.arange(len(texts)), sizes)
    long = np.fromiter((len(w) for t in texts for w in t), np.int64, total)
    after = np.fromiter((c for t in texts for c in accumulate(t, lambda c, w: crc32(w, crc32(b" ", c)), initial=0)), np.uint32, total + len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1  # each text's places begin with the CRC of nothing
    at = np.arange(total) + text
    before = after[at]
    # A space passes before each word.
    ends = np.cumsum(long + 1)
    starts = ends - long
    state = before ^ np.uint32(0xFFFFFFFF)
    before = (_byte_table()[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    after = np.delete(after, first) if len(first) else after
    who, found = [], []
    for n in range(1, longest + 1):
        i = np.flatnonzero(text[: total - n + 1] == text[n - 1 :]) if total >= n else np.empty(0, np.int64)
        j = i + n - 1
        who.append(text[i])
        found.append(after[j] ^ shifted(before[i], ends[j] - starts[i]))
    return np.concatenate(who), np.concatenate(found)


def _chunks(texts: list) -> Iterator[list[list[bytes]]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(words_of(text))
        size += len(text or "")
        if size >= TOGETHER:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _tally(longest: int, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in _chunks(batch["text"].tolist()):
                total += np.bincount(gram_crcs(chunk, longest)[1] % buckets, minlength=buckets)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": held.astype(np.int32), "n": total[held]})

    return run


def bucket_counts(texts: DataFrame, *, longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many runs of words of texts (text) fall into each bucket that has any. Each task adds up its own first."""
    tally = texts.select("text").mapInPandas(_tally(longest, buckets), "bucket int, n long")
    return tally.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """A bucket's gain in thousandths of a nat, from bucket_counts() of both, which have at most `buckets` rows each."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, of in ((s, documents), (t, target)):
        for row in of.collect():
            counts[row.bucket] = row.n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return [math.floor(1000 * math.log(float(x + 1) * all_s / (float(y + 1) * all_t))) for x, y in zip(t.tolist(), s.tolist(), strict=True)]


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, from the id alone; a null id counts as an empty text."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


WEIGHED = "doc_id long, nameless boolean, n_words long, n_features long, weight long, score long"


def _weigh(gain: list[int], longest: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value = np.array(gain, np.int64)
        for batch in batches:
            out = []
            for chunk in _chunks(batch["text"].tolist()):
                who, crc = gram_crcs(chunk, longest)
                # Sums of whole numbers below 2**53 are exact.
                weight = np.bincount(who, weights=value[crc % len(value)], minlength=len(chunk)).astype(np.int64)
                out.append(pd.DataFrame({"n_words": [len(t) for t in chunk], "n_features": np.bincount(who, minlength=len(chunk)), "weight": weight}))
            if not out:
                continue
            found = pd.concat(out, ignore_index=True)
            found["doc_id"], found["nameless"] = batch["doc_id"].array, batch["nameless"].array
            own = [noise(seed, None if none else i) for i, none in zip(batch["doc_id"].tolist(), batch["nameless"].tolist(), strict=True)]
            yield found.assign(score=found["weight"] + own)[["doc_id", "nameless", "n_words", "n_features", "weight", "score"]]

    return run


def ranked(rows: DataFrame, order: list, part_rows: int = 100_000) -> DataFrame:
    """rows with rank (from 1) in this order: parts cut by it are numbered apart, after a count of the parts before."""
    rows = durable(rows)
    parts = max(1, math.ceil(rows.count() / part_rows))
    # Part numbers are kept before they are used twice.
    dealt = durable(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(sizes, "__part").withColumn("rank", F.col("__before") + inside).drop("__part", "__before")


def resample(docs: DataFrame, target: DataFrame, *, longest: int = 3, buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each of docs (doc_id, text), resampled towards the texts of target (text).

    Features are all runs of 1 to `longest` words (digits, small letters and characters beyond ASCII, after A-Z are lowered), each in
    the bucket of its CRC-32. weight adds up the gains of a document's features: log ratios of smoothed bucket shares in target and
    docs, in thousandths. score adds Gumbel noise from the id. Of the documents with min_words words, `percent` in a hundred are drawn,
    the highest scores first, ties to the smaller doc_id (null last); rank is their place from 1, and null for all others.

    Texts are scanned twice and not shuffled: once to add up buckets within each task, once to weigh. Null and empty texts have no
    features and weight 0; very long ones are taken whole, each alone; repeated rows are documents of their own with equal scores, in any
    order; null ids share one noise; other columns are ignored whatever their names; an empty table gives no rows, and an empty
    target leaves the weights to the corpus alone.
    """
    text_batches(docs.sparkSession)
    counts = [bucket_counts(df, longest=longest, buckets=buckets) for df in (docs, target)]
    gain = gains(*counts, buckets)
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "text")
    weighed = durable(named.mapInPandas(_weigh(gain, longest, seed), WEIGHED))
    able = weighed.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("nameless"), F.col("doc_id")]
    placed = ranked(able, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    rest = weighed.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = placed.unionByName(rest).withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """DuckDB SQL, with CRC-32 byte by byte over the distinct features and a table made by its rule."""
    table = ", ".join(map(str, _byte_table().tolist()))
    return f"""
WITH said AS (
  SELECT 'd' AS kind, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') AS w FROM documents
  UNION ALL
  SELECT 't', item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') FROM benchmark
), grams AS (
  SELECT kind, doc_id, unnest(w) AS g FROM said
  UNION ALL SELECT kind, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM said
  UNION ALL SELECT kind, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM said
), counted AS (SELECT kind, doc_id, g, count(*) AS n FROM grams GROUP BY ALL
), texts AS (SELECT DISTINCT g, hex(encode(g)) AS x FROM counted
), hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i: instr('0123456789ABCDEF', x[2 * i + 1]) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 17)),
    lambda c, b: xor([{table}][(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM texts
), held AS (SELECT kind, doc_id, bucket, sum(n)::BIGINT AS n FROM counted JOIN hashed USING (g) GROUP BY ALL
), sums AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 't'), 0) AS t FROM held GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM said LEFT JOIN weights USING (doc_id) WHERE kind = 'd'
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 5 // 100 THEN place END AS rank FROM placed
"""


ORACLE = oracle()
