"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import durable, salt, text_batches

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_marks", "n_same_next")
COUNTS_TYPE = StructType([StructField(c, LongType()) for c in COUNTS])
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SPAN = 8
#: Words that are hashed together; bounds the memory of a batch, apart from a single longer text.
CHUNK = 1 << 19


def repeated_words(hashes: list[np.ndarray]) -> np.ndarray:
    """For each text, given as hashes of its words: how many words lie in SPAN-word windows that occur twice or more."""
    n = np.array([len(h) for h in hashes])
    words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    if len(words) < SPAN:
        return np.zeros(len(n), np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    starts = len(words) - SPAN + 1
    window = owner[:starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    odd = np.random.default_rng(8).integers(1, 2**63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(SPAN):
        window += (words[k : k + starts] ^ (words[k : k + starts] >> np.uint64(29))) * odd[k]
    inside = np.flatnonzero(owner[:starts] == owner[SPAN - 1 :])
    order = inside[np.argsort(window[inside], kind="stable")]
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, order[twice], 1)
    np.add.at(edges, order[twice] + SPAN, -1)
    return np.bincount(owner[np.cumsum(edges[:-1]) > 0], minlength=len(n))


def counts_of(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts of whole texts; a null or empty text has zeros."""
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if waiting:
            out["n_repeat_words"][[i for i, _ in waiting]] = repeated_words([h for _, h in waiting])
        waiting.clear()
        held = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # on bytes: at ASCII white space only
        n = len(words)
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        out["n_words"][i] = n
        out["word_chars"][i] = len(text) - sum(map(text.count, SPACES))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        letters = np.frombuffer(raw, np.uint8)
        out["n_caps"][i] = np.count_nonzero((letters >= 65) & (letters <= 90))
        out["n_marks"][i] = text.count("!")
        hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        out["n_same_next"][i] = np.count_nonzero(hashes[1:] == hashes[:-1])
        if n > SPAN:
            waiting.append((i, hashes))
            held += n
            if held >= CHUNK:
                settle()
    settle()
    return out


@F.pandas_udf(COUNTS_TYPE)
def text_counts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(counts_of(text.tolist()), columns=list(COUNTS))


#: They are the same each time, but only so are a text's counts made once where a filter asks for them too, and a task has one worker.
text_counts = text_counts.asNondeterministic()


def _share(part: str, whole: str, scale: int) -> Column:
    return F.coalesce(F.expr(f"try_divide(c.{part} * {scale}L, c.{whole})").cast("long"), F.lit(0).cast("long"))


#: What is compared with fences: a count, what it is a share of, the scale of the share in sketches, whether low shares count as
#: well, and whether the fence comes from texts with a share above zero only. Repetition and exclamation come in bursts, so that texts
#: without any say nothing about how much of it is usual.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 10_000, False, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, False, True),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, False, True),
    "word_length": ("word_chars", "n_words", 100, True, False),
    "caps": ("n_caps", "word_chars", 10_000, False, False),
    "marks": ("n_marks", "n_words", 10_000, False, True),
    "stutter": ("n_same_next", "n_words", 10_000, False, False),
}
FENCE = 3
#: Where the upper quartile is 0, the fence is the value that this share of all texts stays within: seven eighths.
TAIL = (7, 8)


def measured(docs: DataFrame) -> DataFrame:
    """docs with c (the counts), base_failed, and one integer per measure in m."""
    text_batches(docs.sparkSession)
    counted = docs.withColumn("c", text_counts(F.col("text")))
    failed = (F.col("c.n_words") < 20) | (100 * F.col("c.n_repeat_words") > 30 * F.col("c.n_words"))
    return counted.withColumn("base_failed", failed).withColumn("m", F.struct(*[_share(p, w, s).alias(k) for k, (p, w, s, *_) in MEASURES.items()]))


def low_edge(value: Column) -> Column:
    """The sketch's bucket of a value, named by its low edge: 32 buckets for each power of two, exact below 64."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def group_keys() -> dict[str, Column]:
    """Language and source as keys that are never null."""
    return {k: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(c))) for k, c in (("lang_key", "lang"), ("source_key", "source"))}


def sketches(rows: DataFrame) -> DataFrame:
    """Quantile sketches: (lang_key, source_key, measure, low, n), one row per bucket that has rows.

    Two sketches merge by adding n, so tasks, days and sources can be sketched apart. A sketch has at
    most some 2,000 buckets, whatever the number of rows.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"m.{k}").alias("v")) for k in MEASURES])
    return (
        rows.filter(~F.col("base_failed"))
        .select("lang_key", "source_key", F.explode(pairs).alias("p"))
        .select("lang_key", "source_key", "p.measure", low_edge(F.col("p.v")).alias("low"))
        .groupBy("lang_key", "source_key", "measure", "low")
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, least_rows: int = 30) -> DataFrame:
    """(lang_key, source_key, limits): the fences of each language and source, limits.<measure>.lo and .hi.

    A fence is FENCE quartile distances beyond the upper (or lower) quartile, of all texts or of those with a share above zero. Where the upper
    quartile is 0, it is the TAIL quantile of all texts. A measure for which a group has fewer than least_rows such texts takes the fence of its
    language, merged over all sources, and then that of the whole table; so no few texts set a fence of their own. Where the
    whole table has fewer texts with a share above zero, the fence is its TAIL quantile.
    """
    everywhere = F.lit("*")
    own = sketch
    by_lang = sketch.groupBy("lang_key", "measure", "low").agg(F.sum("n").alias("n")).withColumn("source_key", everywhere)
    whole = by_lang.groupBy("measure", "low").agg(F.sum("n").alias("n")).withColumns({"lang_key": everywhere, "source_key": everywhere})
    levels = own.unionByName(by_lang).unionByName(whole)
    w = Window.partitionBy("lang_key", "source_key", "measure")
    bursts = F.col("measure").isin([k for k, v in MEASURES.items() if v[4]])
    skipped = F.coalesce(F.sum(F.when(bursts & (F.col("low") == 0), F.col("n"))).over(w), F.lit(0))
    ranked = levels.withColumns({"all": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("low")), "skipped": skipped})
    counted = ~bursts | (F.col("low") > 0)
    of = F.col("all") - F.col("skipped")
    quartile = lambda q: F.min(F.when(counted & ((F.col("upto") - F.col("skipped")) * 4 >= of * q), F.col("low")))
    tail = F.min(F.when(F.col("upto") * TAIL[1] >= F.col("all") * TAIL[0], F.col("low")))
    found = ranked.groupBy("lang_key", "source_key", "measure").agg(F.first(of).alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3"), tail.alias("tail"))
    last = F.col("lang_key") == "*"
    found = found.filter(last | (F.col("total") >= least_rows))
    scarce = last & bursts & (F.col("total") < least_rows)
    both = F.create_map(*[F.lit(x) for k, v in MEASURES.items() for x in (k, v[3])])
    reach = (F.col("q3") - F.col("q1")) * FENCE
    fences = (
        found.withColumn("hi", F.when(scarce | (F.col("q3") == 0), F.col("tail")).otherwise(F.col("q3") + reach))
        .withColumn("lo", F.when(both[F.col("measure")], F.greatest(F.col("q1") - reach, F.lit(0))))
        .groupBy("lang_key", "source_key")
        .agg(*[F.max(F.when(F.col("measure") == k, F.struct("lo", "hi"))).alias(k) for k in MEASURES])
        .withColumn("limits", F.struct(*MEASURES))
    )
    named = lambda name, cond: fences.filter(cond).select(
        *[c for c in ("lang_key", "source_key") if c not in ("source_key",) * (name != "own") and c not in ("lang_key",) * (name == "whole")],
        F.col("limits").alias(f"{name}_limits"),
    )
    groups = own.select("lang_key", "source_key").distinct()
    return (
        groups.join(named("own", F.col("source_key") != "*"), ["lang_key", "source_key"], "left")
        .join(named("lang", (F.col("source_key") == "*") & (F.col("lang_key") != "*")), "lang_key", "left")
        .crossJoin(F.broadcast(named("whole", F.col("lang_key") == "*")))  # one row
        .select(
            "lang_key",
            "source_key",
            F.struct(*[F.coalesce(f"own_limits.{k}", f"lang_limits.{k}", f"whole_limits.{k}").alias(k) for k in MEASURES]).alias("limits"),
        )
    )


#: Groups up to which thresholds are small enough to send to every executor.
SMALL = 10_000


def with_verdict(rows: DataFrame, limits: DataFrame, order: Column) -> DataFrame:
    """rows with kept: within all fences of its language and source.

    A short text may pass a fence by chance. So its count is compared with what the fence allows, give or take FENCE standard
    deviations of a count (as many as the fence allows, and one in a hundred more) and 1.

    Few groups are broadcast, after counting them. Otherwise both sides are dealt by group and salt, so
    that a source with a third of all rows is spread over tasks.
    """
    within = F.lit(True)
    for k, (part, whole, scale, two_sided, _) in MEASURES.items():
        count, n = F.col(f"c.{part}").cast("double"), F.col(f"c.{whole}").cast("double")

        def apart(edge: str, sign: int, k=k, count=count, n=n, scale=scale) -> Column:
            allowed = F.coalesce(F.col(f"limits.{k}.{edge}"), F.lit(0)).cast("double") * n / scale
            over = (count - allowed) * sign - 1
            return (over <= 0) | (over * over <= FENCE**2 * (allowed + n / 100))

        within = within & apart("hi", 1)
        if two_sided:
            within = within & apart("lo", -1)
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    if limits.count() <= SMALL:
        joined = rows.join(F.broadcast(limits), ["lang_key", "source_key"], "left")
    else:
        parts = 32
        salted = limits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        joined = rows.withColumn("__salt", salt(order, parts)).join(salted, ["lang_key", "source_key", "__salt"], "left").drop("__salt")
    return joined.withColumn("kept", kept).drop("limits")


def judge(docs: DataFrame, *, least_rows: int = 30) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of docs (doc_id, text, lang, source).

    A text fails the base with fewer than 20 words or if more than 30 % of its words lie in repeated
    8-word windows. The others are kept if every measure lies within the fences of their language and source (thresholds(),
    with_verdict()). Very long texts are counted whole. Other columns are ignored.
    Null and empty texts have no words and fail. Null languages and sources are groups like any other, null
    doc_ids and repeated rows are judged like any row, and an empty table gives no rows.
    """
    rows = durable(measured(docs.select("doc_id", "text", "lang", "source")).withColumns(group_keys()).drop("text"))
    limits = durable(thresholds(sketches(rows), least_rows))
    return with_verdict(rows, limits, F.coalesce("doc_id", F.lit(0))).select("doc_id", "c.*", "base_failed", "kept")


def keep_good(docs: DataFrame, *, least_rows: int = 30) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names. Null and empty texts go; rows
    that are equal go or stay together; an empty table gives no rows.

    Texts are read twice, once for the sketches and once to filter: cheaper than to store or shuffle them.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = measured(docs.select(own, "text", "lang", "source")).withColumns(group_keys())
    limits = durable(thresholds(sketches(rows), least_rows))
    return with_verdict(rows, limits, F.xxhash64("text")).filter("kept").select("row.*")


def _oracle() -> str:
    measure = lambda k: f"coalesce(({MEASURES[k][0]} * {MEASURES[k][2]}) // nullif({MEASURES[k][1]}, 0), 0)"
    pairs = "\n    UNION ALL ".join(f"SELECT id, '{k}' AS measure, {measure(k)} AS v, {v[0]}::DOUBLE AS part, {v[1]}::DOUBLE AS whole, {v[2]} AS scale, {str(v[3]).lower()} AS two_sided, {str(v[4]).lower()} AS bursts FROM counts" for k, v in MEASURES.items())
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '~null') AS lang, coalesce(source, '~null') AS source, coalesce(text, '') AS text FROM documents),
listed AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
spans AS (SELECT id, i, array_to_string(words[i:i + {SPAN - 1}], ' ') AS span FROM listed, range(1, len(words) - {SPAN - 2}) r(i)),
twice AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, span) AS n FROM spans) WHERE n > 1),
covered AS (SELECT id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, range(0, {SPAN}) r(k) GROUP BY id),
stutters AS (SELECT id, count(*)::BIGINT AS n_same_next FROM listed, range(2, len(words) + 1) r(i) WHERE words[i] = words[i - 1] GROUP BY id),
lines AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
counts AS (
  SELECT id, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_caps, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_marks,
         coalesce(n_same_next, 0)::BIGINT AS n_same_next
  FROM docs JOIN listed USING (id) LEFT JOIN lines USING (id) LEFT JOIN covered USING (id) LEFT JOIN stutters USING (id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
measures AS ({pairs}),
good AS (SELECT m.*, lang, source, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS low FROM measures m JOIN judged USING (id) WHERE NOT base_failed),
leveled AS (
  SELECT lang, source, measure, low, bursts FROM good
  UNION ALL SELECT lang, '*', measure, low, bursts FROM good
  UNION ALL SELECT '*', '*', measure, low, bursts FROM good),
quartiles AS (
  SELECT lang, source, measure, count(*) FILTER (NOT bursts OR low > 0) AS total, quantile_disc(low, 0.25) FILTER (NOT bursts OR low > 0) AS q1,
    quantile_disc(low, 0.75) FILTER (NOT bursts OR low > 0) AS q3, quantile_disc(low, 0.875) AS tail, bool_or(bursts) AS bursts
  FROM leveled GROUP BY lang, source, measure),
fences AS (
  SELECT *, CASE WHEN lang = '*' AND bursts AND total < 30 OR q3 = 0 THEN tail ELSE q3 + (q3 - q1) * {FENCE} END AS hi, greatest(coalesce(q1 - (q3 - q1) * {FENCE}, 0), 0) AS lo FROM quartiles),
allowed AS (
  SELECT m.*, CASE WHEN a.total >= 30 THEN a.lo WHEN b.total >= 30 THEN b.lo ELSE c.lo END::DOUBLE * whole / scale AS least,
    CASE WHEN a.total >= 30 THEN a.hi WHEN b.total >= 30 THEN b.hi ELSE c.hi END::DOUBLE * whole / scale AS most
  FROM measures m JOIN judged j USING (id)
  LEFT JOIN fences a ON a.lang = j.lang AND a.source = j.source AND a.measure = m.measure
  LEFT JOIN fences b ON b.lang = j.lang AND b.source = '*' AND b.measure = m.measure
  LEFT JOIN fences c ON c.lang = '*' AND c.source = '*' AND c.measure = m.measure),
verdicts AS (
  SELECT id, bool_and((part - most <= 1 OR pow(part - most - 1, 2) <= {FENCE**2} * (most + whole / 100))
    AND (NOT two_sided OR least - part <= 1 OR pow(least - part - 1, 2) <= {FENCE**2} * (least + whole / 100))) AS within
  FROM allowed GROUP BY id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_caps, n_marks, n_same_next, base_failed,
       NOT base_failed AND coalesce(within, false) AS kept
FROM judged JOIN verdicts USING (id)
"""


ORACLE = _oracle()
