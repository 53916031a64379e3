"""Secret scans over content-addressed texts: each text is scanned once for each rule version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, stored


def either_case(word: str) -> str:
    """A pattern for the ASCII word with letters in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern, leftmost and without overlap, whose group has at least min_chars characters."""

    kind: str
    pattern: str
    group: int
    min_chars: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


NAMES = "|".join(either_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
#: The base kinds in the order that reports list them.
BASE = (
    Rule("assign", rf"({NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of hex digits is one match whatever its length, so short runs need not be matched at all.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
#: Well-known token formats beside the base.
EXTRA = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
    Rule("pem", r"-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----", 0, 24),
)
RULES = BASE + EXTRA

FINDINGS = "array<struct<start:long,place:int,kind:string,end:long>>"


LEDGER = f"blob string, rule_keys array<string>, findings {FINDINGS}"


def hits(rule: Rule, place: int, text: str, matches: str) -> Column:
    """Lengths of the rule's matches in column text, of what lies before each, and of what must be long enough; column matches
    holds the matches.

    Spark has no function for the places of all matches. The pieces between them are what split() leaves,
    so a match starts after all earlier pieces and matches: a running sum of lengths, which spans_of() makes.
    """
    pieces = F.split(F.col(text), rule.pattern, -1)
    told = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), rule.group) if rule.group else F.col(matches)
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    steps = F.arrays_zip(F.slice(lengths(pieces), 1, F.size(matches)).alias("gap"), lengths(F.col(matches)).alias("len"), lengths(told).alias("told"))
    rows = F.transform(steps, lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["told"].alias("told")))
    return F.when(F.size(matches) > 0, rows).otherwise(F.array().cast("array<struct<place:int,i:int,gap:int,len:int,told:int>>"))


def spans_of(scanned: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule_keys, findings) from (blob, rule_keys, hits); the matches of one text are added up one by one."""
    none = scanned.filter(F.size("hits") == 0).select("blob", "rule_keys", F.array().cast(FINDINGS).alias("findings"))
    rows = scanned.filter(F.size("hits") > 0).select("blob", "rule_keys", F.inline("hits"))
    upto = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(upto))
    of = lambda what: F.element_at(F.array(*[F.lit(x) for x in what]), F.col("place") + 1)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), "place", of([r.kind for r in rules]).alias("kind"), "end")
    found = F.collect_list(F.when(F.col("told") >= of([r.min_chars for r in rules]), span))
    some = rows.groupBy("blob").agg(F.first("rule_keys").alias("rule_keys"), F.array_sort(found).cast(FINDINGS).alias("findings"))
    return none.unionByName(some)


def with_blob(docs: DataFrame) -> DataFrame:
    """docs with the content address of its text; a null text is the empty one."""
    return docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows of the ledger: (blob, rule_keys, findings), one per text that some rule version has not seen.

    docs: (text), one row per path or historical version. ledger: rows of earlier calls. Map-side
    aggregation keeps one text per blob and task before anything is shuffled, so copies cost nothing.
    """
    blobs = with_blob(docs.select(F.coalesce("text", F.lit("")).alias("text"))).groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", every)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rule_keys"))).alias("seen"))
        todo = (
            blobs.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
            .drop("seen")
            .filter(F.size("todo") > 0)
        )
    for r in rules:
        wanted = F.lit(True) if ledger is None else F.array_contains("todo", r.key)
        todo = todo.withColumn(f"m_{r.kind}", F.when(wanted, F.regexp_extract_all("text", F.lit(r.pattern), 0)).otherwise(F.array().cast("array<string>")))
    found = F.concat(*[hits(r, i, "text", f"m_{r.kind}") for i, r in enumerate(rules)])
    return spans_of(durable(todo.select("blob", F.col("todo").alias("rule_keys"), found.alias("hits"))), rules)


def ledger_at(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder, None if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def findings_of(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, findings) of the given rule versions; only blobs that have some."""
    now = F.array(*[F.lit(r.key) for r in rules])
    hits = ledger.filter((F.size("findings") > 0) & F.arrays_overlap("rule_keys", now))
    kinds = F.array_intersect("rule_keys", now)
    own = F.filter("findings", lambda f: F.exists(kinds, lambda k: F.split(k, "@")[0] == f["kind"]))
    return (
        hits.withColumn("own", own)
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("findings"))
        .filter(F.size("findings") > 0)
    )


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs with a column findings, the whole ledger).

    docs keeps all its rows and columns, apart from columns named blob or findings, which are replaced. findings is
    array<(start, place, kind, end)> in code points, sorted, empty where there is none. Null and empty texts
    have none, very long ones are scanned whole, repeated rows get the same findings, and an empty table gives no rows and an empty ledger.

    path: a folder that all machines see. The ledger is what lies there, and what this scan adds is appended to it as Parquet;
    without one, new rows are kept in the shared folder. Only pairs of a text and a rule version that the ledger lacks are scanned.
    """
    if path is not None:
        ledger = ledger_at(docs.sparkSession, path)
    fresh = scan_unseen(docs, ledger, rules)
    if path is not None:
        fresh.write.mode("append").parquet(path)
        whole = ledger_at(docs.sparkSession, path)
    else:
        fresh = stored(fresh, "ledger")
        whole = fresh if ledger is None else ledger.unionByName(fresh)
    # The repartitioned side is an exchange of its own, so that AQE can split a blob that very many paths share.
    hits = findings_of(whole, rules).withColumnRenamed("blob", "__blob").withColumnRenamed("findings", "__found")
    hits = durable(hits)
    paths = with_blob(docs.drop("blob", "findings"))
    joined = paths.join(hits.hint("merge"), F.col("blob") == F.col("__blob"), "left")
    return joined.withColumn("findings", F.coalesce("__found", F.array().cast(FINDINGS))).drop("__blob", "__found"), whole


def told(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redact(docs: DataFrame, mask: str = "[redacted]") -> DataFrame:
    """docs with a column findings: its spans, overlaps merged, are replaced by the mask in text.

    All rows and columns stay. A text without findings, null and empty ones among them, stays as it is; spans must lie within
    the text, in order. An empty table gives no rows.
    """
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def merge(spans: Column, f: Column) -> Column:
        last = F.element_at(spans, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"))
        own = F.struct(f["start"].alias("start"), f["end"].alias("end"))
        touching = (F.size(spans) > 0) & (f["start"] <= F.try_element_at(spans, F.lit(-1))["end"])
        grown = F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(F.coalesce(joined, own)))
        return F.when(touching, grown).otherwise(F.concat(spans, F.array(own))).cast("array<struct<start:long,end:long>>")

    merged = docs.withColumn("__spans", F.when(F.size("findings") > 0, F.aggregate("findings", empty, merge)))

    def put(so_far: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (so_far["at"] + 1).cast("int"), (s["start"] - so_far["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(so_far["out"], gap, F.lit(mask)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    tail = lambda x: F.concat(x["out"], F.substring(F.col("text"), (x["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return merged.withColumn("text", F.when(F.col("__spans").isNotNull(), F.aggregate("__spans", start, put, tail)).otherwise(F.col("text"))).drop("__spans")


def digest(scanned: DataFrame) -> DataFrame:
    """The report of a scan: counts of the base kinds, a hash of the base spans, all spans as text."""
    base = F.filter("findings", lambda f: f["place"] < len(BASE))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("findings")).alias("spans")
    )


def _oracle() -> str:
    def spans(place: int, rule: Rule) -> str:
        # One capture around the whole match: RE2 has no look-behind, and a greedy match starts a run anyway.
        pattern = rule.pattern.replace("(?<![0-9a-f])", "").replace("'", "''")
        return f"""SELECT blob, {place} AS place, '{rule.kind}' AS kind, i, length(pieces[i]) AS gap, length(whole[i]) AS len, length(told[i]) >= {rule.min_chars} AS kept
        FROM (SELECT blob, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {rule.group}) AS told,
                     string_split_regex(text, '{pattern}') AS pieces FROM blobs) t, range(1, len(whole) + 1) r(i)"""

    parts = "\n  UNION ALL ".join(spans(i, r) for i, r in enumerate(RULES))
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT blob, any_value(text) AS text FROM docs GROUP BY blob),
matches AS (
  {parts}),
spans AS (
  SELECT *, sum(gap + len) OVER (PARTITION BY blob, place ORDER BY i) AS stop FROM matches),
kept AS (SELECT blob, place, kind, (stop - len)::BIGINT AS start, stop::BIGINT AS stop FROM spans WHERE kept),
said AS (
  SELECT blob, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < {len(BASE)}) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM kept GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN said USING (blob)
"""


ORACLE = _oracle()
