"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every file is a path to a blob, named by the SHA-256 of its text.  The ledger notes which rule
versions a blob has been scanned with, so a new commit scans only pairs of blob and rule version that it has not seen,
and findings are joined back to all paths of a blob.  All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named

LEDGER_SCHEMA = "sha string, rules array<string>, hits array<struct<rule:string, gaps:array<int>, sizes:array<int>, secrets:array<int>>>"


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that holds the secret, and how many characters that has at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


# The base kinds, in this order.
BASE_RULES = [
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]+", least=24),
]
# What the ledger scans for beyond them.
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", least=27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", least=30),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}", least=40),
]
RULES = [*BASE_RULES, *MORE_RULES]


def _first_long(rule: Rule) -> str:
    """A pattern found in every text with a match of enough characters; cheaper, as short runs are not kept."""
    if rule.group == 0 and rule.pattern.endswith("]+"):
        return f"{rule.pattern[:-1]}{{{max(1, rule.least - len(rule.pattern.split('[')[0]))},}}"
    return rule.pattern


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The blobs scanned so far; an empty ledger if nothing has been written to ``path`` yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """``versions`` with the address of their content as ``sha``; a null text is the empty one."""
    return versions.withColumn("sha", F.sha2(F.coalesce(named(text).cast("string"), F.lit("")), 256))


def scan(versions: DataFrame, ledger: str, text: str = "text", rules: list[Rule] | None = None) -> None:
    """Append what is new in ``versions`` to the ledger: one row per blob with its rules and what they matched.

    Marks and matches are in one row and one commit, so a job that dies leaves nothing and is run again.  Copies of a
    text become one blob before the shuffle; null texts are empty blobs, repeated rows one blob, no rows add none.
    """
    rules = RULES if rules is None else rules
    spark = versions.sparkSession
    content = F.coalesce(named(text).cast("string"), F.lit(""))
    blobs = versions.select(F.sha2(content, 256).alias("sha"), content.alias("t"))
    blobs = blobs.groupBy("sha").agg(F.first("t").alias("t"))
    seen = read_ledger(spark, ledger).groupBy("sha").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    todo = F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen"))
    blobs = blobs.join(seen.hint("merge"), "sha", "left").select("sha", "t", todo.alias("todo")).filter(F.size("todo") > 0)

    def hits(r: Rule) -> Column:
        wanted = F.array_contains("todo", r.key) & F.col("t").rlike(_first_long(r))
        found = F.struct(
            F.lit(r.key).alias("rule"), _sizes(F.split("t", r.pattern, -1)).alias("gaps"),
            _sizes(F.regexp_extract_all("t", F.lit(r.pattern), F.lit(0))).alias("sizes"),
            _sizes(F.regexp_extract_all("t", F.lit(r.pattern), F.lit(r.group))).alias("secrets"))
        return F.when(wanted, found)

    found = F.filter(F.array(*[hits(r) for r in rules]), lambda h: h.isNotNull())
    blobs.select("sha", F.col("todo").alias("rules"), found.alias("hits")).write.mode("append").parquet(ledger)


def _sizes(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.length(x))


def findings(ledger: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(sha, kind, start, end) of the current rule versions, in code points, end exclusive; each once.

    A match starts after all gaps and matches before it: a running sum over the matches of one blob and rule.
    """
    rules = RULES if rules is None else rules
    kind, least = F.lit(None).cast("string"), F.lit(None).cast("int")
    for r in rules:
        kind = F.when(F.col("rule") == r.key, r.kind).otherwise(kind)
        least = F.when(F.col("rule") == r.key, r.least).otherwise(least)
    hit = ledger.select("sha", F.explode("hits").alias("h")).select("sha", "h.*")
    hit = hit.withColumn("kind", kind).withColumn("least", least).filter(F.col("kind").isNotNull())
    hit = hit.dropDuplicates(["sha", "rule"])
    parts = F.arrays_zip(F.slice("gaps", 1, F.size("sizes")).alias("gap"), F.col("sizes").alias("size"),
                         F.col("secrets").alias("secret"))
    each = hit.select("sha", "kind", "least", F.posexplode(parts).alias("pos", "m")).select("sha", "kind", "least", "pos", "m.*")
    before = Window.partitionBy("sha", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("size")).over(before)
    each = each.withColumn("end", end).filter(F.col("secret") >= F.col("least"))
    return each.select("sha", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _order(kind: Column, rules: list[Rule]) -> Column:
    return F.array_position(F.array(*[F.lit(r.kind) for r in rules]), kind)


def spans_by_path(versions: DataFrame, ledger: str, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``versions`` with ``secrets``: all spans of their blob as array<struct<start, rank, kind, end>>, in that order.

    A hot blob's paths are joined as (path, sha) rows, so no text moves for it twice; without findings the array is
    empty.  An own column ``secrets`` or ``sha`` is replaced.
    """
    rules = RULES if rules is None else rules
    found = findings(read_ledger(versions.sparkSession, ledger), rules)
    span = F.struct("start", _order(F.col("kind"), rules).alias("rank"), "kind", "end")
    by_blob = found.groupBy("sha").agg(F.sort_array(F.collect_list(span)).alias("secrets"))
    own = addressed(versions.drop("secrets"), text)
    joined = own.join(by_blob, "sha", "left")
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>")
    return joined.withColumn("secrets", F.coalesce("secrets", empty))


def joined_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    own = F.filter("secrets", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    return found.select(named(id), *counts, F.sha2(joined_spans(own), 256).alias("base_sha256"),
                        joined_spans(F.col("secrets")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover replaced by ``mask``; overlapping spans become one stretch."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(done, s):
        ahead = F.substring(text, done["at"].cast("int") + 1, F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        fresh = (s["start"] >= done["at"]) | (done["out"] == "")
        out = F.concat(done["out"], F.when(fresh, F.concat(ahead, F.lit(mask))).otherwise(F.lit("")))
        return F.struct(out.alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    def finish(done):
        return F.concat(done["out"], F.substring(text, done["at"].cast("int") + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def mask_secrets(docs: DataFrame, ledger: str, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Scan ``docs`` into the ledger and mask what is found, in the same columns; ``chars`` is counted anew."""
    scan(docs, ledger, text)
    packed = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), named(text).alias("text"))
    found = spans_by_path(packed, ledger).withColumn("text", masked(F.col("text"), F.col("secrets")))
    changed = F.size("secrets") > 0
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        new = {text: F.col("text"), chars: F.length("text").cast(docs.schema[c].dataType)}.get(c)
        out.append((old if new is None else F.when(changed, new).otherwise(old)).alias(c))
    return found.select(*out)


