"""Secret scans by an incremental ledger of blobs.

Every version of every text is addressed by the SHA-256 of its content. The ledger notes which blobs were scanned by
which versions of which rules, with the spans found: a scan takes each unseen pair of blob and rule version once,
however many paths and versions hold the blob, and a report joins the findings back to all of them. Where a rule gets a
new version, or a new one is added, only that rule runs over the known blobs.

A batch of the ledger is a folder of its own, which counts once it is complete, so a scan that dies leaves nothing behind.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.llm.common import spread_join, stash

_SPANS = "array<struct<start:int,rule:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` (0: the whole match) has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def tag(self) -> str:
        return f"{self.kind}:{self.version}"


#: The base kinds. A run that is too short holds no longer one, so two patterns ask for the length at once.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Kinds that are added: access tokens of a code host, and private keys in their text form.
RULES = (*BASE, Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}"), Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"))


def address(text: Column) -> Column:
    """The blob of a text: SHA-256 of its UTF-8 bytes; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class Ledger:
    """Batches under ``path``, a folder that all executors share: (blob, tags scanned, spans as (start, tag, end))."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def batches(self) -> list[str]:
        """Complete batches; the listing has one entry a scan."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [str(x.getPath()) for x in fs.listStatus(top)]
        return sorted(x for x in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{x}/_SUCCESS")))

    def rows(self) -> DataFrame:
        schema = "blob string, tags array<string>, spans array<struct<start:int,tag:string,end:int>>"
        found = self.batches()
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def append(self, rows: DataFrame) -> str:
        path = f"{self.path}/batch-{len(self.batches()):06d}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path


def _lengths(text: Column, rule: Rule) -> Column:
    """(gap before, match, tested group) lengths of a text's matches, by splitting it at them; null without a match.

    Matches and gaps come from the same pattern over the same text, so they alternate."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"), F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("tested"))
    return F.when(text.rlike(rule.pattern), parts)


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> str | None:
    """Scan what the ledger has not: the new batch's folder, or None where there is no row.

    Texts are put together by blob with partial sums first, so copies, also a third of all rows, cross the network
    once a task; only blobs that lack a rule are scanned, and only by that rule.

    Defined cases: a null text is the empty blob; other columns are not read; an empty table adds no batch.
    """
    base = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blobs = base.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*(F.lit(r.tag) for r in rules))
    if ledger.batches():
        done = ledger.rows().select("blob", F.explode("tags").alias("tag")).groupBy("blob").agg(F.collect_set("tag").alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn("tags", F.array_except(every, F.coalesce("done", F.expr("cast(array() as array<string>)")))).where(F.size("tags") > 0)
    else:
        todo = blobs.withColumn("tags", every)
    hits = [F.when(F.array_contains("tags", r.tag), _lengths(F.col("text"), r)).alias(f"r{i}") for i, r in enumerate(rules)]
    seen = stash(todo.select("blob", "tags", *hits), "secret-hits")
    if seen.isEmpty():
        return None
    parts = []
    for i, r in enumerate(rules):
        cells = seen.where(F.col(f"r{i}").isNotNull()).select("blob", F.posexplode(f"r{i}").alias("at", "cell")).where("cell.size IS NOT NULL")
        parts.append(cells.select("blob", F.lit(r.tag).alias("tag"), F.lit(r.least).alias("least"), "at", "cell.gap", "cell.size", "cell.tested"))
    # Only matches are summed up along a text: a text with very many costs a sort, not a square.
    upto = Window.partitionBy("blob", "tag").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = reduce(DataFrame.unionByName, parts).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
    found = ends.where("tested >= least").groupBy("blob").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("size")).cast("int").alias("start"), "tag", "end"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:int,tag:string,end:int>>)")
    return ledger.append(seen.select("blob", "tags").join(found, "blob", "left").select("blob", "tags", F.coalesce("spans", none).alias("spans")))


def report(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, blob, spans) for each row of ``versions``: spans as (start, rule's place in ``rules``, end) in code points, end exclusive, by start and rule.

    Findings of other versions of a rule are left out. A blob with a third of all rows is dealt over tasks.

    Defined cases: null and repeated keys are rows like any other; a blob that was not scanned has no spans.
    """
    place = F.element_at(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.tag), F.lit(i)))), F.col("span.tag"))
    spans = ledger.rows().select("blob", F.explode("spans").alias("span")).select("blob", F.struct(F.col("span.start").alias("start"), place.alias("rule"), F.col("span.end").alias("end")).alias("span")).where("span.rule IS NOT NULL")
    by_blob = spans.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    rows = versions.select(F.col(key).alias("key"), address(F.col(text)).alias("blob"))
    return spread_join(rows, by_blob, "blob").select(F.col("key").alias(key), "blob", F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"))
