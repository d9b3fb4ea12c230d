"""Processing only new or changed records: a ledger of processed sequence numbers as disjoint intervals.

A ledger row (block, lo, hi) says that all records whose sequence number lies in lo..hi were processed. Numbers run over all
repositories, so the ledger of a store that keeps up is a few intervals whatever its size; a number that has not been seen
is a gap, and a record that arrives late under it comes out of the next run. Numbers are cut into blocks, which spread
evenly over tasks however the records spread over repositories; intervals never cross a block. Subtracting the ledger from
the available records is one sweep per block: no range join, no pairs.

``IncrementalRun`` keeps such a ledger on shared storage and commits the intervals of a run together with its output.

Nulls: a record without a sequence number gets a negative one from its contents, so it is processed once as well. Repeated
records of one number are processed together. Empty tables give empty results. Extra columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sequence numbers per block.
BLOCK = 1 << 14

LEDGER = T.StructType([T.StructField("block", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())])


def block_of(number: Column) -> Column:
    return F.floor(number / BLOCK).cast("bigint")


def number_of(records: DataFrame, seq: str) -> Column:
    """The sequence number; for records without one a negative number from the contents."""
    return F.coalesce(F.col(seq).cast("bigint"), -1 - F.pmod(F.xxhash64(*records.columns), F.lit(1 << 62)))


def islands(numbers: DataFrame) -> DataFrame:
    """Ledger of the numbers in the first column: maximal runs of consecutive numbers within their blocks."""
    n = numbers.select(F.col(numbers.columns[0]).cast("bigint").alias("n")).filter("n is not null").distinct().withColumn("block", block_of(F.col("n")))
    run = F.col("n") - F.row_number().over(Window.partitionBy("block").orderBy("n"))
    return n.withColumn("run", run).groupBy("block", "run").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select("block", "lo", "hi")


def mark(records: DataFrame, ledger: DataFrame, seq: str) -> DataFrame:
    """``records`` with ``__number`` and ``__pending``: true if the number lies in no interval of the ledger.

    A record is processed if the interval that starts last at or before it ends at or after it; one sweep over the records
    and interval starts of a block finds it.
    """
    cols = [F.col(c) for c in records.columns]
    at = number_of(records, seq)
    a = records.select(F.struct(*cols).alias("__row"), block_of(at).alias("__block"), at.alias("__number"), F.lit(None).cast("bigint").alias("__hi"), F.lit(1).alias("__kind"))
    b = ledger.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col("block").alias("__block"), F.col("lo").alias("__number"), F.col("hi").alias("__hi"), F.lit(0).alias("__kind"))
    w = Window.partitionBy("__block").orderBy("__number", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b).withColumn("__to", F.last("__hi", ignorenulls=True).over(w)).filter("__kind = 1")
    return swept.select("__row.*", "__number", F.coalesce(F.col("__to") < F.col("__number"), F.lit(True)).alias("__pending"))


def merged(ledger: DataFrame) -> DataFrame:
    """The ledger with overlapping, touching and repeated intervals of a block merged."""
    w = Window.partitionBy("block").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0)
    g = ledger.distinct().withColumn("s", start).withColumn("g", F.sum("s").over(w))
    return g.groupBy("block", "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("block", "lo", "hi")


def _hex_number(h: Column) -> Column:
    """A content hash as a number: letter case, blanks, a 0x mark and leading zeros do not count."""
    return F.regexp_replace(F.lower(F.trim(h)), "^(0x)?0*", "")


def records_to_process(code_files: DataFrame) -> DataFrame:
    """File records that count: those with a content_hash or an is_deleted."""
    return code_files.filter(F.col("content_hash").isNotNull() | F.col("is_deleted").isNotNull())


def last_success(index_runs: DataFrame) -> DataFrame:
    return index_runs.filter("status = 'success'").groupBy("repo_id").agg(F.max("started_at").alias("since"))


def ledger_of_runs(code_files: DataFrame, index_runs: DataFrame) -> DataFrame:
    """The ledger that the runs so far left: of each repository, the records that had arrived when its last successful run
    started. Runs that failed, died or were aborted left nothing."""
    r = records_to_process(code_files)
    r = r.select("repo_id", "arrived_at", number_of(r, "scan_id").alias("n")).join(last_success(index_runs), "repo_id")
    return islands(r.filter("arrived_at <= since").select("n"))


def paths_to_process(code_files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(repo_id, path) that the next run must process, given the ledger.

    Pending records are the gaps of the ledger. Per path one aggregate with map-side combine gives the current record
    (greatest scanned_at, then scan_id, of all) and the seen record (of the processed ones); a path is a case if it has
    pending records, its current record is no deletion, and the seen record is missing, a deletion or of another content.
    """
    r = mark(records_to_process(code_files), ledger, "scan_id").select("repo_id", "path", "scan_id", "scanned_at", "content_hash", "is_deleted", "__pending")
    version = F.struct(F.col("scanned_at"), F.col("scan_id"), _hex_number(F.col("content_hash")).alias("hash"), F.coalesce("is_deleted", F.lit(False)).alias("gone"))
    g = r.groupBy("repo_id", "path").agg(F.max(version).alias("cur"), F.max(F.when(~F.col("__pending"), version)).alias("seen"), F.bool_or("__pending").alias("pending"))
    case = F.col("seen").isNull() | F.col("seen.gone") | (F.col("cur.hash") != F.col("seen.hash"))
    return g.filter(F.col("pending") & ~F.col("cur.gone") & case).select("repo_id", "path")


class Conflict(RuntimeError):
    """Another run committed first, time after time."""


class IncrementalRun:
    """Exactly-once runs over an append-only table: output and ledger of a run are committed together.

    ``root`` is a folder on shared storage. A run fixes its records first (``staged/run=ID``), so what arrives later belongs
    to the next run; output and ledger of the run are both made from these. Then the commit file ``commits/N`` is created,
    N being one more than the last commit the run had seen. Creating a file that must not exist is atomic on HDFS and local
    disks (on object stores, use a committer that gives the same), so of two runs that took the same gaps one commits and
    the other starts over from the new ledger. Without its commit file a run does not exist for any reader: a failure at any
    point neither skips nor repeats records.

    A run writes only its own intervals; every ``compact`` commits the merged ledger is written, and reading starts there.
    """

    def __init__(self, spark: SparkSession, root: str, seq: str = "scan_id", compact: int = 16, attempts: int = 5):
        self.spark, self.root, self.seq, self.compact, self.attempts = spark, root.rstrip("/"), seq, compact, attempts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def commits(self) -> list[dict]:
        """What was committed, in order: run, number, and whether its ledger holds all intervals so far."""
        fs, p = self._fs(f"{self.root}/commits")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return [{"number": int(n.split("-")[0]), "run": n.split("-", 1)[1].removesuffix("-all"), "whole": n.endswith("-all")} for n in self._entries(names)]

    def _entries(self, names: list[str]) -> list[str]:
        fs, _ = self._fs(self.root)
        out = []
        for n in names:
            if n.isdigit():
                stream = fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/{n}"))
                try:
                    out.append(f"{n}-{stream.readUTF()}")
                finally:
                    stream.close()
        return out

    def _claim(self, number: int, text: str) -> bool:
        """Create the commit file ``number``; False if it is there already. Its text is written to a file of its own first."""
        jvm = self.spark._jvm
        fs, p = self._fs(f"{self.root}/commits/{number:08d}")
        fs.mkdirs(p.getParent())
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.writeUTF(text)
        stream.close()
        if fs.getScheme() == "file":
            files, here = jvm.java.nio.file.Files, jvm.java.io.File(jvm.java.net.URI(fs.makeQualified(p).toString())).toPath()
            there = jvm.java.io.File(jvm.java.net.URI(fs.makeQualified(draft).toString())).toPath()
            try:
                files.createLink(here, there)  # atomic, fails if the name is taken
                return True
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
        return not fs.exists(p) and fs.rename(draft, p)

    def ledger(self) -> DataFrame:
        return self._ledger(self.commits())

    def _ledger(self, commits: list[dict]) -> DataFrame:
        last = max((i for i, c in enumerate(commits) if c["whole"]), default=0)
        runs = [c["run"] for c in commits[last:]]
        if not runs:
            return self.spark.createDataFrame([], LEDGER)
        return merged(self.spark.read.schema(LEDGER).parquet(*[f"{self.root}/ledger/run={r}" for r in runs]))

    def output(self) -> DataFrame | None:
        """The output of all committed runs."""
        runs = [c["run"] for c in self.commits()]
        return self.spark.read.parquet(*[f"{self.root}/output/run={r}" for r in runs]) if runs else None

    def pending(self, records: DataFrame) -> DataFrame:
        return self._pending(records, self.commits()).drop("__number")

    def _pending(self, records: DataFrame, commits: list[dict]) -> DataFrame:
        return mark(records, self._ledger(commits), self.seq).filter("__pending").drop("__pending")

    def run(self, records: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str:
        """Process the pending records with ``process`` and commit; returns the run's id."""
        for _ in range(self.attempts):
            commits = self.commits()
            run = uuid.uuid4().hex
            staged = f"{self.root}/staged/run={run}"
            self._pending(records, commits).write.parquet(staged)
            todo = self.spark.read.parquet(staged)
            process(todo.drop("__number")).write.parquet(f"{self.root}/output/run={run}")
            whole = (len(commits) + 1) % self.compact == 0
            mine = islands(todo.select("__number"))
            (merged(self._ledger(commits).unionByName(mine)) if whole else mine).write.parquet(f"{self.root}/ledger/run={run}")
            number = commits[-1]["number"] + 1 if commits else 0
            if self._claim(number, run + ("-all" if whole else "")):
                return run
        raise Conflict(f"{self.attempts} attempts, each time another run committed first")
