"""References to records that do not exist: signed reference and existence counts per key.

A key is (repo_id, label, id), carried as two 64-bit hashes. ``Counts`` of a key are ``refs``, the references to it, and
``exists``, 1 while its latest record is alive. A batch of changed records gives deltas: +1 per new reference (-1 per
reference taken back, column ``sign``) and the latest state of each entity in it; applied to the kept counts, a state newer
than the kept one moves ``exists`` by +1, 0 or -1. Batches can come late, repeatedly (entities) and in any order, and a key
moves in and out of the report with them. Keys with refs > 0 and exists <= 0 lead nowhere.

Counts and states are pre-aggregated on the map side, so a key with a third of all references or records costs one row per
task; the references of such a key are spread by salt when the report's rows are looked up. Nulls: null ends are no
references; entities with a null id are no keys. Repeated references count each. Empty tables give empty reports.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import EDGE_LABELS

KEY = ["k1", "k2"]
#: Tasks over which the references of one key are spread.
SALT = 16


def _keys(repo: Column, label: Column, ident: Column) -> list[Column]:
    return [F.xxhash64(repo, label, ident).alias("k1"), F.xxhash64(ident, F.lit("|"), label, repo).alias("k2")]


def _label(side: int) -> Column:
    """Label that the type asks for at one end. Interfaces are rows of the class table."""
    pairs = {k: v[side].split("|")[0] for k, v in EDGE_LABELS.items()}
    return F.create_map(*[F.lit(x) for x in chain(*pairs.items())])[F.col("rel_type")]


def references(rels: DataFrame) -> DataFrame:
    """(k1, k2, rel_id, side, rel_type, created_at, sign): one row per non-null end. A repository's key is its own id."""
    ends = F.explode(F.array(
        F.struct(F.lit("source").alias("side"), _label(0).alias("label"), F.col("source_id").alias("id")),
        F.struct(F.lit("target").alias("side"), _label(1).alias("label"), F.col("target_id").alias("id")),
    ))
    sign = F.col("sign") if "sign" in rels.columns else F.lit(1)
    r = rels.select("repo_id", "rel_id", "rel_type", "created_at", sign.cast("bigint").alias("sign"), ends.alias("e")).filter("e.id is not null and e.label is not null")
    repo = F.when(F.col("e.label") == "Repository", F.col("e.id")).otherwise(F.col("repo_id"))
    return r.select(*_keys(repo, F.col("e.label"), F.col("e.id")), "rel_id", "e.side", "rel_type", "created_at", "sign")


def _states(records: DataFrame, label: str, key: str, at: Column, number: Column, gone: Column) -> DataFrame:
    """(k1, k2, refs, state): the latest version of each entity of a batch; of equal versions a deletion counts."""
    state = F.struct(at.cast("timestamp_ntz").alias("at"), number.cast("bigint").alias("number"), gone.cast("int").alias("gone"))
    return records.filter(F.col(key).isNotNull()).select(*_keys(F.col("repo_id"), F.lit(label), F.col(key)), F.lit(0).cast("bigint").alias("refs"), state.alias("state"))


def changes(rels: DataFrame, repositories: DataFrame, code_files: DataFrame, code_classes: DataFrame, code_functions: DataFrame) -> DataFrame:
    """(k1, k2, refs, state) of a batch of records of all tables, one row per key."""
    none, dead = F.lit(None), F.col("deleted_at").isNotNull()
    repos = _states(repositories.select("repo_id"), "Repository", "repo_id", none, none, F.lit(False))
    states = (
        repos.unionByName(_states(code_files, "File", "path", F.col("scanned_at"), F.col("scan_id"), F.coalesce("is_deleted", F.lit(False))))
        .unionByName(_states(code_classes, "Class", "id", F.col("parsed_at"), none, dead))
        .unionByName(_states(code_functions, "Function", "id", F.col("parsed_at"), none, dead))
    )
    refs = references(rels).select(*KEY, F.col("sign").alias("refs"), F.lit(None).cast(states.schema["state"].dataType).alias("state"))
    return refs.unionByName(states).groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.max("state").alias("state"))


def no_counts(batch: DataFrame) -> DataFrame:
    """The counts before any batch."""
    return batch.withColumn("exists", F.lit(0).cast("bigint")).limit(0)


def apply_changes(kept: DataFrame, batch: DataFrame) -> DataFrame:
    """Counts (k1, k2, refs, exists, state) after ``batch``: signed deltas of both counts added to those kept."""
    rows = kept.select(*KEY, "refs", "exists", "state", F.lit(0).cast("bigint").alias("new")).unionByName(batch.select(*KEY, F.lit(0).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("exists"), "state", F.col("refs").alias("new")))
    g = rows.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("new").alias("new"), F.sum("exists").alias("was"), F.max("state").alias("state"))
    delta = F.when(F.col("state").isNull(), 0).otherwise(1 - F.col("state.gone")) - F.col("was")
    return g.select(*KEY, (F.col("refs") + F.col("new")).alias("refs"), (F.col("was") + delta).cast("bigint").alias("exists"), "state")


def orphan_keys(counts: DataFrame) -> DataFrame:
    return counts.filter("refs > 0 and exists <= 0").select(*KEY)


def leading_to(keys: DataFrame, rels: DataFrame) -> DataFrame:
    """(rel_id, side, rel_type, created_at) of every reference to one of ``keys``; the references of one key are spread by salt."""
    refs = references(rels).withColumn("salt", F.pmod(F.xxhash64("rel_id"), F.lit(SALT)))
    spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    return refs.join(spread, [*KEY, "salt"], "left_semi").select("rel_id", "side", "rel_type", "created_at")


def dangling(rels: DataFrame, repositories: DataFrame, code_files: DataFrame, code_classes: DataFrame, code_functions: DataFrame) -> DataFrame:
    """(rel_id, side, rel_type, created_at) of every reference whose key is in the orphan report: all records as one batch."""
    batch = changes(rels, repositories, code_files, code_classes, code_functions)
    counts = batch.select(*KEY, "refs", F.when(F.col("state").isNull(), 0).otherwise(1 - F.col("state.gone")).alias("exists"))
    return leading_to(orphan_keys(counts), rels)


def dangling_counts(found: DataFrame) -> DataFrame:
    """Dangling references per rel_type, side and month of created_at (null months are kept)."""
    month = F.date_format("created_at", "yyyy-MM").alias("month")
    return found.groupBy("rel_type", "side", month).agg(F.count(F.lit(1)).alias("dangling"))
