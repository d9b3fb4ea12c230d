"""Loader of a code graph from record tables (append-only logs with repeated, outdated and deleted records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators.dedup import keep_first


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_files(code_files: DataFrame) -> DataFrame:
    """The latest record of each (repo_id, path) by (scanned_at, scan_id), if it is not a deletion."""
    latest = keep_first(code_files, ["repo_id", "path"], [F.col("scanned_at").desc_nulls_last(), F.col("scan_id").desc_nulls_last()])
    return latest.filter(~F.coalesce("is_deleted", F.lit(False)))


def live_entities(records: DataFrame) -> DataFrame:
    """The latest record of each (repo_id, id) by parsed_at, if it has no deleted_at."""
    latest = keep_first(records, ["repo_id", "id"], [F.col("parsed_at").desc_nulls_last(), F.col("deleted_at").desc_nulls_last()])
    return latest.filter(F.col("deleted_at").isNull()).drop("deleted_at")


def current_repositories(repositories: DataFrame) -> DataFrame:
    return keep_first(repositories, ["repo_id"], [F.col("last_indexed").desc_nulls_last(), F.col("description").asc_nulls_last()])


def modules_of(files: DataFrame) -> DataFrame:
    """Package of each directory that holds a file: dotted path of the directory, root files have none."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return (
        files.select("repo_id", folder.alias("path")).filter("path <> ''").distinct()
        .select("repo_id", F.translate("path", "/", ".").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.lit("package").alias("module_type"))
    )


def load_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph of the record tables. Nothing runs here; every query prunes the columns and edge types it needs."""
    files = current_files(table(spark, sf_dir, "code_files"))
    nodes = {
        "Repository": current_repositories(table(spark, sf_dir, "repositories")),
        "File": files,
        "Module": modules_of(files),
        "Class": live_entities(table(spark, sf_dir, "code_classes")),
        "Function": live_entities(table(spark, sf_dir, "code_functions")),
    }
    edges = table(spark, sf_dir, "code_relationships").withColumnsRenamed({"source_id": "src_id", "target_id": "dst_id"})
    return CodeGraph(nodes, edges)
