"""The property graph as DataFrames: node tables by label, one edge table, both keyed by repository."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.dedup import keep_first
from weftgraph.schema import EDGE_LABELS, NODE_SCHEMAS


@dataclass
class CodeGraph:
    """Nodes and edges of one or more repositories. All tables carry ``repo_id``; ids are unique per (repo_id, label)."""

    nodes: dict[str, DataFrame]
    raw_edges: DataFrame
    checked: bool = False
    _edges: DataFrame | None = field(default=None, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.raw_edges.sparkSession

    def label(self, name: str) -> DataFrame:
        if name not in self.nodes:
            return self.spark.createDataFrame([], NODE_SCHEMAS[name])
        return self.nodes[name]

    repositories = property(lambda self: self.label("Repository"))
    files = property(lambda self: self.label("File"))
    modules = property(lambda self: self.label("Module"))
    classes = property(lambda self: self.label("Class"))
    functions = property(lambda self: self.label("Function"))

    @property
    def edges(self) -> DataFrame:
        """Edges whose ends exist with the label that the type asks for, one per (type, source, target)."""
        if self.checked:
            return self.raw_edges
        if self._edges is None:
            self._edges = upsert_edges(self, self.raw_edges)
        return self._edges

    def rel(self, *types: str) -> DataFrame:
        """Edges of the given types; the filter reaches the scan."""
        if self.checked:
            return self.raw_edges.filter(F.col("rel_type").isin(*types))
        return upsert_edges(self, self.raw_edges.filter(F.col("rel_type").isin(*types)), types)

    def function_scope(self) -> DataFrame:
        """(repo_id, file_id, class_id, id): top-level functions of the repository's files and methods of their classes."""
        contained = self.rel("CONTAINS_FILE").select("repo_id", F.col("dst_id").alias("file_id"))
        top = self.rel("DEFINES_FUNCTION").select("repo_id", F.col("src_id").alias("file_id"), F.lit(None).cast("string").alias("class_id"), F.col("dst_id").alias("id"))
        owners = self.rel("DEFINES_CLASS").select("repo_id", F.col("src_id").alias("file_id"), F.col("dst_id").alias("class_id"))
        methods = self.rel("HAS_METHOD").select("repo_id", F.col("src_id").alias("class_id"), F.col("dst_id").alias("id"))
        member = owners.join(methods, ["repo_id", "class_id"]).select("repo_id", "file_id", "class_id", "id")
        return top.unionByName(member).join(contained, ["repo_id", "file_id"], "left_semi")


def keys_of(graph: CodeGraph, label: str) -> DataFrame:
    if "|" in label:
        known = [keys_of(graph, x) for x in label.split("|") if x in graph.nodes]
        return reduce(DataFrame.unionByName, known).distinct() if len(known) > 1 else known[0]
    df = graph.label(label)
    if label == "Repository":
        return df.select("repo_id", F.col("repo_id").alias("id")).distinct()
    return df.select("repo_id", "id")


def upsert_edges(graph: CodeGraph, records: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Label-checked edge upsert: last record wins per (repo_id, rel_type, src_id, dst_id); unknown types and ends that
    do not exist with the right label are dropped.

    Types that ask for the same pair of labels share two semi-joins, so the checks cost a join per label, not per type.
    Records may carry ``ordinal`` columns (created_at, rel_id) for the order; without them any record of a key is kept.
    """
    order = [F.col(c).desc_nulls_last() for c in ("created_at", "rel_id", "ordinal") if c in records.columns]
    known = [t for t in (types or EDGE_LABELS) if t in EDGE_LABELS]
    records = records.filter(F.col("rel_type").isin(*known)) if types is None else records
    latest = keep_first(records, ["repo_id", "rel_type", "src_id", "dst_id"], order or [F.lit(1)])
    groups: dict[tuple[str, str], list[str]] = {}
    for t in known:
        groups.setdefault(EDGE_LABELS[t], []).append(t)
    parts = []
    for (src, dst), names in groups.items():
        part = latest.filter(F.col("rel_type").isin(*names))
        part = part.join(keys_of(graph, src).withColumnRenamed("id", "src_id"), ["repo_id", "src_id"], "left_semi")
        part = part.join(keys_of(graph, dst).withColumnRenamed("id", "dst_id"), ["repo_id", "dst_id"], "left_semi")
        parts.append(part.select(*records.columns))
    return reduce(DataFrame.unionByName, parts)
