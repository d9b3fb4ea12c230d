"""A stored code graph: parsed rows, nodes and label-checked edges in versions on shared storage.

A version is a folder; the file CURRENT names the one that readers see and is replaced last, so a failed write leaves the
version before. Parsed rows (entities and raw names) are kept beside the graph: an update parses the changed files only and
resolves names over all rows, which gives what a full index gives. Edges are partitioned by type and clustered by
repository and source, so a question reads the types and row groups it asks for and checks nothing again.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph, upsert_edges
from weftgraph.operators.dedup import duplicates
from weftgraph.parse.registry import parse_sources
from weftgraph.plans import pipeline, queries
from weftgraph.schema import EDGE, NODE_SCHEMAS


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """The version that readers see; -1 before the first."""
        fs, p = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(p):
            return -1
        stream = fs.open(p)
        try:
            return int(stream.readUTF())
        finally:
            stream.close()

    def _publish(self, version: int) -> None:
        fs, p = self._fs(f"{self.root}/CURRENT")
        stream = fs.create(p, True)
        stream.writeUTF(str(version))
        stream.close()
        # the version before stays for readers that still use it
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/v={version - 2}"), True)

    def _path(self, part: str, version: int | None = None) -> str:
        return f"{self.root}/v={self.version() if version is None else version}/{part}"

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self._path("rows"))

    def load(self) -> CodeGraph:
        """The stored graph; an empty one before the first version."""
        if self.version() < 0:
            return CodeGraph({k: self.spark.createDataFrame([], v) for k, v in NODE_SCHEMAS.items()}, self.spark.createDataFrame([], EDGE), checked=True)
        nodes = {label: self.spark.read.parquet(self._path(f"nodes/{label}")) for label in NODE_SCHEMAS}
        edges = self.spark.read.schema(EDGE).option("basePath", self._path("edges")).parquet(self._path("edges"))
        return CodeGraph(nodes, edges, checked=True)

    def write(self, graph: CodeGraph, rows: DataFrame, link_tests: bool = True) -> int:
        """Write ``graph`` as a new version: nodes with unique keys, edges whose ends exist, TESTS edges by name."""
        v = self.version() + 1
        for label in NODE_SCHEMAS:
            columns = [f.name for f in NODE_SCHEMAS[label].fields]
            df = graph.label(label).select(*columns).repartition("repo_id").sortWithinPartitions(*[c for c in ("repo_id", "id") if c in columns])
            df.write.mode("overwrite").parquet(self._path(f"nodes/{label}", v))
        stored = {label: self.spark.read.parquet(self._path(f"nodes/{label}", v)) for label in NODE_SCHEMAS}
        twice = [label for label, df in stored.items() if duplicates(df, ["repo_id", "id"] if label != "Repository" else ["repo_id"]).head(1)]
        if twice:
            raise ValueError(f"repeated keys of {', '.join(twice)}")
        fresh = replace(graph, nodes=stored, checked=False, _edges=None)
        edges = upsert_edges(fresh, self._kept(graph.raw_edges, "raw", v))
        if link_tests:
            checked = CodeGraph(stored, edges, checked=True)
            tests = queries.link_tests(checked).withColumn("rel_type", F.lit("TESTS"))
            known = edges.filter("rel_type = 'TESTS'").select("repo_id", "src_id", "dst_id")
            tests = tests.join(known, ["repo_id", "src_id", "dst_id"], "left_anti")
            edges = edges.unionByName(tests.select(*[(F.col(f.name) if f.name in tests.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGE.fields]))
        laid = edges.select(*[f.name for f in EDGE.fields]).repartition("rel_type", "repo_id").sortWithinPartitions("rel_type", "repo_id", "src_id")
        laid.write.mode("overwrite").partitionBy("rel_type").parquet(self._path("edges", v))
        self._kept(rows, "rows", v)
        self._fs(self._path("raw", v))[0].delete(self._fs(self._path("raw", v))[1], True)
        self._publish(v)
        return v

    def _kept(self, df: DataFrame, part: str, version: int) -> DataFrame:
        """``df`` written to a part of a version, so that plans on it start from a scan. Written already, it stays."""
        path = self._path(part, version)
        if not any(f.split(":", 1)[-1].lstrip("/").startswith(path.split(":", 1)[-1].lstrip("/") + "/") for f in df.inputFiles()[:1]):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def ingest(self, sources: DataFrame, repositories: DataFrame | None = None) -> int:
        """Parse ``sources`` (repo_id, path, source) and store their graph; repositories in them replace what is stored."""
        return self._ingest(sources, sources.select("repo_id").distinct(), ["repo_id"], repositories)

    def update(self, sources: DataFrame, changed: DataFrame) -> int:
        """Replace the files ``changed`` (repo_id, path) by what ``sources`` holds of them; files without a source are gone."""
        mine = sources.join(changed.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
        return self._ingest(mine, changed.select("repo_id", "path").distinct(), ["repo_id", "path"], None)

    def _ingest(self, sources: DataFrame, replaced: DataFrame, keys: list[str], repositories: DataFrame | None) -> int:
        v = self.version() + 1
        rows, files = self._kept(parse_sources(sources), "parsed", v), pipeline.files_of(sources)
        repos = repositories
        if self.version() >= 0:
            old = self.load()
            rows = self.rows().join(replaced, keys, "left_anti").unionByName(rows)
            files = old.files.join(replaced, keys, "left_anti").unionByName(files)
            kept = old.repositories
            if repos is not None:
                kept = kept.join(repos.select("repo_id"), "repo_id", "left_anti").unionByName(repos.select(*kept.columns))
            repos = kept.unionByName(pipeline.repositories_of(files).join(kept.select("repo_id"), "repo_id", "left_anti"))
            rows = self._kept(rows, "rows", v)
        return self.write(pipeline.build(self._kept(files, "files", v), rows, repos), rows)

    def _rewrite(self, keep: dict[str, DataFrame], rows: DataFrame | None = None) -> int:
        g = self.load()
        return self.write(replace(g, nodes={**g.nodes, **keep}, checked=False), self.rows() if rows is None else rows, link_tests=False)

    def remove_repository(self, repo_id: str) -> bool:
        """Remove a repository with everything in it; False if it is not stored. Other repositories stay as they are."""
        g = self.load()
        other = F.col("repo_id") != repo_id
        if not g.repositories.filter(~other).head(1):
            return False
        self._rewrite({k: v.filter(other) for k, v in g.nodes.items()}, self.rows().filter(other))
        return True

    clear_repository = remove_repository

    def delete_orphans(self, dry_run: bool = True) -> dict[str, int]:
        """Orphans per label; without ``dry_run`` they are deleted with their edges."""
        g = self.load()
        found = queries.orphans(g)
        counts = {"Function": 0, "Class": 0} | {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
        if not dry_run and sum(counts.values()):
            self._rewrite({label: g.label(label).join(found.filter(F.col("label") == label).select("repo_id", "id"), ["repo_id", "id"], "left_anti") for label in counts})
        return counts

    def rebuild_edges(self, types: tuple[str, ...] = ("CALLS", "EXTENDS", "IMPLEMENTS")) -> int:
        """Resolve the stored rows again and add the edges of ``types`` that are missing; returns their number."""
        g = self.load()
        fresh = pipeline.build(g.files, self.rows())
        wanted = upsert_edges(replace(fresh, nodes=g.nodes), fresh.raw_edges.filter(F.col("rel_type").isin(*types)), types)
        missing = wanted.join(g.rel(*types).select("repo_id", "rel_type", "src_id", "dst_id"), ["repo_id", "rel_type", "src_id", "dst_id"], "left_anti")
        n = missing.count()
        if n:
            self.write(replace(g, raw_edges=g.raw_edges.unionByName(missing.select(*g.raw_edges.columns)), checked=False), self.rows(), link_tests=False)
        return n
