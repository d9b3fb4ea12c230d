"""Registered queries: name -> (spark, data folder) -> DataFrame. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import inverted_index
from weftgraph.operators import hierarchy, intervals, references, resolve
from weftgraph.operators.dedup import duplicates, replace_files
from weftgraph.operators.ranking import top_k
from weftgraph.parse.registry import parse_sources
from weftgraph.plans import pipeline
from weftgraph.plans import queries as q
from weftgraph.plans.sql import ORACLE
from weftgraph.session import cut
from weftgraph.sources.tables import current_files, live_entities, load_graph, modules_of, table

Query = Callable[[SparkSession, str], DataFrame]


def _graph(plan: Callable[..., DataFrame], **kw: object) -> Query:
    return lambda spark, d: plan(load_graph(spark, d), **kw)


def _every(plan: Callable[..., DataFrame], **kw: object) -> Query:
    """Plans that start from functions: from every function."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g = load_graph(spark, d)
        return plan(g, g.functions.select("repo_id", "id").distinct(), **kw)

    return run


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return live_entities(table(spark, d, "code_classes"))


def file_scan_metadata(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "file_sources").select("repo_id", "path", "source").distinct()
    return s.select(
        "repo_id", "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"\.[^./]*$", 0).alias("suffix"),
        F.size(F.split("source", "\n")).alias("lines"), F.md5(F.col("source").cast("binary")).alias("hash"),
    )


def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "file_sources").select("repo_id", "path", F.md5(F.col("source").cast("binary")).alias("hash")).distinct()
    return s.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.min(F.concat("repo_id", F.lit("/"), "path")).alias("first_path")).filter("copies > 1")


def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """The File table of 1 May 2025 with the files changed since then replaced."""
    log = table(spark, d, "code_files").select("repo_id", "path", "content_hash", "scanned_at", "scan_id", "arrived_at", "is_deleted")
    since = F.lit("2025-05-01").cast("timestamp_ntz")
    changed = log.filter(F.col("arrived_at") >= since).select("repo_id", "path").distinct()
    new = current_files(log.join(changed, ["repo_id", "path"], "left_semi"))
    return replace_files(current_files(log.filter(F.col("arrived_at") < since)), new, changed).select("repo_id", "path", "content_hash")


def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "code_relationships").filter("rel_type = 'CALLS'").select(
        "repo_id", F.col("source_id").alias("src_id"), F.element_at(F.split("target_id", ":"), -1).alias("name"),
        F.expr("try_cast(regexp_extract(line_numbers, '[0-9]+', 0) as int)").alias("line"),
    )
    return resolve.calls(sites, live_entities(table(spark, d, "code_functions")))


def fulltext_index(spark: SparkSession, d: str) -> DataFrame:
    ix = inverted_index(_classes(spark, d).select("repo_id", "id", "docstring"), ["repo_id", "id"], "docstring")
    return ix.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("bigint").alias("tf"))


def search_vector(spark: SparkSession, d: str) -> DataFrame:
    """The scores of all vectors for each query: the rows whose vec_id is divisible by 20."""
    v = table(spark, d, "embeddings")
    return q.search_vectors(v, v.filter("vec_id % 20 = 0")).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def search_vector_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each query, by the rounded score, ties by vec_id."""
    return top_k(search_vector(spark, d), [F.col("score").desc(), F.col("vec_id")], 10, ["query_id"])


#: name -> (query it limits, order, rows, groups). A leading minus sorts down; the orders end with a key.
TOPS: dict[str, tuple[str, list[str], int, list[str]]] = {
    "callers_top": ("callers", ["id"], 20, ["repo_id", "function_id"]),
    "similar_top": ("similar_functions", ["-similarity", "id"], 5, ["repo_id", "function_id"]),
    "impact_top": ("impact", ["distance", "name", "id"], 50, ["repo_id", "function_id"]),
    "dead_code_top": ("dead_code", ["name", "id"], 50, ["repo_id"]),
    "dead_code_top_global": ("dead_code_global", ["name", "repo_id", "id"], 50, []),
    "entry_points_top": ("entry_points", ["name", "id"], 20, ["repo_id"]),
    "high_complexity_top": ("high_complexity", ["-complexity", "id"], 10, ["repo_id"]),
    "hotspots_top": ("hotspots", ["-totalCoupling", "id"], 20, ["repo_id"]),
    "cycles_top": ("cycles", ["cycle_length", "cycle"], 20, ["repo_id"]),
    "file_search_top": ("file_search", ["id"], 10, ["repo_id"]),
    "search_fulltext_top": ("search_fulltext", ["-score", "id"], 10, ["repo_id"]),
    "search_fulltext_classes_top": ("search_fulltext_classes", ["-score", "id"], 10, ["repo_id"]),
    "search_substring_top": ("search_substring", ["branch", "id"], 20, ["repo_id"]),
    "integrity_top": ("integrity", ["source", "target_node_id"], 100, ["repo_id", "rel"]),
    "list_repositories_ordered": ("list_repositories", ["id"], 200, []),
}


def _top(name: str) -> Query:
    base, order, rows, per = TOPS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        columns = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in order]
        return top_k(QUERIES[base](spark, d), columns, rows, per)

    return run


def class_details(spark: SparkSession, d: str) -> DataFrame:
    return q.class_details(load_graph(spark, d))


def parsed_functions(spark: SparkSession, d: str) -> DataFrame:
    """Python and Go functions as the parsers find them in the sources of which there are records."""
    rows = parse_sources(table(spark, d, "file_sources"))
    f = pipeline.entities(rows, "Function").filter(F.col("path").rlike(r"\.(?:py|pyw|go)$"))
    known = live_entities(table(spark, d, "code_functions")).select("repo_id", "id")
    return f.join(known, ["repo_id", "id"], "left_semi").select("repo_id", "id", "name", "start_line", "end_line", "is_async")


def parsed_classes(spark: SparkSession, d: str) -> DataFrame:
    """Python classes with their bases as the parser finds them in the sources of which there are records."""
    c = pipeline.entities(parse_sources(table(spark, d, "file_sources")), "Class").filter(F.col("path").rlike(r"\.pyw?$"))
    known = live_entities(table(spark, d, "code_classes")).select("repo_id", "id")
    return c.join(known, ["repo_id", "id"], "left_semi").select("repo_id", "id", "name", "start_line", "end_line")


def parsed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every kind that a full parse of the sources gives, per repository."""
    return parse_sources(table(spark, d, "file_sources")).groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def parsed_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edge table of a full parse: structure, resolved names and detected relationships."""
    sources = table(spark, d, "file_sources")
    rows = cut(parse_sources(sources))
    return pipeline.build(cut(pipeline.files_of(sources)), rows).raw_edges.select("repo_id", "rel_type", "src_id", "dst_id", "confidence", "detection_method")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files, runs = table(spark, d, "code_files"), table(spark, d, "index_runs")
    return intervals.paths_to_process(files, intervals.ledger_of_runs(files, runs))


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    return intervals.ledger_of_runs(table(spark, d, "code_files"), table(spark, d, "index_runs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.on_cycle(hierarchy.parent_links(_classes(spark, d))).select("repo_id", F.col("id").alias("class_id"))


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    return references.dangling(*[table(spark, d, n) for n in ("code_relationships", "repositories", "code_files", "code_classes", "code_functions")])


def p4_delta(spark: SparkSession, d: str) -> DataFrame:
    """The same report from kept counts: the records up to April 2025 as a first batch, the later ones as a delta on its counts."""
    cut_at = F.lit("2025-04-01").cast("timestamp_ntz")
    tables = [(table(spark, d, n), at) for n, at in (("code_relationships", "created_at"), ("repositories", None), ("code_files", "arrived_at"), ("code_classes", "parsed_at"), ("code_functions", "parsed_at"))]
    first = references.changes(*[t if at is None else t.filter(F.col(at) < cut_at) for t, at in tables])
    later = references.changes(*[t.limit(0) if at is None else t.filter((F.col(at) >= cut_at) | F.col(at).isNull()) for t, at in tables])
    counts = references.apply_changes(references.apply_changes(references.no_counts(first), first), later)
    return references.leading_to(references.orphan_keys(counts), tables[0][0]).select("rel_id", "side")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select("rel_id", "side")


QUERIES: dict[str, Query] = {
    "impact": _every(q.change_impact, max_depth=3),
    "call_graph": _every(q.call_graph, depth=2),
    "similar_functions": _every(q.similar_functions),
    "callers": _graph(q.callers),
    "cycles": _graph(q.circular_dependencies),
    "dep_cycles": _graph(q.circular_dependencies, rel_type="DEPENDS_ON"),
    "function_by_name": _graph(q.function_by_name),
    "class_by_name": _graph(q.class_by_name),
    "class_hierarchy": _graph(q.class_hierarchy),
    "file_deps": _graph(q.file_dependencies),
    "code_context": _graph(q.code_context),
    "search_substring": _graph(q.search_substring, text="merge"),
    "search_fulltext": _graph(q.search_fulltext, query="cache the index and the buffer"),
    "search_fulltext_classes": _graph(q.search_fulltext, query="cache the index and the buffer", label="Class"),
    "search_vector": search_vector,
    "search_vector_top": search_vector_top,
    "class_details": class_details,
    "parsed_functions": parsed_functions,
    "parsed_classes": parsed_classes,
    "parsed_counts": parsed_counts,
    "parsed_edges": parsed_edges,
    "file_search": _graph(q.file_search, text="handler"),
    "list_repositories": _graph(q.list_repositories),
    "graph_stats": _graph(q.graph_stats),
    "label_counts": _graph(q.label_counts),
    "dead_code": _graph(q.dead_code),
    "dead_code_global": _graph(q.dead_code, scoped=False),
    "entry_points": _graph(q.entry_points),
    "entry_points_global": _graph(q.entry_points, scoped=False),
    "high_complexity": _graph(q.high_complexity),
    "high_complexity_global": _graph(q.high_complexity, scoped=False),
    "hotspots": _graph(q.hotspots),
    "tests_for_function": _graph(q.tests_of),
    "tests_link": _graph(q.link_tests),
    "orphans": _graph(q.orphans),
    "integrity": _graph(q.integrity),
    "language_histogram": _graph(q.language_histogram),
    "classes_many_methods": _graph(q.classes_with_many_methods, more_than=2),
    "implementations": _graph(q.implementations),
    "staleness": lambda s, d: q.staleness(load_graph(s, d), now=F.lit("2025-07-01 00:00:00")),
    "resources": _graph(q.resources),
    "edge_upsert": lambda s, d: load_graph(s, d).edges.select("repo_id", "rel_type", "src_id", "dst_id", "rel_id"),
    "merge_last_wins": lambda s, d: live_entities(table(s, d, "code_functions").select("repo_id", "id", "name", "signature", "complexity", "parsed_at", "deleted_at")).drop("parsed_at"),
    "modules": lambda s, d: modules_of(current_files(table(s, d, "code_files"))),
    "resolve_extends": lambda s, d: resolve.extends(_classes(s, d)),
    "resolve_implements": lambda s, d: resolve.implements(_classes(s, d)),
    "resolve_calls": resolve_calls,
    "incremental_merge": incremental_merge,
    "file_scan_metadata": file_scan_metadata,
    "duplicate_files": duplicate_files,
    "unique_keys": lambda s, d: duplicates(table(s, d, "code_classes").select("repo_id", "id", F.lit("Class").alias("label")).unionByName(table(s, d, "code_functions").select("repo_id", "id", F.lit("Function").alias("label"))).unionByName(table(s, d, "code_files").select("repo_id", F.col("path").alias("id"), F.lit("File").alias("label"))), ["label", "repo_id", "id"]),
    "fulltext_index": fulltext_index,
    "p1_found": p1_found,
    "p1_ledger": p1_ledger,
    "p3_found": p3_found,
    "p3_hierarchy": lambda s, d: hierarchy.hierarchy(_classes(s, d)),
    "p3_descendants": lambda s, d: hierarchy.descendants(_classes(s, d)),
    "p4_found": p4_found,
    "p4_delta": p4_delta,
    "p4_counts": lambda s, d: references.dangling_counts(_dangling(s, d)),
}


QUERIES |= {name: _top(name) for name in TOPS}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES} | {k: _ranked(ORACLE[base], order, rows, per) for k, (base, order, rows, per) in TOPS.items() if base in ORACLE}


def _ranked(sql: str, order: list[str], rows: int, per: list[str]) -> str:
    by = ", ".join(f'"{c[1:]}" DESC NULLS LAST' if c[0] == "-" else f'"{c}" NULLS LAST' for c in order)
    over = f"PARTITION BY {', '.join(per)} " if per else ""
    return f"SELECT * FROM (SELECT t.*, CAST(row_number() OVER ({over}ORDER BY {by}) AS INTEGER) AS rank FROM ({sql}) t) WHERE rank <= {rows}"


