"""From sources to the graph: parse, entity tables, name resolution, detected relationships."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.graph import CodeGraph
from weftgraph.operators import resolve
from weftgraph.operators.dedup import keep_first
from weftgraph.schema import CLASS, EDGE, FUNCTION, IMPORT, INTERFACE, REPOSITORY, VARIABLE, D, I, S, struct
from weftgraph.sources.repository import with_facts
from weftgraph.sources.tables import modules_of

_ENTITY = {"Class": CLASS, "Function": FUNCTION, "Variable": VARIABLE, "Import": IMPORT, "Interface": INTERFACE}
_CALL, _USE = struct(src_id=S, name=S, line=I), struct(src_id=S, name=S)
_DETECTED = struct(src_name=S, dst_name=S, rel_type=S, confidence=D, detection_method=S, context=S, line=I)


def _payloads(rows: DataFrame, kind: str, schema: T.StructType) -> DataFrame:
    """The rows of one kind as columns; repo_id and path come from the row."""
    own = T.StructType([f for f in schema.fields if f.name not in ("repo_id", "path")])
    r = rows.filter(F.col("kind") == kind).select("repo_id", "path", "ordinal", F.from_json("payload", own).alias("p"))
    return r.select("repo_id", "path", "ordinal", "p.*")


def entities(rows: DataFrame, label: str) -> DataFrame:
    """Nodes of one label; the last record of an id in a file wins."""
    nodes = keep_first(_payloads(rows, label, _ENTITY[label]), ["repo_id", "id"], [F.col("path").desc(), F.col("ordinal").desc()])
    return nodes.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _ENTITY[label].fields])


def _edges(df: DataFrame, rel_type: str | None = None) -> DataFrame:
    """``df`` in the shape of the edge table."""
    if rel_type:
        df = df.withColumn("rel_type", F.lit(rel_type))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGE.fields])


def files_of(sources: DataFrame) -> DataFrame:
    """File nodes of ``sources`` (repo_id, path, source), one per path."""
    one = sources.select("repo_id", "path", "source").filter("path is not null and source is not null").groupBy("repo_id", "path").agg(F.max("source").alias("source"))
    return with_facts(one).select("repo_id", F.col("path").alias("id"), "name", "path", "extension", "language", "lines_of_code", "content_hash")


def repositories_of(files: DataFrame) -> DataFrame:
    """Repository nodes of the files' repositories, where nothing else is known of them."""
    no = F.lit(None).cast("string")
    return files.select("repo_id").distinct().select("repo_id", F.col("repo_id").alias("name"), no.alias("path"), F.lit("multi").alias("language"), no.alias("description"), F.lit(None).cast("timestamp").alias("last_indexed"))


def build(files: DataFrame, rows: DataFrame, repositories: DataFrame | None = None) -> CodeGraph:
    """The graph of parsed ``rows`` and their ``files``.

    Names are resolved over all rows of a repository by joins, so after a change only the changed files are parsed again and
    the result is that of a full parse.
    """
    nodes = {label: entities(rows, label) for label in _ENTITY}
    nodes["File"], nodes["Module"] = files, modules_of(files)
    repositories = repositories_of(files) if repositories is None else repositories
    nodes["Repository"] = repositories.select(*[f.name for f in REPOSITORY.fields])
    classes, functions = nodes["Class"], nodes["Function"]
    known_classes = classes.select("repo_id", "id", "name", "path", "start_line")
    known_functions = functions.select("repo_id", "id", "name", "path", "start_line")
    own = _payloads(rows, "Edge", struct(rel_type=S, src_id=S, dst_id=S, visibility=S))
    modules = nodes["Module"].select("repo_id", F.col("id").alias("dst_id"), F.col("path").alias("folder"))
    placed = files.select("repo_id", F.col("path").alias("src_id"), F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).join(modules, ["repo_id", "folder"])
    names = resolve.class_by_name(known_classes)
    wanted = classes.select("repo_id", F.col("id").alias("src_id"), F.explode("base_classes").alias("name"))
    faces = keep_first(nodes["Interface"].select("repo_id", "name", F.col("id").alias("face")), ["repo_id", "name"], [F.col("face").desc()])
    written = classes.select("repo_id", F.col("id").alias("src_id"), F.explode("interfaces").alias("name"))
    written = written.unionByName(_payloads(rows, "Implements", struct(src_id=S, name=S)).select("repo_id", "src_id", "name"))
    implemented = written.join(faces, ["repo_id", "name"], "left").join(names, ["repo_id", "name"], "left").select("repo_id", "src_id", F.coalesce("face", "id").alias("dst_id")).filter("dst_id is not null")
    imports = resolve.file_imports(nodes["Import"], files)
    parts = [
        _edges(own),
        _edges(files.select("repo_id", F.col("repo_id").alias("src_id"), F.col("id").alias("dst_id")), "CONTAINS_FILE"),
        _edges(nodes["Module"].select("repo_id", F.col("repo_id").alias("src_id"), F.col("id").alias("dst_id")), "CONTAINS_MODULE"),
        _edges(placed, "BELONGS_TO_MODULE"),
        _edges(wanted.join(names, ["repo_id", "name"]).select("repo_id", "src_id", F.col("id").alias("dst_id")), "EXTENDS"),
        _edges(implemented, "IMPLEMENTS"),
        _edges(resolve.calls(_payloads(rows, "Call", _CALL), known_functions), "CALLS"),
        _edges(resolve.uses_class(_payloads(rows, "Use", _USE), known_classes), "USES_CLASS"),
        _edges(imports, "IMPORTS_FROM"),
        _edges(imports.drop("symbols").withColumn("dependency_type", F.lit("import")), "DEPENDS_ON"),
    ]
    named = reduce(DataFrame.unionByName, parts)
    found = resolve.detected(_payloads(rows, "Detected", _DETECTED), named, known_functions, known_classes)
    edges = named.unionByName(_edges(found)).filter("src_id is not null and dst_id is not null")
    return CodeGraph(nodes, keep_first(edges, ["repo_id", "rel_type", "src_id", "dst_id"], [F.col("confidence").asc_nulls_first(), F.col("line_numbers").desc_nulls_last()]))


def failures(rows: DataFrame) -> DataFrame:
    """(repo_id, path, error) of files that their parser could not take."""
    return rows.filter("kind = 'Failed'").select("repo_id", "path", F.get_json_object("payload", "$.error").alias("error"))
