"""Name resolution as joins: raw names written in the source against entities of the same repository.

First and last are taken by (path, start_line, id), the order in which a sorted walk meets the entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.dedup import keep_first


def _order(desc: bool, columns: list[str]) -> list[Column]:
    names = [c for c in ("path", "start_line", "id") if c in columns]
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c in names]


def class_by_name(classes: DataFrame) -> DataFrame:
    """(repo_id, name, id): the last class of each exact name; a qualified ``a::B`` also answers to ``B`` unless that exists."""
    exact = classes.select("repo_id", "name", "id", "path", "start_line", F.lit(0).alias("short"))
    short = exact.filter(F.col("name").contains("::")).withColumn("name", F.element_at(F.split("name", "::"), -1)).withColumn("short", F.lit(1))
    both = exact.unionByName(short)
    return keep_first(both, ["repo_id", "name"], [F.col("short"), *_order(True, both.columns)]).select("repo_id", "name", "id")


def function_by_name(functions: DataFrame) -> DataFrame:
    """(repo_id, name, id): the first function of each name."""
    return keep_first(functions.select("repo_id", "name", "id", "path", "start_line"), ["repo_id", "name"], _order(False, ["path", "start_line", "id"])).select("repo_id", "name", "id")


def extends(classes: DataFrame) -> DataFrame:
    """EXTENDS by exact base name."""
    base = classes.select("repo_id", F.col("id").alias("src_id"), F.explode("base_classes").alias("name"))
    return base.join(class_by_name(classes), ["repo_id", "name"]).select("repo_id", "src_id", F.col("id").alias("dst_id")).distinct()


def implements(classes: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """IMPLEMENTS by name: an interface of the name (the last), else a class; unresolved names give no edge."""
    want = classes.select("repo_id", F.col("id").alias("src_id"), F.explode("interfaces").alias("name"))
    source = classes.filter("language_type = 'interface'") if interfaces is None else interfaces.withColumn("start_line", F.lit(0))
    faces = keep_first(source.select("repo_id", "name", "id", "path", "start_line"), ["repo_id", "name"], _order(True, ["path", "start_line", "id"])).select("repo_id", "name", F.col("id").alias("face"))
    got = want.join(faces, ["repo_id", "name"], "left").join(class_by_name(classes), ["repo_id", "name"], "left")
    dst = F.coalesce("face", "id")
    return got.select("repo_id", "src_id", dst.alias("dst_id")).filter("dst_id is not null").distinct()


def calls(call_sites: DataFrame, functions: DataFrame) -> DataFrame:
    """CALLS from sites (repo_id, src_id, name, line) to the first function of the name anywhere in the repository."""
    hit = call_sites.join(function_by_name(functions), ["repo_id", "name"])
    return hit.groupBy("repo_id", "src_id", F.col("id").alias("dst_id")).agg(F.concat(F.lit("["), F.max("line").cast("string"), F.lit("]")).alias("line_numbers"))


def uses_class(usages: DataFrame, classes: DataFrame) -> DataFrame:
    """USES_CLASS from usages (repo_id, src_id, name)."""
    return usages.join(class_by_name(classes), ["repo_id", "name"]).select("repo_id", "src_id", F.col("id").alias("dst_id")).distinct()


def module_files(files: DataFrame) -> DataFrame:
    """(repo_id, name, id): dotted path and bare file name, both without .py, to the file; the last by path wins."""
    dotted = files.select("repo_id", F.regexp_replace(F.translate("path", "/", "."), r"\.py", "").alias("name"), F.col("path").alias("id"))
    bare = files.select("repo_id", F.regexp_replace("name", r"\.py", "").alias("name"), F.col("path").alias("id"))
    both = dotted.unionByName(bare)
    return keep_first(both, ["repo_id", "name"], [F.col("id").desc()])


def file_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS_FROM / DEPENDS_ON by the first dotted segment of the import source; a file never depends on itself."""
    want = imports.select("repo_id", F.col("path").alias("src_id"), F.element_at(F.split("source", r"\."), 1).alias("name"), "symbols")
    hit = want.join(module_files(files), ["repo_id", "name"]).filter(F.col("src_id") != F.col("id"))
    return hit.groupBy("repo_id", "src_id", F.col("id").alias("dst_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("symbols")))).cast("string").alias("symbols"))


def detected(found: DataFrame, known: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Detector rows (repo_id, src_name, dst_name, rel_type, confidence, detection_method, context, line) to edges.

    A name is resolved by its last segment, first as a function (the first of the name), else as a class; rows with an
    unresolved end are dropped, edges already known keep priority, and the first detection of an edge wins.
    """
    last = lambda c: F.regexp_extract(F.col(c), r"([^.:]+)$", 1)
    f, k = function_by_name(functions), class_by_name(classes)
    out = found
    for end in ("src", "dst"):
        out = out.withColumn("name", last(f"{end}_name"))
        out = out.join(f.withColumnRenamed("id", "fid"), ["repo_id", "name"], "left").join(k.withColumnRenamed("id", "kid"), ["repo_id", "name"], "left")
        out = out.withColumn(f"{end}_id", F.coalesce("fid", "kid")).drop("fid", "kid", "name")
    out = out.filter("src_id is not null and dst_id is not null")
    out = out.join(known.select("repo_id", "rel_type", "src_id", "dst_id").distinct(), ["repo_id", "rel_type", "src_id", "dst_id"], "left_anti")
    out = keep_first(out, ["repo_id", "rel_type", "src_id", "dst_id"], [F.col("line").asc_nulls_last(), F.col("src_name"), F.col("dst_name")])
    return out.withColumn("line_numbers", F.concat(F.lit("["), F.col("line").cast("string"), F.lit("]")))
