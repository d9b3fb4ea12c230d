"""The catalogue of graph questions as plans over a CodeGraph.

Every function answers for all repositories at once, keyed by ``repo_id``; ``repo_id=...`` narrows the tables before any
join, so the filter reaches the scans. ``scoped=True`` keeps to functions that a file of the repository defines (directly
or through a class); ``scoped=False`` also lists those that no file defines, with a null path.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import bm25, cosine, dot, joined, unit
from weftgraph.graph import CodeGraph
from weftgraph.operators import paths
from weftgraph.operators.dedup import keep_first
from weftgraph.operators.ranking import top_k
from weftgraph.session import cut

# Names that are never reported as dead code.
NEVER_DEAD = [
    "main", "__init__", "__str__", "__repr__", "__new__", "__del__", "__enter__", "__exit__", "__len__", "__iter__", "__next__",
    "__call__", "__eq__", "__hash__", "__lt__", "__le__", "__gt__", "__ge__",
]


def narrowed(graph: CodeGraph, repo_id: str | None) -> CodeGraph:
    """The graph of one repository."""
    if repo_id is None:
        return graph
    only = F.col("repo_id") == repo_id
    return replace(graph, nodes={k: v.filter(only) for k, v in graph.nodes.items()}, raw_edges=graph.raw_edges.filter(only), _edges=None)


def is_test_path(path: Column) -> Column:
    return path.contains("/test") | path.contains("test_") | path.endswith("_test.py")


def _named(graph: CodeGraph, label: str, key: str, name: str) -> DataFrame:
    return graph.label(label).select("repo_id", F.col("id").alias(key), F.col("name").alias(name))


def _scope(graph: CodeGraph) -> DataFrame:
    """One row per function with its file: the smallest path if several files define it."""
    return graph.function_scope().groupBy("repo_id", "id").agg(F.min("file_id").alias("filePath"))


def _with_file(graph: CodeGraph, functions: DataFrame, scoped: bool) -> DataFrame:
    return functions.join(_scope(graph), ["repo_id", "id"], "inner" if scoped else "left")


def _class_names(graph: CodeGraph) -> DataFrame:
    """(repo_id, id, className): the class that owns a method, smallest name if several do."""
    own = graph.rel("HAS_METHOD").select("repo_id", F.col("src_id").alias("cid"), F.col("dst_id").alias("id"))
    return own.join(_named(graph, "Class", "cid", "className"), ["repo_id", "cid"]).groupBy("repo_id", "id").agg(F.min("className").alias("className"))


def function_by_name(graph: CodeGraph, name: str | None = None, repo_id: str | None = None, scoped: bool = True) -> DataFrame:
    g = narrowed(graph, repo_id)
    f = g.functions if name is None else g.functions.filter(F.col("name") == name)
    if scoped:
        f = _with_file(g, f, True)
    else:
        top = g.rel("DEFINES_FUNCTION").groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.min("src_id").alias("filePath"))
        f = f.join(top, ["repo_id", "id"], "left")
    f = f.join(_class_names(g), ["repo_id", "id"], "left")
    return f.select("repo_id", "id", "name", "signature", "docstring", F.col("start_line").alias("startLine"), "filePath", "className")


def class_by_name(graph: CodeGraph, name: str | None = None, repo_id: str | None = None) -> DataFrame:
    """Each branch is aggregated before it is joined, so parents and methods never multiply."""
    g = narrowed(graph, repo_id)
    c = g.classes if name is None else g.classes.filter(F.col("name") == name)
    file = g.rel("DEFINES_CLASS").groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.min("src_id").alias("filePath"))
    up = g.rel("EXTENDS").select("repo_id", F.col("src_id").alias("id"), F.col("dst_id").alias("pid")).join(_named(g, "Class", "pid", "pname"), ["repo_id", "pid"])
    up = up.groupBy("repo_id", "id").agg(joined(F.collect_set("pname")).alias("parentClasses"))
    own = g.rel("HAS_METHOD").select("repo_id", F.col("src_id").alias("id"), F.col("dst_id").alias("mid")).join(_named(g, "Function", "mid", "mname"), ["repo_id", "mid"])
    own = own.groupBy("repo_id", "id").agg(joined(F.collect_set("mname")).alias("methods"))
    out = c.join(file, ["repo_id", "id"], "left").join(up, ["repo_id", "id"], "left").join(own, ["repo_id", "id"], "left")
    blank = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return out.select("repo_id", "id", "name", "docstring", F.col("start_line").alias("startLine"), "filePath", blank("parentClasses"), blank("methods"))


def call_graph(graph: CodeGraph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Callees of the seeds at each depth 1..``depth``; a callee may appear at several depths, the seed through a cycle."""
    found = paths.walks(cut(graph.rel("CALLS").select("repo_id", "src_id", "dst_id")), seeds, max(1, depth)).withColumnsRenamed({"start_id": "source_id", "id": "callee_id"})
    return found.join(_named(graph, "Function", "callee_id", "callee_name"), ["repo_id", "callee_id"]).select("repo_id", "source_id", "callee_id", "callee_name", "depth")


def callers(graph: CodeGraph, function_id: str | None = None, repo_id: str | None = None) -> DataFrame:
    """Direct callers of one function, or of every function."""
    g = narrowed(graph, repo_id)
    calls = g.rel("CALLS") if function_id is None else g.rel("CALLS").filter(F.col("dst_id") == function_id)
    calls = calls.select("repo_id", F.col("dst_id").alias("function_id"), F.col("src_id").alias("id"))
    f = _with_file(g, g.functions, False).select("repo_id", "id", "name", "signature", "filePath", F.col("start_line").alias("startLine"))
    return calls.join(f, ["repo_id", "id"]).select("repo_id", "function_id", "id", "name", "signature", "filePath", "startLine")


def change_impact(graph: CodeGraph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """What the seeds reach over CALLS within ``max_depth``, with the least distance; the seed itself is left out."""
    hit = paths.reach(cut(graph.rel("CALLS").select("repo_id", "src_id", "dst_id")), seeds, max(1, max_depth))
    f = _with_file(graph, graph.functions, False).select("repo_id", "id", "name", "filePath", F.col("start_line").alias("startLine"))
    return hit.join(f, ["repo_id", "id"]).select("repo_id", F.col("start_id").alias("function_id"), "id", "name", "filePath", "startLine", "distance")


def circular_dependencies(graph: CodeGraph, rel_type: str = "CALLS", shortest: int = 2, longest: int = 5, repo_id: str | None = None) -> DataFrame:
    found = paths.cycles(narrowed(graph, repo_id).rel(rel_type), shortest, longest)
    return found.select("repo_id", F.array_join("cycle", " > ").alias("cycle"), "cycle_length")


def class_hierarchy(graph: CodeGraph, repo_id: str | None = None) -> DataFrame:
    """Names of all ancestors and descendants of every class over EXTENDS, of any depth (a class on a cycle reaches itself)."""
    from weftgraph.operators.hierarchy import closure

    g = narrowed(graph, repo_id)
    links = g.rel("EXTENDS").select("repo_id", F.col("src_id").alias("child"), F.col("dst_id").alias("parent"))
    pairs = closure(links)
    up = pairs.join(_named(g, "Class", "ancestor", "n"), ["repo_id", "ancestor"]).groupBy("repo_id", F.col("node").alias("id")).agg(joined(F.collect_set("n")).alias("ancestors"))
    down = pairs.join(_named(g, "Class", "node", "n"), ["repo_id", "node"]).groupBy("repo_id", F.col("ancestor").alias("id")).agg(joined(F.collect_set("n")).alias("descendants"))
    out = g.classes.select("repo_id", "id", "name").join(up, ["repo_id", "id"], "left").join(down, ["repo_id", "id"], "left")
    return out.select("repo_id", "id", "name", F.coalesce("ancestors", F.lit("")).alias("ancestors"), F.coalesce("descendants", F.lit("")).alias("descendants"))


def class_details(graph: CodeGraph, name: str | None = None, repo_id: str | None = None) -> DataFrame:
    return class_by_name(graph, name, repo_id).join(class_hierarchy(graph, repo_id).drop("name"), ["repo_id", "id"])


def file_dependencies(graph: CodeGraph, path: str | None = None, repo_id: str | None = None) -> DataFrame:
    g = narrowed(graph, repo_id)
    dep = g.rel("DEPENDS_ON").select("repo_id", "src_id", "dst_id")
    out = dep.groupBy("repo_id", F.col("src_id").alias("filePath")).agg(joined(F.collect_set("dst_id")).alias("dependsOn"))
    back = dep.groupBy("repo_id", F.col("dst_id").alias("filePath")).agg(joined(F.collect_set("src_id")).alias("dependedBy"))
    files = g.files if path is None else g.files.filter(F.col("path") == path)
    df = files.select("repo_id", F.col("path").alias("filePath")).join(out, ["repo_id", "filePath"], "left").join(back, ["repo_id", "filePath"], "left")
    return df.select("repo_id", "filePath", F.coalesce("dependsOn", F.lit("")).alias("dependsOn"), F.coalesce("dependedBy", F.lit("")).alias("dependedBy"))


def similar_functions(graph: CodeGraph, seeds: DataFrame) -> DataFrame:
    """Functions that share callees or used classes with a seed: shared / all of the seed's, as a share of the seed's own."""
    use = graph.rel("CALLS", "USES_CLASS").select("repo_id", F.col("src_id").alias("id"), F.col("rel_type").alias("kind"), F.col("dst_id").alias("what"))
    mine = use.join(seeds.select("repo_id", "id"), ["repo_id", "id"], "left_semi").withColumnRenamed("id", "function_id")
    size = mine.groupBy("repo_id", "function_id").agg(F.count(F.lit(1)).alias("size"))
    both = mine.join(use, ["repo_id", "kind", "what"]).filter("id <> function_id")
    n = both.groupBy("repo_id", "function_id", "id").agg(F.count_if(F.col("kind") == "CALLS").alias("commonCalls"), F.count_if(F.col("kind") == "USES_CLASS").alias("commonClasses"))
    out = n.join(size, ["repo_id", "function_id"]).join(graph.functions.select("repo_id", "id", "name", "signature"), ["repo_id", "id"])
    return out.select("repo_id", "function_id", "id", "name", "signature", "commonCalls", "commonClasses", ((F.col("commonCalls") + F.col("commonClasses")) / F.col("size")).alias("similarity"))


def code_context(graph: CodeGraph, entity_id: str | None = None, repo_id: str | None = None) -> DataFrame:
    """Context of functions and classes. For classes calls = methods, calledBy = parents, usesClasses = variables."""
    g = narrowed(graph, repo_id)
    pick = (lambda df: df) if entity_id is None else (lambda df: df.filter(F.col("id") == entity_id))

    def side(types: str, key: str, other: str, label: str, column: str, what: Column) -> DataFrame:
        e = g.rel(types).select("repo_id", F.col(key).alias("id"), F.col(other).alias("oid"))
        e = pick(e).join(_named(g, label, "oid", "oname"), ["repo_id", "oid"])
        return e.groupBy("repo_id", "id").agg(joined(F.collect_set(what)).alias(column))

    def fill(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.join(b, ["repo_id", "id"], "left"), parts, df)

    ident, name = F.concat_ws("=", "oid", "oname"), F.col("oname")
    f = fill(pick(_with_file(g, g.functions, False)), [
        _class_names(g), side("CALLS", "src_id", "dst_id", "Function", "calls", ident),
        side("CALLS", "dst_id", "src_id", "Function", "calledBy", ident), side("USES_CLASS", "src_id", "dst_id", "Class", "usesClasses", name),
    ])
    file = g.rel("DEFINES_CLASS").groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.min("src_id").alias("filePath"))
    c = fill(pick(g.classes), [
        file, side("HAS_METHOD", "src_id", "dst_id", "Function", "calls", ident), side("EXTENDS", "src_id", "dst_id", "Class", "calledBy", name),
        side("HAS_VARIABLE", "src_id", "dst_id", "Variable", "usesClasses", name),
    ])
    no = F.lit(None).cast("string")
    shape = lambda kind, df, sig, cls: df.select(
        F.lit(kind).alias("type"), "repo_id", "id", "name", sig.alias("signature"), "docstring", F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"),
        "filePath", cls.alias("className"), *[F.coalesce(x, F.lit("")).alias(x) for x in ("calls", "calledBy", "usesClasses")],
    )
    return shape("function", f, F.col("signature"), F.col("className")).unionByName(shape("class", c, no, no))


def search_fulltext(graph: CodeGraph, query: str, label: str = "Function", repo_id: str | None = None) -> DataFrame:
    """Docstring search ranked by BM25; scores are textbook BM25, so ranks agree with other engines, figures need not."""
    g = narrowed(graph, repo_id)
    docs = g.label(label)
    score = bm25(docs.select("repo_id", "id", "docstring"), ["repo_id", "id"], "docstring", query)
    extra = ["signature"] if label == "Function" else []
    return docs.join(score, ["repo_id", "id"]).select("repo_id", "id", "name", *extra, "docstring", F.round("score", 6).alias("score"))


def search_substring(graph: CodeGraph, text: str, repo_id: str | None = None, kinds: tuple[str, ...] = ("function", "class", "file")) -> DataFrame:
    """Case-sensitive CONTAINS on names, docstrings, signatures and paths; functions before classes before files."""
    g = narrowed(graph, repo_id)
    has = lambda *cols: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).contains(text), F.lit(False)) for c in cols])
    out = []
    if "function" in kinds:
        f = _with_file(g, g.functions.filter(has("name", "docstring", "signature")), False)
        out.append(f.select("repo_id", F.lit("function").alias("type"), "id", "name", F.col("docstring").alias("description"), F.col("filePath").alias("location"), F.col("start_line").alias("startLine"), F.lit(0).alias("branch")))
    if "class" in kinds:
        file = g.rel("DEFINES_CLASS").groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.min("src_id").alias("filePath"))
        c = g.classes.filter(has("name", "docstring")).join(file, ["repo_id", "id"], "left")
        out.append(c.select("repo_id", F.lit("class").alias("type"), "id", "name", F.col("docstring").alias("description"), F.col("filePath").alias("location"), F.col("start_line").alias("startLine"), F.lit(1).alias("branch")))
    if "file" in kinds:
        x = g.files.filter(has("name", "path"))
        out.append(x.select("repo_id", F.lit("file").alias("type"), F.col("path").alias("id"), "name", F.col("path").alias("description"), F.col("path").alias("location"), F.lit(0).alias("startLine"), F.lit(2).alias("branch")))
    return reduce(DataFrame.unionByName, out)


def search_semantic(graph: CodeGraph, text: str, limit: int = 20, repo_id: str | None = None, vector: list[float] | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Functions, classes and files for a text: by vectors (label, repo_id, id, embedding) of functions and classes where a
    query vector is given, the best ``limit`` of each label merged by score; else by substring, ``limit`` per kind, functions
    before classes before files. Either way the first ``limit`` rows; ties go by id."""
    g = narrowed(graph, repo_id)
    if vector is None or vectors is None:
        found = top_k(search_substring(g, text), [F.col("repo_id"), F.col("id")], limit, ["branch"]).drop("rank")
        return top_k(found, [F.col("branch"), F.col("repo_id"), F.col("id")], limit)
    scored = vectors.select("label", "repo_id", "id", ((1 + cosine(F.col("embedding"), F.lit(vector))) / 2).alias("score")).filter("score > 0.3")
    best = top_k(scored.filter(F.col("label").isin("Function", "Class")), [F.col("score").desc(), F.col("repo_id"), F.col("id")], limit, ["label"]).drop("rank")
    file = g.rel("DEFINES_CLASS").groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.min("src_id").alias("filePath"))
    f = _with_file(g, g.functions, False).select(F.lit("Function").alias("label"), "repo_id", "id", "name", "docstring", "filePath", "start_line")
    c = g.classes.join(file, ["repo_id", "id"], "left").select(F.lit("Class").alias("label"), "repo_id", "id", "name", "docstring", "filePath", "start_line")
    out = f.unionByName(c).join(F.broadcast(best), ["label", "repo_id", "id"])  # at most two times ``limit`` rows
    out = out.select("repo_id", F.lower("label").alias("type"), "id", "name", F.col("docstring").alias("description"), F.col("filePath").alias("location"), F.col("start_line").alias("startLine"), "score")
    return top_k(out, [F.col("score").desc(), F.col("repo_id"), F.col("id")], limit)


def search_vector(vectors: DataFrame, query: list[float] | DataFrame, key: str = "vec_id", column: str = "embedding", floor: float = 0.3) -> DataFrame:
    """Exact k-NN scores (1 + cosine) / 2 above ``floor``. The query is one vector, or a one-row table (key, column)."""
    if isinstance(query, DataFrame):
        q = F.broadcast(query.select(F.col(column).alias("__q")).limit(1))
        scored = vectors.join(q).select(key, ((1 + cosine(F.col(column), F.col("__q"))) / 2).alias("score"))
    else:
        scored = vectors.select(key, ((1 + cosine(F.col(column), F.lit(query))) / 2).alias("score"))
    return scored.filter(F.col("score") > floor)


def search_vectors(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", floor: float = 0.3) -> DataFrame:
    """Exact k-NN scores (1 + cosine) / 2 above ``floor`` of all vectors for every row of ``queries`` (key, column), as query_id, key, score."""
    v, q = vectors.select(key, unit(F.col(column)).alias("__v")), queries.select(F.col(key).alias("query_id"), unit(F.col(column)).alias("__q"))
    scored = v.crossJoin(q).select("query_id", key, ((1 + dot(F.col("__v"), F.col("__q"))) / 2).alias("score"))
    return scored.filter(F.col("score") > floor)


def file_search(graph: CodeGraph, text: str, repo_id: str | None = None) -> DataFrame:
    f = narrowed(graph, repo_id).files.filter(F.col("name").contains(text) | F.col("path").contains(text))
    return f.select("repo_id", F.col("path").alias("id"), "name", "path", F.col("lines_of_code").alias("lines"))


def list_repositories(graph: CodeGraph) -> DataFrame:
    files = graph.rel("CONTAINS_FILE").groupBy("repo_id").agg(F.count(F.lit(1)).alias("fileCount"))
    contained = graph.rel("CONTAINS_FILE").select("repo_id", F.col("dst_id").alias("src_id"))
    classes = graph.rel("DEFINES_CLASS").join(contained, ["repo_id", "src_id"], "left_semi").groupBy("repo_id").agg(F.count_distinct("dst_id").alias("classCount"))
    functions = _scope(graph).groupBy("repo_id").agg(F.count(F.lit(1)).alias("functionCount"))
    out = graph.repositories.select("repo_id", "path")
    for part in (files, functions, classes):
        out = out.join(part, "repo_id", "left")
    return out.select(F.col("repo_id").alias("id"), "path", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("fileCount", "functionCount", "classCount")])


def graph_stats(graph: CodeGraph, repo_id: str | None = None) -> DataFrame:
    """Per repository: files, modules, classes, functions (top-level and methods), imports, and edges."""
    g = narrowed(graph, repo_id)
    one = lambda df, name: df.groupBy("repo_id").agg(F.count(F.lit(1)).cast("bigint").alias(name))
    contained = g.rel("CONTAINS_FILE").select("repo_id", F.col("dst_id").alias("src_id"))
    parts = {
        "files": one(g.rel("CONTAINS_FILE"), "files"),
        "modules": one(g.modules, "modules"),
        "classes": one(g.rel("DEFINES_CLASS").join(contained, ["repo_id", "src_id"], "left_semi").select("repo_id", "dst_id").distinct(), "classes"),
        "functions": one(_scope(g), "functions"),
        "imports": one(g.label("Import"), "imports"),
        "relationships": one(g.edges, "relationships"),
    }
    out = g.repositories.select("repo_id", "name", "last_indexed")
    for part in parts.values():
        out = out.join(part, "repo_id", "left")
    return out.select("repo_id", "name", F.col("last_indexed").alias("lastIndexed"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in parts])


def label_counts(graph: CodeGraph) -> DataFrame:
    """Rows per node label and per edge type: the figures of the health checks."""
    count = lambda df, kind, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), name.alias("label"), "n")
    nodes = [count(df, "node", F.lit(label)) for label, df in graph.nodes.items()]
    edges = graph.edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), F.col("rel_type").alias("label"), "n")
    return reduce(DataFrame.unionByName, [*nodes, edges])


def uncalled(graph: CodeGraph, functions: DataFrame) -> DataFrame:
    return functions.join(graph.rel("CALLS").select("repo_id", F.col("dst_id").alias("id")).distinct(), ["repo_id", "id"], "left_anti")


def dead_code(graph: CodeGraph, repo_id: str | None = None, scoped: bool = True) -> DataFrame:
    g = narrowed(graph, repo_id)
    f = g.functions.filter(~F.col("name").startswith("test") & ~F.col("name").startswith("Test") & ~F.col("name").isin(NEVER_DEAD))
    return _with_file(g, uncalled(g, f), scoped).select("repo_id", "id", "name", "filePath", F.col("start_line").alias("startLine"), "complexity")


def entry_points(graph: CodeGraph, repo_id: str | None = None, exclude_tests: bool = True, path_part: str = "", scoped: bool = True) -> DataFrame:
    """Functions nobody calls whose name does not start with '_'. ``scoped``: top-level functions only; else methods pass
    with a null path. ``path_part`` is matched anywhere in the path."""
    g = narrowed(graph, repo_id)
    top = g.rel("DEFINES_FUNCTION").groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.min("src_id").alias("filePath"))
    f = uncalled(g, g.functions.filter(~F.col("name").startswith("_"))).join(top, ["repo_id", "id"], "inner" if scoped else "left")
    keep = F.lit(True)
    if exclude_tests:
        keep = keep & ~is_test_path(F.col("filePath"))
    if path_part:
        keep = keep & F.col("filePath").contains(path_part)
    return f.filter(F.col("filePath").isNull() | keep).select("repo_id", "id", "name", "signature", "filePath")


def high_complexity(graph: CodeGraph, minimum: int = 5, repo_id: str | None = None, scoped: bool = True) -> DataFrame:
    """``scoped`` reaches top-level functions only; otherwise methods come with a null path."""
    g = narrowed(graph, repo_id)
    top = g.rel("DEFINES_FUNCTION").groupBy("repo_id", F.col("dst_id").alias("id")).agg(F.min("src_id").alias("filePath"))
    f = g.functions.filter(F.col("complexity") >= minimum).join(top, ["repo_id", "id"], "inner" if scoped else "left")
    return f.select("repo_id", "id", "name", "complexity", "signature", "filePath")


def hotspots(graph: CodeGraph, repo_id: str | None = None, scoped: bool = True) -> DataFrame:
    """Coupling of every function. A function without callers counts one incoming call (defined so by the original query)."""
    g = narrowed(graph, repo_id)
    calls = g.rel("CALLS").select("repo_id", "src_id", "dst_id")
    ends = calls.select("repo_id", F.explode(F.array(F.struct(F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    n = ends.groupBy("repo_id", F.col("x.id").alias("id")).agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i"))
    f = _with_file(g, g.functions, scoped).join(n, ["repo_id", "id"], "left")
    out, inc = F.coalesce("o", F.lit(0)).cast("bigint"), F.greatest(F.coalesce("i", F.lit(0)), F.lit(1)).cast("bigint")
    return f.select("repo_id", "id", "name", "filePath", "complexity", out.alias("outgoingCalls"), inc.alias("incomingCalls"), (out + inc).alias("totalCoupling"))


def tests_of(graph: CodeGraph, function_id: str | None = None, repo_id: str | None = None) -> DataFrame:
    g = narrowed(graph, repo_id)
    t = g.rel("TESTS") if function_id is None else g.rel("TESTS").filter(F.col("dst_id") == function_id)
    f = _with_file(g, g.functions, False).select("repo_id", F.col("id").alias("src_id"), "name", "signature", "filePath", F.col("start_line").alias("startLine"))
    return t.select("repo_id", "src_id", F.col("dst_id").alias("function_id")).join(f, ["repo_id", "src_id"]).select("repo_id", "function_id", F.col("src_id").alias("id"), "name", "signature", "filePath", "startLine")


def link_tests(graph: CodeGraph, repo_id: str | None = None) -> DataFrame:
    """TESTS edges by name: ``test_x`` (or ``testx``) in a test file to every ``x`` outside of test files, all matches."""
    g = narrowed(graph, repo_id)
    s = g.function_scope().select("repo_id", "file_id", "id").join(g.functions.select("repo_id", "id", "name"), ["repo_id", "id"])
    name = F.col("name")
    impl_name = F.when(name.startswith("test_"), F.expr("substring(name, 6)")).otherwise(F.expr("substring(name, 5)"))
    tests = s.filter(is_test_path(F.col("file_id")) & name.startswith("test")).select("repo_id", F.col("id").alias("src_id"), impl_name.alias("name")).filter("name <> ''")
    impl = s.filter(~is_test_path(F.col("file_id"))).select("repo_id", F.col("id").alias("dst_id"), "name")
    return tests.join(impl, ["repo_id", "name"]).filter("src_id <> dst_id").select("repo_id", "src_id", "dst_id").distinct()


def orphans(graph: CodeGraph) -> DataFrame:
    """Functions that neither a file nor a class holds and classes that no file defines."""
    held = graph.rel("DEFINES_FUNCTION", "HAS_METHOD").select("repo_id", F.col("dst_id").alias("id")).distinct()
    defined = graph.rel("DEFINES_CLASS").select("repo_id", F.col("dst_id").alias("id")).distinct()
    f = graph.functions.join(held, ["repo_id", "id"], "left_anti").select(F.lit("Function").alias("label"), "repo_id", "id", "name")
    c = graph.classes.join(defined, ["repo_id", "id"], "left_anti").select(F.lit("Class").alias("label"), "repo_id", "id", "name")
    return f.unionByName(c)


def integrity(graph: CodeGraph) -> DataFrame:
    """Raw CALLS whose target is no function and raw EXTENDS whose target is no class."""
    out = []
    for rel, label in (("CALLS", "Function"), ("EXTENDS", "Class")):
        e = graph.raw_edges.filter(F.col("rel_type") == rel).select("repo_id", F.col("src_id").alias("source"), F.lit(rel).alias("rel"), F.col("dst_id").alias("target_node_id"))
        out.append(e.join(graph.label(label).select("repo_id", F.col("id").alias("target_node_id")), ["repo_id", "target_node_id"], "left_anti"))
    return reduce(DataFrame.unionByName, out).distinct()


def language_histogram(graph: CodeGraph) -> DataFrame:
    return graph.classes.groupBy("language_type").agg(F.count(F.lit(1)).alias("n"))


def classes_with_many_methods(graph: CodeGraph, more_than: int = 10) -> DataFrame:
    n = graph.rel("HAS_METHOD").groupBy("repo_id", F.col("src_id").alias("id")).agg(F.count(F.lit(1)).alias("methods")).filter(F.col("methods") > more_than)
    return n.join(graph.classes.select("repo_id", "id", "name"), ["repo_id", "id"]).select("repo_id", "id", "name", "methods")


def implementations(graph: CodeGraph) -> DataFrame:
    e = graph.rel("IMPLEMENTS").select("repo_id", F.col("src_id").alias("id"), F.col("dst_id").alias("interface_id"))
    e = e.join(_named(graph, "Class", "id", "name"), ["repo_id", "id"])
    return e.join(_named(graph, "Class", "interface_id", "interface"), ["repo_id", "interface_id"]).select("repo_id", "id", "name", "interface_id", "interface")


def staleness(graph: CodeGraph, now: Column | None = None, max_hours: int = 24) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    hours = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_indexed").cast("timestamp"))) / 3600
    return graph.repositories.select("repo_id", "last_indexed", F.round(hours, 6).alias("age_hours"), F.coalesce(hours > max_hours, F.lit(True)).alias("stale"))


def resources(graph: CodeGraph, scheme: str = "repository") -> DataFrame:
    return graph.repositories.select(F.concat(F.lit(f"{scheme}://"), "repo_id").alias("uri"), "name", F.coalesce("description", F.lit("")).alias("description"))
