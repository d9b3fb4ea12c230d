"""Questions by name with arguments as a mapping and answers as JSON: the calls that editors and agents make."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.operators.ranking import clamp, top_k
from weftgraph.plans import queries as q

Args = Mapping[str, Any]


def _rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    """The answer's rows; every unlimited answer here is about one named thing."""
    df = df.limit(limit) if limit is not None else df
    return [{k: v for k, v in r.asDict(recursive=True).items() if k not in ("branch", "rank")} for r in df.collect()]


def _first(g: CodeGraph, a: Args, *order: str, df: DataFrame, default: int) -> list[dict]:
    n = clamp(a.get("limit", default), default)
    return _rows(top_k(df, [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in order], n).orderBy("rank"))


def _one(g: CodeGraph, a: Args) -> DataFrame:
    """The function a call is about, as seeds."""
    f = g.functions.filter(F.col("id") == a["function_id"])
    return (f.filter(F.col("repo_id") == a["repo_id"]) if a.get("repo_id") else f).select("repo_id", "id")


def search_code(g: CodeGraph, a: Args) -> dict:
    text, kind, repo = a.get("query", ""), a.get("type", "all"), a.get("repo_id")
    n = clamp(a.get("limit", 10), 10)
    if kind == "all":
        found = _rows(q.search_semantic(g, text, n, repo))
    elif kind in ("function", "class"):
        by_name = q.function_by_name if kind == "function" else q.class_by_name
        found = _rows(by_name(g, text, repo).orderBy("repo_id", "id"))
        if not found and text.strip():
            found = _first(g, {"limit": n}, "-score", "repo_id", "id", df=q.search_fulltext(g, text, kind.capitalize(), repo), default=n)
    elif kind == "file":
        found = _first(g, {"limit": n}, "repo_id", "id", df=q.file_search(g, text, repo), default=n)
    else:
        found = []
    return {"query": text, "type": kind, "results": found} if found else {"message": f"No results found for '{text}'", "results": []}


def function_details(g: CodeGraph, a: Args) -> dict:
    repo, ident = a.get("repo_id"), a.get("function_id")
    got = _rows(q.code_context(g, ident, repo).orderBy("repo_id", "type"), 1) if ident else []
    if not got and a.get("function_name"):
        named = _rows(q.function_by_name(g, a["function_name"], repo).orderBy("repo_id", "id"), 1)
        got = _rows(q.code_context(g, named[0]["id"], named[0]["repo_id"]).filter("type = 'function'"), 1) if named else []
    return got[0] if got else {"error": "Function not found"}


def class_details(g: CodeGraph, a: Args) -> dict:
    got = _rows(q.class_details(g, a["class_name"], a.get("repo_id")).orderBy("repo_id", "id"), 1)
    return got[0] if got else {"error": f"Class '{a['class_name']}' not found"}


def _health(g: CodeGraph, a: Args) -> dict:
    rows = _rows(q.label_counts(g))
    nodes = {r["label"]: r["n"] for r in rows if r["kind"] == "node"}
    return {"status": "healthy" if nodes.get("Repository") else "empty", "nodes": nodes, "relationships": {r["label"]: r["n"] for r in rows if r["kind"] == "edge"}, "total_nodes": sum(nodes.values())}


TOOLS: dict[str, Callable[[CodeGraph, Args], Any]] = {
    "search_code": search_code,
    "get_function_details": function_details,
    "get_class_details": class_details,
    "get_call_graph": lambda g, a: _rows(q.call_graph(g, _one(g, a), clamp(a.get("depth", 2), 2)).orderBy("depth", "callee_id")),
    "get_callers": lambda g, a: _first(g, a, "repo_id", "id", df=q.callers(g, a["function_id"], a.get("repo_id")), default=20),
    "get_class_hierarchy": lambda g, a: _rows(q.class_hierarchy(g, a.get("repo_id")).filter(F.col("name") == a["class_name"]).orderBy("repo_id", "id")),
    "get_file_dependencies": lambda g, a: _rows(q.file_dependencies(g, a["file_path"], a.get("repo_id")).orderBy("repo_id")),
    "find_similar_code": lambda g, a: _first(g, a, "-similarity", "repo_id", "id", df=q.similar_functions(g, _one(g, a)), default=5),
    "get_code_context": lambda g, a: (_rows(q.code_context(g, a["entity_id"], a.get("repo_id")).orderBy("repo_id", "type"), 1) or [{"error": "Entity not found"}])[0],
    "find_entry_points": lambda g, a: _first(g, a, "repo_id", "name", "id", df=q.entry_points(g, a.get("repo_id"), a.get("exclude_tests", True), a.get("file_path", "") or "", scoped=bool(a.get("repo_id"))), default=20),
    "find_high_complexity_functions": lambda g, a: _first(g, a, "-complexity", "repo_id", "id", df=q.high_complexity(g, clamp(a.get("min_complexity", 5), 5), a.get("repo_id"), scoped=bool(a.get("repo_id"))), default=10),
    "get_tests_for_function": lambda g, a: _rows(q.tests_of(g, a["function_id"], a.get("repo_id")).orderBy("repo_id", "id")),
    "health_check": _health,
    "get_graph_stats": lambda g, a: _rows(q.graph_stats(g, a.get("repo_id")).orderBy("repo_id")),
    "list_repositories": lambda g, a: _rows(q.list_repositories(g).orderBy("id")),
    "find_dead_code": lambda g, a: _first(g, a, "name", "repo_id", "id", df=q.dead_code(g, a.get("repo_id"), scoped=bool(a.get("repo_id"))), default=50),
    "analyze_change_impact": lambda g, a: _first(g, a, "distance", "name", "repo_id", "id", df=q.change_impact(g, _one(g, a), clamp(a.get("max_depth", 3), 3)), default=50),
    "find_circular_dependencies": lambda g, a: _first(g, a, "cycle_length", "repo_id", "cycle", df=q.circular_dependencies(g, shortest=clamp(a.get("min_length", 2), 2), longest=clamp(a.get("max_length", 5), 5), repo_id=a.get("repo_id")), default=20),
    "get_complexity_hotspots": lambda g, a: _first(g, a, "-totalCoupling", "repo_id", "id", df=q.hotspots(g, a.get("repo_id"), scoped=bool(a.get("repo_id"))), default=20),
}


def call(graph: CodeGraph, name: str, arguments: Args | None = None) -> tuple[str, bool]:
    """(text, is_error): the answer of a tool as JSON, or what was wrong with the call."""
    if name not in TOOLS:
        return f"Unknown tool: {name}", True
    try:
        return json.dumps(TOOLS[name](graph, arguments or {}), indent=2, default=str), False
    except KeyError as e:
        return f"Missing required argument: {e}", True
    except Exception as e:  # noqa: BLE001 - the caller gets the message
        return f"Error: {e}", True

