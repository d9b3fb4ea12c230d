import json
import subprocess

import pytest
from pyspark.sql import functions as F

from weftgraph import __main__ as cli
from weftgraph import tools
from weftgraph.operators.ranking import clamp, top_k
from weftgraph.parse.registry import parse_sources
from weftgraph.plans import pipeline, queries
from weftgraph.sources import repository
from weftgraph.sources.store import Store

MAIN = '''"""Start."""
import os
from typing import List

LIMIT = 3


class Settings:
    """Where things are."""

    host: str = "a"

    def as_map(self):
        return {"host": self.host}


class Runner(Settings):
    async def begin(self):
        if self.host and LIMIT:
            return self._inner()

    def _inner(self):
        return 1


def make_runner(n: int = 1) -> Runner:
    r = Runner()
    r.begin()
    return r


def main():
    make_runner().as_map()
'''
STORE = "from main import Settings\n\n\nclass Box:\n    def get(self, key):\n        s = Settings()\n        return self._d.get(key)\n"
TEST = "def test_make_runner():\n    make_runner()\n\n\ndef test_absent():\n    pass\n"
GO = "package a\n\n// Open opens.\nfunc Open(n int) error {\n\treturn nil\n}\n"
FILES = {"src/__init__.py": "", "src/main.py": MAIN, "src/parts/box.py": STORE, "tests/test_main.py": TEST, "cmd/a.go": GO, "node_modules/x.js": "function no() {}", "notes.txt": "x"}


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode() if isinstance(text, str) else text)
    return root


def edges(g, *types):
    return {(r.rel_type, r.src_id, r.dst_id) for r in g.rel(*types).collect()}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = put(tmp_path_factory.mktemp("repo"), FILES)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    store.ingest(repository.read_repository(spark, str(root), "r"))
    return store


def test_walk(spark, tmp_path):
    put(tmp_path, {**FILES, "src/odd name+1%.py": b"x = 1\r\ny = '\xff'\r\n", ".venv/a.py": "x"})
    got = {r.path: r for r in repository.read_repository(spark, str(tmp_path), "r").collect()}
    assert set(got) == {"src/__init__.py", "src/main.py", "src/parts/box.py", "tests/test_main.py", "cmd/a.go", "src/odd name+1%.py"}
    assert got["src/odd name+1%.py"].source == "x = 1\ny = ''\n" and got["src/odd name+1%.py"].lines_of_code == 3
    assert got["src/__init__.py"].lines_of_code == 1 and got["cmd/a.go"].language == "Go" and got["src/main.py"].extension == ".py"


def test_graph_of_a_repository(stored):
    g = stored.load()
    ids = lambda label: {r.id for r in g.label(label).collect()}
    assert ids("Class") == {"src/main.py:Settings", "src/main.py:Runner", "src/parts/box.py:Box"}
    assert {"src/main.py:Runner:begin", "src/main.py:make_runner", "src/parts/box.py:Box:get", "cmd/a.go:Open"} <= ids("Function")
    assert ids("Module") == {"src", "src.parts", "tests", "cmd"} and len(ids("File")) == 5
    assert ids("Variable") == {"src/main.py:LIMIT", "src/main.py:Settings:host"}
    f = {r.id: r for r in g.functions.collect()}
    assert f["src/main.py:Runner:begin"].is_async and f["src/main.py:Runner:begin"].complexity == 3 and f["src/main.py:Runner:_inner"].visibility == "protected"
    assert f["cmd/a.go:Open"].docstring == "Open opens." and (f["cmd/a.go:Open"].start_line, f["cmd/a.go:Open"].end_line) == (4, 6)
    m = "src/main.py:"
    assert edges(g, "EXTENDS") == {("EXTENDS", m + "Runner", m + "Settings")}
    assert {(m + "make_runner", m + "Runner:begin"), (m + "main", m + "make_runner"), (m + "main", m + "Settings:as_map"), ("src/parts/box.py:Box:get", "src/parts/box.py:Box:get")} <= {x[1:] for x in edges(g, "CALLS")}
    assert ("USES_CLASS", "src/parts/box.py:Box:get", m + "Settings") in edges(g, "USES_CLASS")
    assert ("INSTANTIATES", m + "make_runner", m + "Runner") in edges(g, "INSTANTIATES")
    assert edges(g, "IMPORTS_FROM", "DEPENDS_ON") == {(t, "src/parts/box.py", "src/main.py") for t in ("IMPORTS_FROM", "DEPENDS_ON")}
    assert edges(g, "TESTS") == {("TESTS", "tests/test_main.py:test_make_runner", m + "make_runner")}


def test_update_equals_full_index(spark, stored, tmp_path):
    new = {**FILES, "src/main.py": MAIN.replace("class Runner(Settings)", "class Runner").replace("def main", "def start"), "src/extra.py": "class Late(Settings):\n    pass\n"}
    del new["src/parts/box.py"]
    root = put(tmp_path / "repo", new)
    full, part = Store(spark, str(tmp_path / "full")), Store(spark, str(tmp_path / "part"))
    sources = repository.read_repository(spark, str(root), "r")
    full.ingest(sources)
    part.ingest(repository.read_repository(spark, str(put(tmp_path / "old", FILES)), "r"))
    part.update(sources, spark.createDataFrame([("r", p) for p in ("src/main.py", "src/extra.py", "src/parts/box.py")], "repo_id string, path string"))
    a, b = full.load(), part.load()
    for label in a.nodes:
        columns = [c for c in a.label(label).columns if c != "last_indexed"]
        assert a.label(label).select(*columns).exceptAll(b.label(label).select(*columns)).count() == b.label(label).select(*columns).exceptAll(a.label(label).select(*columns)).count() == 0, label
    every = sorted({r.rel_type for r in a.raw_edges.collect()} | {r.rel_type for r in b.raw_edges.collect()})
    assert edges(a, *every) == edges(b, *every) and ("EXTENDS", "src/extra.py:Late", "src/main.py:Settings") in edges(b, "EXTENDS")


def test_remove_repair_rebuild(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    sources = spark.createDataFrame([("r", "a.py", "def f():\n    g()\ndef g():\n    pass\n"), ("q", "a.py", "class A:\n    pass\n"), ("q", "b.py", None), ("q", "c.txt", "x")], "repo_id string, path string, source string")
    store.ingest(sources)
    assert store.delete_orphans() == {"Function": 0, "Class": 0}
    assert store.rebuild_edges() == 0
    g = store.load()
    store.write(queries.replace(g, raw_edges=g.raw_edges.filter("rel_type <> 'CALLS' and (rel_type <> 'DEFINES_FUNCTION' or dst_id <> 'a.py:f')")), store.rows(), link_tests=False)
    assert edges(store.load(), "CALLS") == set() and store.rebuild_edges() == 1 and edges(store.load(), "CALLS") == {("CALLS", "a.py:f", "a.py:g")}
    assert store.delete_orphans() == {"Function": 1, "Class": 0} and store.load().functions.count() == 2
    store.delete_orphans(dry_run=False)
    assert [r.id for r in store.load().functions.collect()] == ["a.py:g"] and edges(store.load(), "CALLS") == set()
    assert store.remove_repository("q") and not store.remove_repository("q")
    assert store.load().classes.count() == 0 and store.load().functions.count() == 1


def test_parse_of_odd_files(spark):
    s = spark.createDataFrame([("r", "a.py", "def ("), ("r", "b.go", ""), (None, "c.rs", "fn f() {}"), ("r", None, "x"), ("r", "d.java", None)], "repo_id string, path string, source string")
    rows = parse_sources(s)
    assert {r.kind for r in rows.collect()} == {"Function", "Edge"} and pipeline.failures(rows).count() == 0
    assert parse_sources(s.limit(0)).count() == 0


def test_tools(stored):
    g = stored.load()
    ask = lambda name, **a: json.loads(tools.call(g, name, a)[0])
    assert ask("search_code", query="make_runner", type="function")["results"][0]["id"] == "src/main.py:make_runner"
    assert [r["type"] for r in ask("search_code", query="Settings", limit=5)["results"]][0] == "class"
    assert ask("search_code", query="nothing here")["results"] == [] and ask("search_code", query="x", type="odd")["results"] == []
    assert ask("get_function_details", function_name="main")["id"] == "src/main.py:main" and "error" in ask("get_function_details", function_name="no")
    assert ask("get_class_details", class_name="Runner")["ancestors"] == "Settings"
    assert [r["id"] for r in ask("get_callers", function_id="src/main.py:make_runner", limit="x")] == ["src/main.py:main", "tests/test_main.py:test_make_runner"]
    assert ask("analyze_change_impact", function_id="src/main.py:main", limit=1)[0]["distance"] == 1
    assert len(ask("get_complexity_hotspots", limit=2)) == 2 and ask("health_check")["status"] == "healthy"
    assert tools.call(g, "nope") == ("Unknown tool: nope", True)
    assert tools.call(g, "get_callers", {}) == ("Missing required argument: 'function_id'", True)
    for name in set(tools.TOOLS) - {"search_code"}:
        args = {"function_id": "src/main.py:main", "class_name": "Runner", "file_path": "src/main.py", "entity_id": "src/main.py:Runner"}
        assert not tools.call(g, name, args)[1], name


def test_limits(spark):
    assert [clamp(x, 7) for x in (None, "x", "5", 0, -3, 999, 2.9)] == [7, 7, 5, 1, 1, 200, 2]
    d = spark.createDataFrame([("a", i, i % 3) for i in range(9)] + [("b", 1, 1)], "k string, i int, v int")
    assert [(r.k, r.i, r["rank"]) for r in top_k(d, [F.col("v").desc(), F.col("i")], 2, ["k"]).orderBy("k", "rank").collect()] == [("a", 2, 1), ("a", 5, 2), ("b", 1, 1)]
    assert top_k(d.limit(0), [F.col("i")], 2).count() == 0 and [r.i for r in top_k(d, [F.col("i").desc()], 2).orderBy("rank").collect()] == [8, 7]


def test_semantic_search(stored):
    g = stored.load()
    v = g.spark.createDataFrame([("Function", "r", "src/main.py:main", [1.0, 0.0]), ("Class", "r", "src/main.py:Runner", [0.9, 0.1]), ("Class", "r", "src/main.py:Settings", [-1.0, 0.0])], "label string, repo_id string, id string, embedding array<double>")
    got = queries.search_semantic(g, "", 5, vector=[1.0, 0.0], vectors=v).orderBy("rank").collect()
    assert [(r.type, r.name) for r in got] == [("function", "main"), ("class", "Runner")] and got[0].location == "src/main.py"


def test_path_guard(tmp_path):
    assert repository.guarded(str(tmp_path / "a"), str(tmp_path)) == str((tmp_path / "a").resolve()) and repository.guarded("/x") == "/x"
    for bad in (str(tmp_path) + "x", str(tmp_path / ".." / "y"), "/"):
        with pytest.raises(ValueError):
            repository.guarded(bad, str(tmp_path))


def test_git_and_command_line(spark, tmp_path, capsys):
    root = put(tmp_path / "repo", {"a.py": "def f():\n    pass\n", "b.py": "x = 1\n"})
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    git("init")
    git("add", "a.py")
    git("commit", "-m", "1")
    store = ["--store", str(tmp_path / "store")]
    assert cli.main([*store, "index", str(root), "--repo", "r"]) == 0
    put(root, {"a.py": "def g():\n    pass\n", "c.md": "x"})
    git("add", ".")
    git("commit", "-m", "2")
    assert repository.git_changes(str(root)) == ["a.py", "b.py", "c.md"] and repository.git_changes(str(tmp_path / "none")) == []
    capsys.readouterr()
    assert cli.main([*store, "index", str(root), "--repo", "r", "--since", "HEAD~1"]) == 0
    assert json.loads(capsys.readouterr().out)["changed"] == ["a.py", "b.py"]
    assert {r.id for r in Store(spark, store[1]).load().functions.collect()} == {"a.py:g"}
    assert cli.main([*store, "search", "g", "--type", "function"]) == 0 and cli.main([*store, "health"]) == 0 and cli.main([*store, "health", "--max-hours", "-1"]) == 1
    assert cli.main([*store, "repair"]) == 0 and cli.main([*store, "remove", "nobody"]) == 1 and cli.main([*store, "remove", "r"]) == 0
    assert cli.main([*store, "hook", str(root)]) == 0 and (root / ".git/hooks/post-commit").read_text().startswith("#!/bin/sh")
    assert cli.main([*store, "hook", str(root), "--remove"]) == 0 and not (root / ".git/hooks/post-commit").exists()
    (root / ".git/hooks/post-commit").write_text("#!/bin/sh\necho mine\n")
    assert cli.main([*store, "hook", str(root)]) == 1
