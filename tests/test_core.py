from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import hierarchy, intervals, paths, references
from weftgraph.operators.dedup import keep_first, upsert
from weftgraph.parse import braces, python_source
from weftgraph.plans import catalog
from weftgraph.sources.tables import load_graph


def edges(spark, text):
    return spark.createDataFrame([("r", *x.split(">")) for x in text.split()], "repo_id string, src_id string, dst_id string")


def test_reach_and_walks(spark):
    e, seed = edges(spark, "a>d a>b b>d"), spark.createDataFrame([("r", "a")], "repo_id string, id string")
    assert {(r.id, r.distance) for r in paths.reach(e, seed, 3).collect()} == {("d", 1), ("b", 1)}
    assert {(r.id, r.depth) for r in paths.walks(e, seed, 2).collect()} == {("d", 1), ("b", 1), ("d", 2)}


def test_cycles(spark):
    got = {tuple(r.cycle) for r in paths.cycles(edges(spark, "a>a a>b b>a c>a"), 2, 5).collect()}
    assert ("a", "b", "a") in got and ("a", "a", "b", "a") in got and not any("c" in c for c in got)
    assert paths.cycles(edges(spark, "a>a")).count() == 0


def test_dedup(spark):
    d = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), (None, 1, "z")], "k string, v int, t string")
    assert {r.t for r in keep_first(d, ["k"], [F.col("v").desc()]).collect()} == {"y", "z"}
    assert {r.t for r in upsert(d.filter("v = 1"), d.filter("v = 2"), ["k"], [F.col("v")]).collect()} == {"y", "z"}


def classes_of(spark, text):
    """Classes by name with their bases: "b(a) c(b,d)"."""
    rows = [("r", f"m:{x[0]}", x[0], [b for b in x[2:-1].split(",") if b], None) for x in text.split()]
    return spark.createDataFrame(rows, "repo_id string, id string, name string, base_classes array<string>, interfaces array<string>")


def test_hierarchy(spark):
    links = spark.createDataFrame([("r", c, p, 0) for c, p in ["ba", "cb", "xy", "yx", "zx", "ss"]], "repo_id string, child string, parent string, ord int")
    assert {r.id for r in hierarchy.on_cycle(links).collect()} == {"x", "y", "s"}
    assert {(r.node, r.ancestor) for r in hierarchy.closure(links).collect()} == {(a, b) for a, b in ["ba", "cb", "ca", "xy", "yx", "zx", "zy", "xx", "yy", "ss"]}
    assert hierarchy.on_cycle(links.limit(0)).count() == 0 and hierarchy.closure(links.limit(0)).count() == 0
    got = {r.class_id[2:]: (r.path, r.depth, r.root and r.root[2:], r.descendants, r.on_cycle) for r in hierarchy.hierarchy(classes_of(spark, "a() b(a) c(b,e) e() f() x(y) y(x) z(x) s(s) w(z)")).collect()}
    assert got == {
        "a": ("a", 0, "a", 2, False), "b": ("a/b", 1, "a", 1, False), "c": ("a/b/c", 2, "a", 0, False), "e": ("e", 0, "e", 1, False), "f": ("f", 0, "f", 0, False),
        "x": (None, None, None, 3, True), "y": (None, None, None, 3, True), "z": (None, None, None, 1, False), "s": (None, None, None, 0, True), "w": (None, None, None, 0, False),
    }


def test_long_chain_behind_a_cycle(spark):
    n = 70
    links = [("r", f"n{i:03d}", f"n{i - 1:03d}", 0) for i in range(1, n)] + [("r", "n000", "n001", 0)] + [("r", f"t{i}", f"t{i - 1}", 0) for i in range(1, 40)] + [("r", f"leaf{i}", "t0", 0) for i in range(50)]
    links = spark.createDataFrame(links, "repo_id string, child string, parent string, ord int")
    assert {r.id for r in hierarchy.on_cycle(links).collect()} == {"n000", "n001"}
    assert hierarchy.closure(links).filter("ancestor = 't0'").count() == 89
    assert hierarchy.closure(links).filter("node = 'n069'").count() == 69


def test_bare_names(spark):
    d = spark.createDataFrame([(x,) for x in ["virtual public net::A", "*A", "A<Map<String, B>>", "pkg.mod.A", "A[int]", "A"]], "x string")
    assert {r[0] for r in d.select(hierarchy.bare_name(F.col("x"))).collect()} == {"A"}


def scans(spark, *ids):
    return spark.createDataFrame([("r", i) for i in ids], "repo_id string, scan_id bigint")


def test_incremental_run_survives_failure(spark, tmp_path):
    run = intervals.IncrementalRun(spark, str(tmp_path), compact=2)
    run.run(scans(spark, 1, 2, 5), lambda d: d)

    def fail(d):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        run.run(scans(spark, 1, 2, 3, 5, 9), fail)
    assert {r.scan_id for r in run.pending(scans(spark, 1, 2, 3, 5, 9)).collect()} == {3, 9}
    run.run(scans(spark, 1, 2, 3, 5, 9), lambda d: d)
    assert sorted(r.scan_id for r in run.output().collect()) == [1, 2, 3, 5, 9]
    assert run.pending(scans(spark, 1, 2, 3, 5, 9)).count() == 0
    assert {(r.lo, r.hi) for r in run.ledger().collect()} == {(1, 3), (5, 5), (9, 9)}
    run.run(scans(spark, 4, 5), lambda d: d)
    assert {(r.lo, r.hi) for r in run.ledger().collect()} == {(1, 5), (9, 9)} and [c["whole"] for c in run.commits()] == [False, True, False]


def test_record_that_arrives_while_a_run_writes(spark, tmp_path):
    source = str(tmp_path / "source")
    scans(spark, 1, 2).write.parquet(source)
    run = intervals.IncrementalRun(spark, str(tmp_path / "store"))

    def late(d):
        scans(spark, 3).write.mode("append").parquet(source)
        return d

    run.run(spark.read.parquet(source), late)
    assert {r.scan_id for r in run.output().collect()} == {1, 2}
    assert {r.scan_id for r in run.pending(spark.read.parquet(source)).collect()} == {3}


def test_two_runs_at_once(spark, tmp_path):
    a, b = intervals.IncrementalRun(spark, str(tmp_path)), intervals.IncrementalRun(spark, str(tmp_path))
    inner = []

    def other_first(d):
        if not inner:
            inner.append(b.run(scans(spark, 1, 2), lambda x: x))
        return d

    a.run(scans(spark, 1, 2, 3), other_first)
    assert sorted(r.scan_id for r in a.output().collect()) == [1, 2, 3] and len(a.commits()) == 2
    c = intervals.IncrementalRun(spark, str(tmp_path), attempts=1)

    def again(d):
        b.run(scans(spark, 4), lambda x: x)
        return d

    with pytest.raises(intervals.Conflict):
        c.run(scans(spark, 4), again)
    assert sorted(r.scan_id for r in a.output().collect()) == [1, 2, 3, 4]


def test_records_without_number_or_rows(spark, tmp_path):
    run = intervals.IncrementalRun(spark, str(tmp_path))
    run.run(scans(spark, None, None, 7), lambda d: d)
    assert run.pending(scans(spark, None, 7)).count() == 0 and run.output().count() == 3
    run.run(scans(spark, 1).limit(0), lambda d: d)
    assert run.output().count() == 3


def test_dangling(spark):
    ts = "2025-01-0{} 00:00:00"
    rel = spark.createDataFrame([(1, "r", "CALLS", "f", "gone"), (2, "r", "CALLS", "f", None), (3, "q", "CALLS", "f", "f")], "rel_id bigint, repo_id string, rel_type string, source_id string, target_id string").withColumn("created_at", F.lit(ts.format(1)).cast("timestamp"))
    fn = spark.createDataFrame([("r", "f", ts.format(1), None), ("r", "gone", ts.format(1), None), ("r", "gone", ts.format(2), ts.format(2))], "repo_id string, id string, p string, d string").select("repo_id", "id", F.col("p").cast("timestamp").alias("parsed_at"), F.col("d").cast("timestamp").alias("deleted_at"))
    repos = spark.createDataFrame([("r",)], "repo_id string")
    files = spark.createDataFrame([], "repo_id string, path string, scanned_at timestamp, scan_id bigint, is_deleted boolean")
    assert {(r.rel_id, r.side) for r in references.dangling(rel, repos, files, fn, fn).collect()} == {(1, "target"), (3, "source"), (3, "target")}
    assert references.dangling(rel.limit(0), repos, files, fn, fn).count() == 0

    def after(*batches):
        counts = references.no_counts(batches[0])
        for b in batches:
            counts = references.apply_changes(counts, b)
        return {(r.rel_id, r.side) for r in references.leading_to(references.orphan_keys(counts), rel).collect()}

    none, early = fn.limit(0), fn.filter("deleted_at is null")
    step = lambda rels, f: references.changes(rels, repos, files, none, f)
    first = step(rel, early)
    assert after(first) == {(3, "source"), (3, "target")}
    gone = step(rel.limit(0), fn.filter("deleted_at is not null"))
    assert after(first, gone) == after(gone, first) == after(first, gone, gone) == {(1, "target"), (3, "source"), (3, "target")}
    back = step(rel.filter("rel_id = 1").withColumn("sign", F.lit(-1)), none)
    assert after(first, gone, back) == {(3, "source"), (3, "target")}


def test_parsers():
    got = python_source.parse("m.py", "import os\nclass A(B):\n    def f(self, x: int = 1) -> int:\n        return g(x)\ndef g(x):\n    return A()\n")
    ids = {r[2].get("id") for r in got.rows}
    assert {"m.py:A", "m.py:A:f", "m.py:g", "m.py:import:os"} <= ids
    assert python_source.parse("m.py", "def (").rows == []
    rust = {r[2].get("id") for r in braces.parse("rust", "a.rs", "pub struct S { a: i32 }\nimpl S {\n    fn f(&self) -> i32 { 1 }\n}\n").rows}
    assert {"a.rs:S", "a.rs:S:f"} <= rust
    assert braces.use_tree("std::{io::{Read, Write}, fmt::Debug as D}") == [("std::io::Read", "Read"), ("std::io::Write", "Write"), ("std::fmt::Debug", "D")]


def test_graph_questions_from_every_function(spark):
    d = "/root/testdata/sf0.001"
    g, every = load_graph(spark, d), catalog.queries()
    names = {(r.repo_id, r.id): r.name for r in g.functions.select("repo_id", "id", "name").collect()}
    out = defaultdict(set)
    for r in g.rel("CALLS").select("repo_id", "src_id", "dst_id").collect():
        out[r.repo_id, r.src_id].add(r.dst_id)
    reached, walked = set(), set()
    for repo, start in names:
        for a in out[repo, start]:
            walked.add((repo, start, a, 1))
            walked |= {(repo, start, b, 2) for b in out[repo, a] if not (a == start and b == a)}
        seen, level = {start}, {start}
        for k in (1, 2, 3):
            level = {y for x in level for y in out[repo, x]} - seen
            seen |= level
            reached |= {(repo, start, x, k) for x in level}
    assert len({x[:2] for x in reached}) > 43
    assert {(r.repo_id, r.function_id, r.id, r.distance) for r in every["impact"](spark, d).collect()} == {x for x in reached if (x[0], x[2]) in names}
    assert {(r.repo_id, r.source_id, r.callee_id, r.depth) for r in every["call_graph"](spark, d).collect()} == {x for x in walked if (x[0], x[2]) in names}
    uses = defaultdict(list)
    for r in g.rel("CALLS", "USES_CLASS").select("repo_id", "src_id", "rel_type", "dst_id").collect():
        uses[r.repo_id, r.src_id].append((r.rel_type, r.dst_id))
    same = {}
    for (repo, a), x in uses.items():
        for (other, b), y in uses.items():
            if other == repo and a != b and (repo, a) in names and (repo, b) in names and (n := sum(u in y for u in x)):
                same[repo, a, b] = round(n / len(x), 9)
    assert {(r.repo_id, r.function_id, r.id): round(r.similarity, 9) for r in every["similar_functions"](spark, d).collect()} == same


def test_vectors_for_every_query(spark):
    d = "/root/testdata/sf0.001"
    v = {r.vec_id: r.embedding for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    length = {k: sum(x * x for x in a) ** 0.5 for k, a in v.items()}
    want = {(k, i): s for k in v if k % 20 == 0 for i in v if (s := (1 + sum(x * y for x, y in zip(v[k], v[i], strict=True)) / length[k] / length[i]) / 2) > 0.3}
    got = {(r.query_id, r.vec_id): r.score for r in catalog.queries()["search_vector"](spark, d).collect()}
    assert len({k for k, _ in want}) > 1 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
