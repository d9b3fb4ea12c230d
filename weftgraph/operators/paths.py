"""Bounded path expansion over an edge table (repo_id, src_id, dst_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import cut


def walks(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Callees at each depth 1..``depth`` of the seeds (repo_id, id), distinct per depth, over edge-unique trails.

    Up to depth 2 an edge can repeat only as a self-loop taken twice, so a level is distinct (start, node) pairs and the
    trail test a predicate on the loop. Beyond, trails carry the nodes they passed: an edge is used again only if its two
    ends stand side by side in them.
    """
    e = edges.select("repo_id", F.col("src_id").alias("at"), F.col("dst_id").alias("next")).distinct()
    first = seeds.select("repo_id", F.col("id").alias("start_id"), F.col("id").alias("at")).distinct().join(e, ["repo_id", "at"])
    first = first.select("repo_id", "start_id", F.array("at", "next").alias("trail"), F.col("next").alias("at"))
    level, out = first, None
    for d in range(1, depth + 1):
        if d == 2 and depth == 2:
            level = level.join(e, ["repo_id", "at"]).filter(~((F.col("at") == F.col("start_id")) & (F.col("next") == F.col("at")))).select("repo_id", "start_id", F.col("next").alias("at")).distinct()
        elif d > 1:
            used = F.exists(F.sequence(F.lit(1), F.size("trail") - 1), lambda i: (F.element_at("trail", i) == F.col("at")) & (F.element_at("trail", i + 1) == F.col("next")))
            level = level.join(e, ["repo_id", "at"]).filter(~used).select("repo_id", "start_id", F.concat("trail", F.array("next")).alias("trail"), F.col("next").alias("at"))
        here = level.select("repo_id", "start_id", F.col("at").alias("id"), F.lit(d).alias("depth"))
        out = here if out is None else out.unionByName(here)
    return out.distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Minimum distance 1..``depth`` from each seed by breadth-first levels; the seed itself is left out.

    A level is the distinct (seed, node) pairs one edge beyond the level before, cut from its lineage; the least distance of
    a pair is taken once, at the end.
    """
    e = edges.select("repo_id", F.col("src_id").alias("at"), F.col("dst_id").alias("next"))
    front = seeds.select("repo_id", F.col("id").alias("start_id"), F.col("id").alias("at"))
    found = None
    for d in range(1, depth + 1):
        front = front.join(e, ["repo_id", "at"]).select("repo_id", "start_id", F.col("next").alias("at")).filter("at <> start_id").distinct()
        front = cut(front) if d < depth else front
        here = front.select("repo_id", "start_id", F.col("at").alias("id"), F.lit(d).alias("distance"))
        found = here if found is None else found.unionByName(here)
    return found.groupBy("repo_id", "start_id", "id").agg(F.min("distance").alias("distance"))


def peel(edges: DataFrame, rounds: int) -> DataFrame:
    """Drop edges that cannot lie on a cycle: their source has no in-edge or their target no out-edge, ``rounds`` times."""
    for _ in range(rounds):
        sources = edges.select("repo_id", F.col("src_id").alias("dst_id")).distinct()
        targets = edges.select("repo_id", F.col("dst_id").alias("src_id")).distinct()
        edges = edges.join(sources, ["repo_id", "dst_id"], "left_semi").join(targets, ["repo_id", "src_id"], "left_semi")
    return edges.select("repo_id", "src_id", "dst_id")


def cycles(edges: DataFrame, shortest: int = 2, longest: int = 5, rounds: int = 3) -> DataFrame:
    """Edge-unique trails a -> ... -> a of ``shortest``..``longest`` edges, one row per rotation.

    Columns: repo_id, start_id, cycle (ids, first = last), cycle_length. A self-loop alone is no row as shortest >= 2.
    Peeling leaves only the cyclic core, so the joins run over few edges.
    """
    shortest = max(2, shortest)
    core = cut(peel(edges.select("repo_id", "src_id", "dst_id").distinct(), rounds))
    e = core.select("repo_id", F.col("src_id").alias("at"), F.col("dst_id").alias("next"), F.xxhash64("src_id", "dst_id").alias("edge"))
    level = e.select("repo_id", F.col("at").alias("start_id"), F.col("next").alias("at"), F.array("at", "next").alias("cycle"), F.array("edge").alias("used"))
    out = None
    for d in range(2, longest + 1):
        level = (
            level.join(e, ["repo_id", "at"])
            .filter(~F.array_contains("used", F.col("edge")))
            .select("repo_id", "start_id", F.col("next").alias("at"), F.concat("cycle", F.array("next")).alias("cycle"), F.concat("used", F.array("edge")).alias("used"))
        )
        if d >= shortest:
            here = level.filter(F.col("at") == F.col("start_id")).select("repo_id", "start_id", "cycle", F.lit(d).alias("cycle_length"))
            out = here if out is None else out.unionByName(here)
    return out.distinct()
