"""Mixing sources to target weights with a capped number of repeats.

``total`` is the wanted size in tokens. Every source gets its share of it (target shares renormalised over the sources with a
target and texts), at most its tokens times ``max_repeats``; what a source falls short of is reported. Without a total the
largest one is taken at which no source falls short, so the shares are met exactly and larger sources are used in part.

A source's texts stand in a shuffled order that is drawn anew for every repeat; the stream is cut into blocks of equal
tokens, a text belonging to the block in which it starts. Block slots are dealt to the sources by a low-discrepancy sequence:
slot i falls on the golden-ratio point frac((i + 1/2) * phi), and the cumulative weights map it to a source, so every stretch
of the mixture holds each source in its share. The k-th slot of a source takes its k-th block.

Running sums and ranks are two-level (per bucket, then over the few buckets), so a source with a third of all texts is never
sorted in one task. Only the quotas, one row per source with a target, come to the driver. Source names are compared without
letter case, outer blanks and kind of separator. Null sources, sources without a target, and null or empty texts (no tokens)
are not mixed. Repeated rows of a doc_id count once. Sources with a target but no texts, or a zero share, are reported with
zero. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.tokens import TOKENIZERS, encoder
from weftgraph.session import cut, spread

#: Tokens of a block, and buckets of the two-level sums.
BLOCK, BUCKETS = 4096, 64
#: Tokens that a bucket holds on average once there are more than BUCKETS of them.
BUCKET_TOKENS = 20_000_000
PHI = 0.6180339887498949


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def sizes(docs: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, source, tokens) of texts with tokens, one row per doc_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, _ = encoder(folder, name)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    d = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text").filter("source is not null and text is not null and text <> ''")
    counted = spread(d).mapInPandas(run, "doc_id bigint, source string, tokens bigint")
    return counted.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")).filter("tokens > 0")


def quotas(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, available, wanted, quota): one row per source with a target.

    ``wanted`` is the source's share of the total, ``quota`` what of it the source can give. The rows are computed once and
    held by the driver: as many as there are targets.
    """
    t = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = [r.asDict() for r in t.join(have, "source", "left").orderBy("source").collect()]
    for r in rows:
        r["available"] = r["available"] or 0
        r["most"] = r["available"] * (r["max_repeats"] or 0)
        r["usable"] = r["most"] > 0 and (r["target_share"] or 0) > 0
    whole = sum(r["target_share"] for r in rows if r["usable"])
    for r in rows:
        r["share"] = r["target_share"] / whole if r["usable"] else 0.0
    size = min((r["most"] / r["share"] for r in rows if r["usable"]), default=0) if total is None else total
    out = []
    for r in rows:
        wanted = math.floor(size * r["share"])
        out.append((r["source"], r["target_share"], r["share"], r["max_repeats"], r["available"], wanted, min(wanted, r["most"]) if r["usable"] else 0))
    return sized.sparkSession.createDataFrame(out, "source string, target_share double, share double, max_repeats int, available bigint, wanted bigint, quota bigint")


def _prefix(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` before each row, per keys in (bucket, order): sums per bucket first, then within it."""
    per = df.groupBy(*keys, "bucket").agg(F.sum(value).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.select(*keys, "bucket", before.alias("__base"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__within", within).join(base, [*keys, "bucket"]).withColumn(out, F.col("__base") + F.col("__within")).drop("__base", "__within")


def blocks(sized: DataFrame, quota: DataFrame, seed: int = 0) -> DataFrame:
    """(source, round, doc_id, tokens, block): the shuffled stream of every source up to its quota, cut into blocks."""
    total = sum(r["available"] for r in quota.select("available").collect())
    s = sized.join(F.broadcast(quota.filter("quota > 0").select("source", "quota", "available", "max_repeats")), "source")
    rounds = F.least(F.col("max_repeats").cast("bigint"), F.ceil(F.col("quota") / F.col("available"))).cast("int")
    s = s.withColumn("round", F.explode(F.sequence(F.lit(0), rounds - 1)))
    buckets = BUCKETS + total // BUCKET_TOKENS
    s = s.withColumn("at", F.xxhash64(F.lit(seed), "round", "doc_id"))
    s = s.withColumn("bucket", F.col("round").cast("bigint") * buckets + F.pmod(F.shiftrightunsigned("at", 32), F.lit(buckets)))
    s = _prefix(s, ["source"], ["at", "doc_id"], "tokens", "start").filter("start < quota")
    return s.select("source", "round", "doc_id", "tokens", F.floor(F.col("start") / BLOCK).alias("block"))


def slots_needed(quota: list[int]) -> int:
    """Slots after which every source has met as many as it has blocks.

    Of the first n golden-ratio points an interval of length w holds at least n * w - 2 * (3 + 3.12 * ln n) (the discrepancy
    bound of sequences with bounded partial quotients), so the slots never run short.
    """
    whole, most = sum(quota), 1.0
    for q in quota:
        need = -(-q // BLOCK)
        n = max(need * whole / q, 2.0)
        for _ in range(60):
            n = (need + 6 + 6.24 * math.log(n)) * whole / q
        most = max(most, n)
    return math.ceil(most) if whole else 0


def slots(quota: DataFrame) -> DataFrame:
    """(slot, source, rank): block slots dealt to the sources by golden-ratio points in the cumulative weights of their quotas."""
    rows = [(r["source"], r["quota"]) for r in quota.filter("quota > 0").orderBy("source").collect()]
    whole, at = sum(q for _, q in rows), 0
    source = F.lit(rows[-1][0] if rows else None)
    edges = []
    for name, q in rows:
        at += q
        edges.append((at / whole, name))
    for edge, name in reversed(edges[:-1]):
        source = F.when(F.col("u") < edge, F.lit(name)).otherwise(source)
    points = quota.sparkSession.range(slots_needed([q for _, q in rows])).withColumnRenamed("id", "slot").withColumn("u", F.pmod((F.col("slot") + 0.5) * PHI, F.lit(1.0)))
    dealt = points.select("slot", source.cast("string").alias("source"), F.lit(1).alias("one"))
    ranked = _prefix(dealt.withColumn("bucket", F.floor(F.col("slot") / 4096)), ["source"], ["slot"], "one", "rank")
    return ranked.select("slot", "source", "rank")


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """(slot, source, round, doc_id, tokens): the mixture in block order; a text's round counts its uses from 0."""
    sized = cut(sizes(docs))
    q = quotas(sized, targets, total)
    placed = blocks(sized, q, seed).join(slots(q).withColumnRenamed("rank", "block"), ["source", "block"])
    return placed.select("slot", "source", "round", "doc_id", "tokens")


def report(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0) -> DataFrame:
    """(source, target_share, actual_share, available, wanted, tokens, short, texts, uses, max_uses) of every source with a
    target; ``short`` is what the source falls short of its wanted tokens."""
    sized = cut(sizes(docs))
    q = quotas(sized, targets, total)
    uses = blocks(sized, q, seed).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"))
    g = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"), F.sum("uses").alias("uses"), F.max("uses").alias("max_uses"))
    out = q.select("source", "target_share", "available", "wanted").join(g, "source", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("tokens", "texts", "uses", "max_uses")]
    out = out.select("source", "target_share", "available", "wanted", *zero).withColumn("short", F.greatest(F.col("wanted") - F.col("tokens"), F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target
    return out.withColumn("actual_share", F.when(whole > 0, F.round(F.col("tokens") / whole, 6)).otherwise(0.0))


def available(docs: DataFrame, targets: DataFrame) -> int:
    """Tokens of all texts whose source has a target: the wanted total that leaves no text out for another source's sake."""
    names = F.broadcast(targets.select(source_name(F.col("source")).alias("source")).distinct())
    return sizes(docs).join(names, "source", "left_semi").agg(F.sum("tokens")).first()[0] or 0
