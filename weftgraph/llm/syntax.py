"""Source files that do not parse: lexed rows, adjacent token pairs, nesting and level productions.

1. Lex: every file becomes a string of token classes and its set of adjacent pairs (one pass per file, no shuffle).
2. Pairs: the exploded pairs are anti-joined with the pairs that the language's grammar permits (a few thousand rows per
   language, fixed by the grammars, so they are broadcast).
3. Nesting: the classes are cut at brackets and exploded to rows. Windows give the depth of every row and pair each bracket
   with its partner by level; unpaired or crossed brackets are errors. Innermost plain groups are reduced before exploding.
4. Productions: each file's classes must be accepted by the grammar's recogniser, which judges a group by the productions
   that may open it where it stands (one pass per file, no shuffle).

The suffix of the path decides the language. Files with another suffix, null paths and null sources are not judged; an
empty file and one of comments only are valid; repeated rows count once. A file is lexed in one piece, so a file is bounded
by an executor's memory. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.grammar import grammar, recogniser
from weftgraph.llm.lexers import ERROR, SUFFIXES, lex
from weftgraph.llm.rules import RULES
from weftgraph.session import scratch, spread

KEY = ["h1", "h2"]


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for s, lang in SUFFIXES.items():
        out = F.when(suffix == s, lang).otherwise(out)
    return out


def lexed(files: DataFrame) -> DataFrame:
    """(h1, h2, lang, error, codes, pairs): one row per different (repo_id, path, source); h1, h2 are its key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = [lex(lang, s) for lang, s in zip(b["lang"], b["source"], strict=True)]
            ends = ["^" + c + "$" for c in codes]
            pairs = [sorted({ord(x) << 16 | ord(y) for x, y in set(zip(t, t[1:], strict=False))}) for t in ends]
            yield pd.DataFrame({"h1": b["h1"], "h2": b["h2"], "lang": b["lang"], "error": [ERROR in c for c in codes], "codes": codes, "pairs": pairs})

    src = files.select(
        F.xxhash64("source", "path", "repo_id").alias("h1"), F.xxhash64("repo_id", "path", F.length("source")).alias("h2"),
        language_of(F.col("path")).alias("lang"), "source",
    ).filter("lang is not null and source is not null")
    out = spread(src).mapInPandas(run, "h1 bigint, h2 bigint, lang string, error boolean, codes string, pairs array<int>")
    return out.groupBy(*KEY).agg(F.first("lang").alias("lang"), F.first("error").alias("error"), F.first("codes").alias("codes"), F.first("pairs").alias("pairs"))


def permitted(spark: SparkSession) -> DataFrame:
    """(lang, pair): the pairs that the grammars permit. Their number is fixed by the grammars."""
    rows = [(lang, ord(p[0]) << 16 | ord(p[1])) for lang in RULES for p in sorted(grammar(lang).pairs)]
    return spark.createDataFrame(rows, "lang string, pair int")


def wrong_pairs(tokens: DataFrame) -> DataFrame:
    """Keys of files with a pair that no production permits."""
    pairs = tokens.select(*KEY, "lang", F.explode("pairs").alias("pair"))
    return pairs.join(F.broadcast(permitted(tokens.sparkSession)), ["lang", "pair"], "left_anti").select(*KEY)


def reduced(codes: Column) -> Column:
    """Innermost plain groups as one character: their brackets pair."""
    c = F.regexp_replace(codes, r"\((?:[ins](?:,[ins])*+)?\)", "P")
    return F.regexp_replace(F.regexp_replace(c, r"\[[ins]?\]", "B"), r"\{\}", "C")


def bracket_rows(tokens: DataFrame) -> DataFrame:
    """(key, lang, pos, piece, bracket, opens, depth): the classes cut before each bracket, with running depth."""
    pieces = F.posexplode(F.split(reduced(F.col("codes")), r"(?=[(\[{)\]}])")).alias("pos", "piece")
    r = tokens.filter("codes <> ''").select(*KEY, "lang", pieces)
    first = F.substring("piece", 1, 1)
    r = r.withColumn("bracket", F.when(first.isin(*"([{)]}"), first)).withColumn("opens", F.when(first.isin(*"([{"), 1).when(first.isin(*")]}"), -1).otherwise(0))
    return r.withColumn("depth", F.sum("opens").over(Window.partitionBy(*KEY).orderBy("pos")))


def wrong_nesting(rows: DataFrame) -> DataFrame:
    """Keys of files whose brackets do not pair: on each level they must alternate, an opening one before its closing one."""
    b = rows.filter("opens <> 0").select(*KEY, "pos", "bracket", "opens", F.when(F.col("opens") < 0, F.col("depth") + 1).otherwise(F.col("depth")).alias("level"))
    w = Window.partitionBy(*KEY, "level").orderBy("pos")
    before, after = F.lag("bracket").over(w), F.lead("bracket").over(w)
    partner = F.translate("bracket", "([{)]}", ")]}([{")
    good = F.when(F.col("opens") > 0, after.eqNullSafe(partner)).otherwise(before.eqNullSafe(partner))
    return b.select(*KEY, good.alias("good")).filter(~F.col("good")).select(*KEY)


def wrong_levels(tokens: DataFrame) -> DataFrame:
    """Keys of files whose text or one of whose groups no production accepts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = [recogniser(lang).accepts(codes) for lang, codes in zip(b["lang"], b["codes"], strict=True)]
            yield b.loc[[not g for g in good], KEY]

    return tokens.select(*KEY, "lang", "codes").mapInPandas(run, "h1 bigint, h2 bigint")


def broken_keys(tokens: DataFrame) -> DataFrame:
    clean = tokens.filter(~F.col("error"))
    return (
        tokens.filter("error").select(*KEY).unionByName(wrong_pairs(tokens)).unionByName(wrong_nesting(bracket_rows(clean))).unionByName(wrong_levels(clean)).distinct()
    )


def judged(files: DataFrame) -> DataFrame:
    """(repo_id, path, language, broken) of every file with a known suffix. The lexed table is written once to the shared folder."""
    path = scratch(files.sparkSession, "lexed")
    lexed(files).write.parquet(path)
    tokens = files.sparkSession.read.parquet(path)
    bad = broken_keys(tokens).withColumn("broken", F.lit(True))
    keyed = files.select(
        "repo_id", "path", language_of(F.col("path")).alias("language"), F.xxhash64("source", "path", "repo_id").alias("h1"), F.xxhash64("repo_id", "path", F.length("source")).alias("h2"), F.col("source").isNotNull().alias("has")
    ).filter("has and language is not null")
    return keyed.join(bad, KEY, "left").select("repo_id", "path", "language", F.coalesce("broken", F.lit(False)).alias("broken")).distinct()


def broken(files: DataFrame) -> DataFrame:
    """(repo_id, path) of the files that are not valid in the language of their suffix."""
    return judged(files).filter("broken").select("repo_id", "path").distinct()


def rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, broken, rate)."""
    g = judged(files).groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count_if("broken").alias("broken"))
    return g.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))
