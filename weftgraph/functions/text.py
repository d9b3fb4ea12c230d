"""Full-text and vector scoring built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Usual BM25 parameters.
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-cased ASCII word terms of a text; null and empty texts give an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), lambda t: t != F.lit(""))


def inverted_index(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf, doc_len): one row per term of a document, counted on the map side."""
    t = docs.select(*keys, terms(F.col(text)).alias("terms")).withColumn("doc_len", F.size("terms"))
    return t.select(*keys, "doc_len", F.explode("terms").alias("term")).groupBy(*keys, "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, keys: list[str], text: str, query: str) -> DataFrame:
    """(keys, score) of the documents that hold a term of ``query``.

    Only the query's terms are exploded, so nothing but matching (document, term) rows is shuffled; corpus size and mean
    length are one global aggregate over documents with a text.
    """
    wanted = sorted({t for t in "".join(c if (c.isascii() and c.isalnum()) or c == "_" else " " for c in query.lower()).split()})
    t = docs.select(*keys, terms(F.col(text)).alias("terms")).filter(F.size("terms") > 0)
    stats = t.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms").cast("double")).alias("avg_len"))

    def _times(word: str) -> Column:
        return F.size(F.filter("terms", lambda x: x == F.lit(word)))

    hit = t.select(
        *keys, F.size("terms").alias("doc_len"),
        F.explode(F.array(*[F.struct(F.lit(w).alias("term"), _times(w).alias("tf")) for w in wanted])).alias("h"),
    ).filter("h.tf > 0").select(*keys, "doc_len", "h.term", "h.tf")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    scored = hit.join(F.broadcast(df), "term").join(F.broadcast(stats))
    return scored.groupBy(*keys).agg(F.sum(idf * tf).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays of equal length in double precision; a zero vector gives null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column) -> Column:
    """A float array as doubles of length 1; null for a zero vector."""
    d = F.transform(a, lambda x: x.cast("double"))
    norm = F.sqrt(dot(d, d))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm))


def joined(values: Column) -> Column:
    """Sorted, joined form of a collected set, so that results compare as plain strings."""
    return F.array_join(F.array_sort(values), ",")
