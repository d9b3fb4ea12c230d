"""Encoding of a corpus with a public byte-level BPE by content-defined chunk reuse.

Texts are cut where a rolling hash of the last characters hits a mask, so equal passages of different documents give equal
chunks, wherever they stand. Every distinct chunk is encoded once; a document's ids are its chunks' ids put together.

Most cuts fall between a visible character and a blank. The splitting pattern never holds such a pair inside a piece and
looks forward only, so these joints agree as they are. The other joints (texts without blanks) are repaired: from the start
of the last piece before the joint the text is split and encoded again until a boundary agrees with one of the next chunk's
own boundaries; from there on the chunk's ids hold. The chunks' texts come back from their ids, as the bytes of a
byte-level BPE are exact. The result equals encoding the whole text at once.

What is shuffled: each distinct chunk's text once per task that cuts it, (key, place, chunk key) of every chunk, and the
ids once. A chunk that a third of all documents share is one row on one side and small rows that stream through the join
on the other; it is never collected.

Null and empty texts give an empty list. Repeated rows give one row. Strings that look like special tokens are ordinary
text. Very long texts are cut into many chunks; only a document's own chunks meet in one place. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import spread

#: Folder with the vocabulary files; a parameter of every function here.
TOKENIZERS = os.environ.get("WEFTGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Characters the rolling hash looks at, and the mean distance of cuts: at one in SAFE of the places before a blank, and at
#: one in MEAN_CHUNK of all others.
WINDOW, SAFE, MEAN_CHUNK = 16, 96, 8192


@lru_cache(maxsize=4)
def encoder(folder: str, name: str):
    """(tiktoken encoding, splitting pattern) of a vocabulary file of ranks; one per Python worker."""
    import importlib.util

    import regex
    import tiktoken

    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(files)
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(files.PATTERN)


_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 2**32, 4096, dtype=np.uint32)


_BLANKS = np.array([32, 10, 9, 13], dtype=np.uint32)
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def cuts(texts: list[str], window: int = WINDOW, mean: int = MEAN_CHUNK, safe: int = SAFE) -> list[list[tuple[str, bool]]]:
    """Content-defined chunks of each text, each with whether the cut before it needs no repair. The hash of a place depends
    on the ``window`` characters before it only."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gear = _GEAR[chars & 4095]
    h = np.zeros(len(chars), dtype=np.uint32)
    for k in range(window):
        if k < len(chars):
            h[k:] += gear[: len(chars) - k] << np.uint32(k)
    blank, space = np.isin(chars, _BLANKS), np.isin(chars, _SPACES)
    before_blank = np.zeros(len(chars), dtype=bool)
    before_blank[:-1] = ~space[:-1] & blank[1:]
    high = h >> np.uint32(8)
    places = np.flatnonzero((before_blank & (high % np.uint32(safe) == 0)) | (high % np.uint32(mean) == 0)) + 1
    out, start = [], 0
    for t in texts:
        end = start + len(t)
        lo, hi = np.searchsorted(places, (start + window, end))
        inner = places[lo:hi]
        at = [0, *(inner - start).tolist(), len(t)]
        good = [True, *before_blank[inner - 1].tolist()]
        out.append([(t[a:b], g) for a, b, g in zip(at, at[1:], good, strict=False) if b > a])
        start = end
    return out


def tail_of(pieces: list[str]) -> str:
    """The end of a text whose splitting may change when more text follows: its last pre-token, and the one before if the
    last is a single character (an apostrophe and a letter may become one with the next letter)."""
    return "".join(pieces[-2:]) if len(pieces[-1]) == 1 else pieces[-1]


def join_chunks(parts: list[tuple[str, list[int], int, int]], encode, pattern) -> list[int]:
    """Ids of a text from its chunks (text, ids, length of the tail, number of the tail's ids), joints repaired."""
    text, ids, tail_len, tail_n = parts[0]
    out, tail = list(ids), text[len(text) - tail_len :]
    for text, ids, tail_len, next_n in parts[1:]:
        both, shift = tail + text, len(tail)
        at = own = drop = 0
        pieces: list[str] = []
        while True:
            end = pattern.match(both, at).end()
            pieces.append(both[at:end])
            at = end
            while own < at - shift:
                own_end = pattern.match(text, own).end()
                drop += len(encode(text[own:own_end]))
                own = own_end
            if at >= shift and own == at - shift:
                break
        out = out[: len(out) - tail_n]
        for p in pieces:
            out += encode(p)
        if own > len(text) - tail_len or tail_len == len(text):
            # the joint reaches into the chunk's own tail, or all of the chunk is open: what is open now is the tail of the
            # repaired pieces and the rest
            pieces += pattern.findall(text, own) if own < len(text) else []
            out += ids[drop:]
            tail = tail_of(pieces)
            tail_n = sum(len(encode(p)) for p in (pieces[-2:] if len(pieces[-1]) == 1 else pieces[-1:]))
        else:
            out += ids[drop:]
            tail, tail_n = text[len(text) - tail_len :], next_n
    return out


def repaired(texts: list[str], ids: list[list[int]], safe: list[bool], encode, pattern) -> list[int]:
    """Ids of a text from its chunks: those behind safe cuts are put together, the other joints are repaired."""
    out: list[int] = []
    run: list[tuple[str, list[int], int, int]] = []
    for text, own, good in zip(texts, ids, safe, strict=True):
        if good and run:
            out += join_chunks(run, encode, pattern)
            run = []
        tail = tail_of(pattern.findall(text))
        run.append((text, own, len(tail), sum(len(encode(p)) for p in pattern.findall(tail))))
    return out + join_chunks(run, encode, pattern)


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, safe, k1, k2, chunk) of all non-empty texts; k1 and k2 are two hashes of the chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = cuts(list(b["text"]))
            n = [len(p) for p in parts]
            yield pd.DataFrame({
                "key": np.repeat(b["key"].to_numpy(), n), "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in n]) if n else np.array([], np.int32),
                "safe": [g for p in parts for _, g in p], "chunk": [c for p in parts for c, _ in p],
            })

    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    kind = dict(d.dtypes)["key"]
    c = spread(d).mapInPandas(run, f"key {kind}, pos int, safe boolean, chunk string")
    return c.withColumn("k1", F.xxhash64("chunk")).withColumn("k2", F.xxhash64(F.lit(1), F.reverse("chunk")))


def encode_chunks(chunks: DataFrame, folder: str, name: str) -> DataFrame:
    """(k1, k2, ids): every distinct chunk encoded once. A column function, so the rows stay where the join wants them."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = encoder(folder, name)[0].encode_ordinary
        return pd.Series([encode(t) for t in texts])

    distinct = chunks.groupBy("k1", "k2").agg(F.first("chunk").alias("chunk"))
    return distinct.select("k1", "k2", ids("chunk").alias("ids"))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) of every row, ids exactly those of the public tokenizer ``name``, without special tokens."""

    @F.pandas_udf("array<int>")
    def repair(ids: pd.Series, sizes: pd.Series, safe: pd.Series) -> pd.Series:
        enc, pattern = encoder(folder, name)
        out = []
        for i, n, g in zip(ids, sizes, safe, strict=True):
            ends = np.cumsum(n)
            own = [i[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]
            out.append(repaired([enc.decode_bytes(x).decode() for x in own], own, list(g), enc.encode_ordinary, pattern))
        return pd.Series(out)

    chunks = chunk_table(docs, key, text)
    # repeated rows of a key repeat its chunks
    uses = chunks.select("key", "pos", "safe", "k1", "k2").join(encode_chunks(chunks, folder, name), ["k1", "k2"])
    whole = uses.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "safe", "ids"))).alias("parts"), F.bool_and("safe").alias("plain"))
    once = F.filter("parts", lambda x, i: (i == 0) | (F.get("parts", i - 1)["pos"] != x["pos"]))
    whole = whole.select("key", "plain", once.alias("parts"))
    flat = F.flatten(F.col("parts.ids"))
    plain = whole.filter("plain").select(F.col("key").alias(key), flat.alias("ids"))
    mended = whole.filter("not plain").select(F.col("key").alias(key), repair(flat, F.transform("parts", lambda x: F.size(x["ids"])), F.col("parts.safe")).alias("ids"))
    empty = docs.filter(F.col(text).isNull() | (F.col(text) == "")).select(F.col(key), F.array().cast("array<int>").alias("ids"))
    return plain.unionByName(mended).unionByName(empty.distinct())
