"""Suffix to language and parser, and the parse of a table of sources to entity rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.parse import braces, python_source
from weftgraph.parse.records import Records

# The languages and their suffixes.
LANGUAGES: dict[str, tuple[str, ...]] = {
    "Python": (".py", ".pyw"),
    "TypeScript": (".ts", ".tsx", ".js", ".jsx"),
    "Java": (".java",),
    "Go": (".go",),
    "Rust": (".rs",),
    "C/C++": (".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hxx"),
}
_BRACES = {"TypeScript": "ts", "Java": "java", "Go": "go", "Rust": "rust", "C/C++": "cpp"}
SUFFIXES: dict[str, str] = {s: name for name, suffixes in LANGUAGES.items() for s in suffixes}

ROWS = "repo_id string, path string, kind string, ordinal int, payload string"


def suffix_of(path: Column) -> Column:
    """The suffix of the file name, lower case; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def language_of(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, suffix_of(path)), F.lit("Unknown"))


def parser_of(language: str) -> Callable[[str, str], Records] | None:
    if language == "Python":
        return python_source.parse
    family = _BRACES.get(language)
    return (lambda path, source: braces.parse(family, path, source)) if family else None


def parse_sources(sources: DataFrame) -> DataFrame:
    """(repo_id, path, kind, ordinal, payload) of every entity, raw name and detected relationship in ``sources``
    (repo_id, path, source). One pass per file; a file that a parser cannot take gives a row of kind Failed.

    Null paths and sources and unknown suffixes give nothing. Equal files give equal rows once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for repo, path, language, source in zip(b["repo_id"], b["path"], b["language"], b["source"], strict=True):
                try:
                    rows = parser_of(language)(path, source).rows
                except Exception as e:  # noqa: BLE001 - one broken file must not end the job
                    rows = [("Failed", 0, {"error": f"{type(e).__name__}: {e}"})]
                out += [(repo, path, kind, i, json.dumps(payload)) for kind, i, payload in rows]
            yield pd.DataFrame(out, columns=["repo_id", "path", "kind", "ordinal", "payload"])

    s = sources.select("repo_id", "path", "source").filter("path is not null and source is not null")
    s = s.groupBy("repo_id", "path").agg(F.max("source").alias("source")).withColumn("language", language_of(F.col("path"))).filter("language <> 'Unknown'")
    return s.select("repo_id", "path", "language", "source").mapInPandas(run, ROWS)
