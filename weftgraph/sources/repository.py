"""Repositories on disk as a table of sources: walk, decode, file facts, git changes."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.parse.registry import SUFFIXES, language_of

# Folders that a walk never enters.
IGNORED = (".env", ".git", ".svn", ".venv", "__pycache__", "build", "dist", "env", "node_modules", "venv")


def guarded(path: str, roots: str | None = None) -> str:
    """The resolved path, if it lies under one of ``roots`` (separated as in PATH; none allow any path)."""
    resolved = Path(path).resolve()
    allowed = [Path(r.strip()).resolve() for r in (roots or "").split(os.pathsep) if r.strip()]
    if allowed and not any(resolved == a or a in resolved.parents for a in allowed):
        raise ValueError(f"{resolved} lies under none of the allowed folders")
    return str(resolved)


def read_repository(spark: SparkSession, root: str, repo_id: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(repo_id, path, name, extension, language, source, lines_of_code, content_hash) of every file with a known suffix.

    Files are listed and read by the tasks (binaryFile), folders and suffixes filtered on the path before any content is
    read. Bytes that are no UTF-8 are left out, line ends become newlines. A missing or empty folder gives an empty table.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [bytes(c).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "source": text})

    base = Path(root).resolve().as_uri().rstrip("/") + "/"
    at = F.expr(f"substring(path, {len(base.replace('file:///', 'file:/')) + 1})")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(Path(root).resolve()))
    listed = listed.select(F.url_decode(F.replace(F.regexp_replace(at, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))).alias("path"), "content")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    known = listed.filter((language_of(F.col("path")) != "Unknown") & ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in ignored])))
    texts = known.mapInPandas(decode, "path string, source string")
    hollow = _empty_files(root, ignored)
    if hollow:
        texts = texts.unionByName(spark.createDataFrame([(p, "") for p in hollow], "path string, source string"))
    return with_facts(texts.withColumn("repo_id", F.lit(repo_id)))


def _empty_files(root: str, ignored: tuple[str, ...]) -> list[str]:
    """Paths of empty files with a known suffix: the scan leaves files without bytes out. Only names and sizes are looked at."""
    out = []
    for folder, folders, names in os.walk(Path(root).resolve()):
        folders[:] = [d for d in folders if d not in ignored]
        out += [str((Path(folder) / n).relative_to(Path(root).resolve())) for n in supported(names) if os.path.getsize(Path(folder) / n) == 0]
    return out


def with_facts(sources: DataFrame) -> DataFrame:
    """``sources`` (repo_id, path, source) with name, extension, language, lines_of_code and content_hash."""
    return sources.select(
        "repo_id", "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", r"[^/](\.[^./]*)$", 1).alias("extension"), language_of(F.col("path")).alias("language"), "source",
        F.size(F.split("source", "\n", -1)).alias("lines_of_code"), F.md5(F.col("source").cast("binary")).alias("content_hash"),
    )


def git_changes(root: str, since: str = "HEAD~1", seconds: int = 30) -> list[str]:
    """Paths changed between ``since`` and HEAD, then staged ones, each once in that order; none where git cannot tell."""
    out: dict[str, None] = {}
    for args in (["diff", "--name-only", since, "HEAD"], ["diff", "--name-only", "--cached"]):
        try:
            p = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=seconds, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return []
        if p.returncode and not out and "--cached" not in args:
            return []
        if not p.returncode:
            out |= dict.fromkeys(x.strip() for x in p.stdout.splitlines() if x.strip())
    return list(out)


def supported(paths: list[str]) -> list[str]:
    return [p for p in paths if Path(p).suffix.lower() in SUFFIXES]
