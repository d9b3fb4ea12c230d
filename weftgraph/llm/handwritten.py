"""Generated, minified, vendored and data files, so that only hand-written source remains.

A multi-pattern automaton scans the head comments of each file once for all notice phrases; rules on the path cover
vendored folders, generated suffixes, lockfiles and minified names; measures of the text cover minified scripts, data kept
as code and machine-made accessors without a notice; word shingles against the reference files find copies of known
third-party files with or without changes (five words, similarity 0.8 or more).

Notices count in comments before the first code only, so a string or a doc comment that speaks of generated code is none,
and a notice that is negated or told as a story is none. Null paths are not judged; null and empty sources are judged by
path alone. Repeated rows count once. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import spread

#: Shingle length and similarity of a copy.
SHINGLE, SIMILAR = 5, 0.8

# Phrases of generation and vendoring notices, lower case, and what must stand in the same comment line.
NOTICES = {
    "code generated by": r"^code generated by .*do not edit",
    "do not edit": r"^(?:warning: ?)?(?:this (?:file|code) is (?:auto-?)?generated.*)?do not edit",
    "do not modify": r"^(?:do not modify: output of|generated from .*do not modify)",
    "@generated": r"^@generated\b",
    "auto-generated>": r"^<auto-generated",
    "automatically generated": r"^this (?:file|code|class|module) (?:was|is|has been) (?:automatically|auto-?) ?generated (?:by|from)",
    "auto-generated": r"^(?:this (?:file|code) (?:was|is) )?auto-generated (?:file|by|from|code)\b",
    "autogenerated": r"^(?:this (?:file|code) (?:was|is) )?autogenerated(?:,| by| from|$)",
    "generated by": r"^(?:this (?:file|code) (?:was|is) )?generated by .*(?:do not|version|v?\d)",
    "generated from": r"^(?:this (?:file|code) (?:was|is) )?generated from .*(?:do not|by hand)",
    "generated code": r"^generated code\b.*(?:do not|--)",
    "machine made": r"^machine made by ",
    "machine generated": r"^(?:this (?:file|code) (?:was|is) )?machine[- ]generated\b",
    "produced by": r"^produced by .*(?:at build|manual edits|do not)",
    "output of": r"^(?:do not (?:edit|modify).*)?output of .*(?:do not|\d)",
    "vendored from": r"^vendored from ",
    "contributors": r"^copyright .*contributors",
    "minified": r"^(?:this file (?:was|is) )?minified (?:by|with|using)",
    "wurde von": r"^diese datei wurde (?:automatisch )?von .*(?:erzeugt|generiert|erstellt)\b",
    "automatisch": r"^(?:diese datei wurde )?automatisch (?:erzeugt|generiert|erstellt)\b",
    "généré": r"^(?:(?:ce |le )?(?:fichier|code) )?(?:a été )?(?:auto)?généré (?:automatiquement )?(?:par|à partir)",
    "generado": r"^(?:(?:este |el )?(?:archivo|fichero|código) )?(?:(?:fue|ha sido|es) )?(?:auto)?generado (?:automáticamente )?(?:por|a partir)",
    "gerado": r"^(?:(?:este |o )?(?:arquivo|ficheiro|código) )?(?:foi )?gerado (?:automaticamente )?(?:por|a partir)",
    "generato": r"^(?:(?:questo |il )?(?:file|codice) )?(?:è stato )?generato (?:automaticamente )?(?:da|a partire)",
    "自动生成": r"^(?:此|本|该)?(?:文件|代码)?(?:是)?由?.*自动生成",
    "自動生成": r"^(?:この|本)?(?:ファイル|コード)?.*自動生成",
}
#: A line with one of these tells about generated code, or that it is none any more.
_STORY = re.compile(r"\b(?:not generated|no longer|used to be|says? it|so that nobody|although|method stub|please edit)\b")
VENDOR_DIRS = "vendor third_party thirdparty third-party 3rdparty 3rd_party external extern deps _vendor vendored contrib node_modules bower_components site-packages jspm_packages Godeps".split()
GENERATED_DIRS = "generated __generated__ generated-sources generated-src gen autogen".split()
_GENERATED_NAME = r"(?:_pb2(?:_grpc)?\.pyw?|_pb\.(?:js|ts)|_generated\.\w+|\.pb(?:-c)?\.\w+|\.g\.\w+|\.gen\.\w+|\.generated\.\w+|_gen\.go|_string\.go|\.designer\.\w+|_grpc\.pb\.\w+|zz_generated\.\w+\.go)$"
_LOCK_NAME = r"(?:^|/)(?:package-lock\.json|yarn\.lock|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|pnpm-lock\.yaml)$"
_MINIFIED_NAME = r"[.-](?:min|bundle|packed)\.(?:js|jsx|mjs|cjs|ts|tsx)$"


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in NOTICES:
        a.add_word(phrase, phrase)
    a.make_automaton()
    return a


_HEAD = re.compile(r"﻿?(?:#![^\n]*\n)?((?:\s*(?://[^\n]*|#(?!\s*(?:include|define|pragma|if|ifdef|ifndef|undef)\b)[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?''')\s*)*)")
_STRIP = re.compile(r"^[\s/*#!\"']+|[\s*/\"']+$")


def notice(source: str) -> bool:
    """Whether the comments before the first code hold a notice."""
    head = _HEAD.match(source).group(1)
    if not head:
        return False
    lowered = head.lower()
    hits = {p for _, p in automaton().iter(lowered)}
    if not hits:
        return False
    for line in lowered.split("\n"):
        text = _STRIP.sub("", line)
        if _STORY.search(text):
            continue
        if any(p in text and re.search(NOTICES[p], text) for p in hits):
            return True
    return False


_NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)\b")
_LONG_STRING = re.compile(r"[\"'`][A-Za-z0-9+/=\\|,;:. _-]{60,}[\"'`]")
_COMMENT = re.compile(r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|/\*[\s\S]*?\*/|//[^\n]*|^\s*#(?!include|define)[^\n]*", re.M)
_DOC = re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''")
_NUMBERED = re.compile(r"(?<![A-Za-z0-9])_?(?:[gs]et_?)?(?:[a-zA-Z]|field|Field)_?(\d+)_?\b")
_ACCESSOR = re.compile(r"(?:[gs]et_?|\b_?)(?:[a-zA-Z]|field|Field)_?4_?\b")
_DIGITS, _QUOTES = b"0123456789", b"\"'"


def _kept(m: re.Match[str]) -> str:
    """Strings stay as they are, comments go; what looks like a comment in a string is none."""
    return m.group(1) or ""


# What makes a text data or minified; shares of the text without comments. A list of a few numbers or a long line in a
# hand-written file reaches none of them.
#: Literals that a table of data holds at least.
LITERALS = 30
NUMBER_SHARE, STRING_SHARE, BLOB_SHARE = 0.55, 0.7, 0.5
#: Blanks of a minified text at most; characters of its lines on average, or of one line and its share.
BLANKS, MEAN_LINE, ONE_LINE, ONE_SHARE = 0.12, 150, 400, 0.3


def machine_made(source: str) -> bool:
    """Minified text, data kept as code, or accessors numbered by a tool.

    Counts of bytes come first and rule out most texts: no criterion can hold where they fail.
    """
    n = len(source)
    raw = source.encode("utf-8", "replace")
    digits = len(raw) - len(raw.translate(None, _DIGITS))
    quotes = len(raw) - len(raw.translate(None, _QUOTES))
    longest = max(map(len, source.split("\n")))
    body = None
    if longest >= MEAN_LINE:
        body = _COMMENT.sub(_kept, source)
        bare = _DOC.sub("", body).strip()
        lengths = [len(x) for x in bare.split("\n") if x.strip()] or [0]
        whole = sum(lengths)
        if bare.count(" ") < BLANKS * len(bare) and (whole / len(lengths) > MEAN_LINE or max(lengths) > max(ONE_LINE, ONE_SHARE * whole)):
            return True
    if longest >= 60 and _RUN.search(source):
        body = body or _COMMENT.sub(_kept, source)
        if sum(len(x) for x in _LONG_STRING.findall(body)) > BLOB_SHARE * len(body):
            return True
    if digits > 0.15 * n or (digits > 0.04 * n and quotes > 0.05 * n):
        body = body or _COMMENT.sub(_kept, source)
        numbers = _NUMBER.findall(body)
        if len(numbers) >= LITERALS and sum(map(len, numbers)) + 2 * len(numbers) > NUMBER_SHARE * len(body):
            return True
    if quotes >= 2 * LITERALS and quotes > 0.05 * n:
        body = body or _COMMENT.sub(_kept, source)
        strings = re.findall(r"\"[^\"\n]*\"|'[^'\n]*'", body)
        if len(strings) >= LITERALS and sum(map(len, strings)) + len(strings) > STRING_SHARE * len(body):
            return True
    if digits > 0.01 * n and _ACCESSOR.search(source):
        body = body or _COMMENT.sub(_kept, source)
        found = [int(x) for x in _NUMBERED.findall(body)]
        return set(found) >= set(range(5)) and len(found) >= 0.3 * max(1, body.count("\n"))
    return False


_RUN = re.compile(r"[A-Za-z0-9+/=]{60}")


def by_path(path: Column) -> Column:
    folders = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lower)
    inside = F.arrays_overlap(folders, F.array(*[F.lit(d.lower()) for d in VENDOR_DIRS + GENERATED_DIRS]))
    low = F.lower(path)
    return inside | low.rlike(_GENERATED_NAME) | low.rlike(_LOCK_NAME) | low.rlike(_MINIFIED_NAME)


_WORDS = re.compile(r"\w+")


def shingles(text: str) -> set[tuple[str, ...]]:
    w = _WORDS.findall(text)
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


class Reference:
    """Shingle index of the reference files, with an exact filter before it.

    For each file a few of its longest words are picked whose shingles make up more than 1 - SIMILAR of its set: a text
    without any of them cannot reach the similarity. One automaton looks for the words of all files.
    """

    def __init__(self, sources: list[str]):
        import ahocorasick

        self.known: dict[tuple[str, ...], list[int]] = {}
        self.sizes: list[int] = []
        self.words = ahocorasick.Automaton()
        self.all = False
        for i, text in enumerate(sources):
            x = shingles(text)
            self.sizes.append(len(x))
            for k in x:
                self.known.setdefault(k, []).append(i)
            left, covered = set(x), 0
            for w in sorted({w for k in x for w in k}, key=lambda w: (-len(w), w)):
                hit = {k for k in left if w in k}
                left -= hit
                covered += len(hit)
                self.words.add_word(w, w)
                if covered > (1 - SIMILAR) * len(x) + 1:
                    break
        self.none = not self.known
        self.words.make_automaton()

    def copied(self, source: str) -> bool:
        """Whether the text is a copy of a reference file: Jaccard similarity of the shingle sets at or above SIMILAR."""
        if self.none or next(self.words.iter(source), None) is None:
            return False
        x = shingles(source)
        counts: dict[int, int] = {}
        for k in x & self.known.keys():
            for i in self.known[k]:
                counts[i] = counts.get(i, 0) + 1
        return any(c >= SIMILAR * (len(x) + self.sizes[i] - c) for i, c in counts.items())


@lru_cache(maxsize=2)
def _indexed(sources: tuple[str, ...]) -> Reference:
    """The index of the reference files, built once per worker process."""
    return Reference(list(sources))


#: Reference files are held by every worker only up to this many characters.
REFERENCE_CHARS = 50_000_000


def judged(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(repo_id, path, by_path, by_text): whether path rules or the text mark the file as not hand-written."""
    total = upstream.agg(F.sum(F.length("source"))).first()[0] or 0
    if total > REFERENCE_CHARS:
        raise ValueError(f"{total} characters of reference files; at most {REFERENCE_CHARS} are compared in one run: split the reference")
    reference = tuple(sorted(r[0] for r in upstream.filter("source is not null").select("source").distinct().collect()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _indexed(reference)
        for b in batches:
            hit = [bool(p) or (bool(s) and (notice(s) or machine_made(s) or index.copied(s))) for s, p in zip(b["source"], b["by_path"], strict=True)]
            yield pd.DataFrame({"repo_id": b["repo_id"], "path": b["path"], "by_path": b["by_path"], "found": hit})

    src = files.filter(F.col("path").isNotNull()).select("repo_id", "path", by_path(F.col("path")).alias("by_path"), F.coalesce("source", F.lit("")).alias("source"))
    return spread(src).mapInPandas(run, "repo_id string, path string, by_path boolean, found boolean")


def not_handwritten(files: DataFrame, upstream: DataFrame) -> DataFrame:
    return judged(files, upstream).filter("found").select("repo_id", "path").distinct()


def shares(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(repo_id, files, found): how much of each repository is not hand-written."""
    j = judged(files, upstream).groupBy("repo_id", "path").agg(F.max("found").alias("found"))
    return j.groupBy("repo_id").agg(F.count(F.lit(1)).alias("files"), F.count_if("found").alias("found"))
