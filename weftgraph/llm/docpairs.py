"""Functions paired with their documentation, without those whose documentation says nothing.

Sources are lexed (structure.py) and the structural tokens of every file exploded into rows. A running sum over a file's
rows gives the bracket depth; rows of one depth are siblings, and a closing bracket also ends the siblings inside of it. A
name whose next sibling opens a body is a function, the sibling that closes it is its end. Comments on adjoining lines are
islands; ``lag`` attaches the island right above a function's declaration, ``lead`` the string that opens a Python suite.
Everything is computed on offsets, in one sorted pass per file (one shuffle of the token arrays); code and comment are cut
out of the source at the end.

Records (code_functions) are joined to these functions by path and name. The description is the documentation that stands
in the source where it says the same as the record, else the record's docstring (source missing, changed or unreadable). A
record without a docstring has none, whatever the source says. A description says something if, after comment marks, tags,
directives, licence lines and code are taken off, a sentence holds enough words that neither the name nor the signature nor
stock phrases hold. Null, empty and blank docstrings say nothing. Repeated records count once. A file is handled by the task
that holds its rows; a word-for-word repetition of the class's docstring says nothing; very long files only make longer windows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.structure import structure
from weftgraph.llm.syntax import language_of
from weftgraph.session import spread

#: New words that a sentence, and a tag line, must hold.
NEW_WORDS, NEW_TAG_WORDS = 3, 4

# Words that carry no information of their own in a docstring.
_EMPTY = set(
    "the a an of to this that it its in is are be for and or with on by as at from given value values result results function method class routine helper utility "
    "will does do performs perform implements implement implementation handles handle executes execute calls call runs run returns return returned gets get sets set setter getter "
    "constructor destructor constructs creates create main entry point internal use only private public deprecated inherited undocumented undefined auto generated stub none null nil na "
    "todo tbd fixme xxx hack wip placeholder description desc describe documentation docs doc docstring comment comments missing pending summary fill me here add write written text "
    "see above below same also param params parameter parameters arg args argument arguments type rtype throws raises error exception override abstract static void no not yet some something "
    "kommentar fehlt à compléter documenter pendiente sin comentario descripción beschreibung folgt später".split()
)
_DIRECTIVE = re.compile(
    r"^(?:fmt:|noqa\b|type: ?ignore|pragma:|pylint:|nolint\b|noinspection\b|eslint|prettier-ignore|istanbul|ts-ignore|@ts-|tslint|jshint|jslint|flake8:|mypy:|isort:|clang-format|NOLINT|NOSONAR|spellcheck|cspell|c8 ignore|go:|coverage:|yapf:|black:|@suppress|rubocop|sonar|checkstyle|codecov|region\b|endregion\b)", re.I
)
_LICENCE = re.compile(r"\b(?:licen[sc]ed? under|all rights reserved|copyright|spdx-license|permission is hereby)\b", re.I)
_TAG = re.compile(r"^(?:@\w+|:\w+(?: [\w.\[\], ]+)?:|\\\w+|(?:Args|Arguments|Returns?|Raises|Yields|Parameters|Throws|Params|Note|Notes|See Also|Example|Examples)\s*:?$)")
_CODE = re.compile(r"[{};]\s*$|^(?:return|print|if|for|while|import|from|let|const|var|def|fn|func|raise|throw|assert)\b.*[()=;\[\]]|^\w+(?:\.\w+)*\([^)]*\)[;.]?$|^[\w.\[\]]+ ?[-+*/]?= ?\S.*[();]|^(?:>>>|\$ )|=>|->")
_DATED = re.compile(r"^(?:created|modified|updated|changed|since|version|author|date|last change)\b[\s:.,/\d-]*(?:by \w+)?$", re.I)
_TODO = re.compile(r"^(?:TODO|FIXME|XXX|HACK|TBD)\b", re.I)
_MARKS = re.compile(r"^\s*(?:/\*\*?|\*/|\*(?!\w)|///?!?|#+(?!\w)|--|\"\"\"|''')\s?|\s*\*/\s*$|\"\"\"\s*$")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def stem(w: str) -> str:
    """A word without its English endings, so that Updates, updating and update agree."""
    for end in ("ing", "ies", "ied", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] in "eyi" else w


def name_words(text: str) -> set[str]:
    return {stem(p.lower()) for w in _WORD.findall(text) for p in (w, *_CAMEL.findall(w))}


_EMPTY_STEMS = {stem(w) for w in _EMPTY}


def informative(doc: str | None, name: str | None, signature: str | None) -> bool:
    """Whether a docstring tells something that name and signature do not."""
    if not doc or not doc.strip():
        return False
    known = name_words(name or "") | name_words(signature or "") | _EMPTY_STEMS
    joined = "".join(sorted(name_words(name or "")))
    tag = False
    parts: list[tuple[bool, str]] = []
    for raw in doc.replace("\r", "").split("\n"):
        line = _MARKS.sub("", _MARKS.sub("", raw)).strip()
        if not line:
            tag, parts = False, [*parts, (False, "")]
            continue
        if _DIRECTIVE.match(line) or _LICENCE.search(line) or _TODO.match(line) or _DATED.match(line) or _CODE.search(line):
            continue
        starts = _TAG.match(line)
        if starts:
            tag = True
            parts.append((True, line[starts.end() :] if line[0] in "@:\\" else ""))
        elif parts and parts[-1][1] and parts[-1][0] == tag:
            parts[-1] = (tag, parts[-1][1] + " " + line)
        else:
            parts.append((tag, line))
    for is_tag, text in parts:
        cjk = len(_CJK.findall(text))
        if cjk >= 8:
            return True
        fresh = {s for w in _WORD.findall(text.lower()) if (s := stem(w)) not in known and not (len(s) >= 5 and s in joined)}
        if len(fresh) >= (NEW_TAG_WORDS if is_tag else NEW_WORDS):
            return True
    return False


@F.pandas_udf(T.BooleanType())
def _informative(doc: pd.Series, name: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([informative(*x) for x in zip(doc, name, signature, strict=True)], dtype=bool)


FILE = ["h1", "h2"]
_TOKENS = "h1 bigint, h2 bigint, kind array<string>, pos array<int>, stop array<int>, line array<int>, until array<int>, name array<string>"


def _keyed(files: DataFrame) -> DataFrame:
    """(h1, h2, repo_id, path, lang, source) of files with a known suffix; equal keys are equal rows."""
    f = files.select("repo_id", "path", language_of(F.col("path")).alias("lang"), "source").filter("source is not null and lang is not null")
    return f.select(F.xxhash64("repo_id", "path").alias("h1"), F.xxhash64("source", "path").alias("h2"), "*")


def token_rows(files: DataFrame) -> DataFrame:
    """One row per structural token of each different file: h1, h2 (file), i, kind, pos, stop, line, until, name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = [structure(lang, s) for lang, s in zip(b["lang"], b["source"], strict=True)]
            yield pd.DataFrame({
                "h1": b["h1"], "h2": b["h2"], "kind": [x.kinds for x in t], "pos": [x.pos for x in t], "stop": [x.stop for x in t],
                "line": [x.line for x in t], "until": [x.to for x in t], "name": [x.names for x in t],
            })

    lexed = spread(_keyed(files).select("h1", "h2", "lang", "source")).mapInPandas(run, _TOKENS)
    columns = ["kind", "pos", "stop", "line", "until", "name"]
    once = lexed.groupBy(*FILE).agg(*[F.first(c).alias(c) for c in columns])
    return once.select(*FILE, F.posexplode(F.arrays_zip(*columns)).alias("i", "t")).select(*FILE, "i", "t.*")


def levels(rows: DataFrame) -> DataFrame:
    """``rows`` with their level (brackets stand on the level around them) and the string of a suite right behind; a closing
    bracket comes out once more, as kind $, on the level that it ends. Parentheses are left out."""
    w = Window.partitionBy(*FILE).orderBy("i")
    opens, closes = F.col("kind").isin("(", "{"), F.col("kind").isin(")", "}")
    suite = (F.lead("kind", 1).over(w) == "{") & (F.lead("kind", 2).over(w) == "s")
    r = rows.withColumn("after", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(w))
    r = r.withColumn("doc", F.when(suite, F.struct(F.lead("pos", 2).over(w).alias("pos"), F.lead("stop", 2).over(w).alias("stop"))))
    own = F.struct(F.col("kind"), F.when(opens, F.col("after") - 1).otherwise(F.col("after")).alias("level"))
    seen = F.explode(F.when(closes, F.array(own, F.struct(F.lit("$").alias("kind"), (F.col("after") + 1).alias("level")))).otherwise(F.array(own))).alias("x")
    r = r.select(*FILE, "i", "pos", "stop", "line", "until", "name", "doc", seen).select(*FILE, "i", "pos", "stop", "line", "until", "name", "doc", "x.kind", "x.level")
    return r.filter(~F.col("kind").isin("(", ")"))


def functions_of(files: DataFrame) -> DataFrame:
    """(h1, h2, name, line, pos, end, doc): offsets of every function and of its documentation (null if it has none)."""
    r = levels(token_rows(files))
    on = Window.partitionBy(*FILE, "level").orderBy("i")
    back = Window.partitionBy(*FILE, "level").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
    comment, kind = F.col("kind") == "c", F.col("kind")
    starts = comment & ~F.coalesce((F.lag("kind").over(on) == "c") & (F.lag("until").over(on) + 1 >= F.col("line")), F.lit(False))
    r = r.withColumn("starts", starts)
    r = r.withColumn("island", F.last(F.when(F.col("starts"), F.col("pos")), ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, 0)))
    above = F.struct(F.lag("island").over(on).alias("pos"), F.lag("stop").over(on).alias("stop"))
    attached = (F.lag("kind").over(on) == "c") & (F.lag("until").over(on) + 1 >= F.col("line"))
    r = r.withColumn("above", F.when(attached, above))
    following = lambda *kinds: F.last(F.when(kind.isin(*kinds), F.struct("kind", "pos", "stop")), ignorenulls=True).over(back)
    r = r.withColumn("body", following("{", "e", ";", "$")).withColumn("shut", following("}")).withColumn("next", following(">", "{", "e", ";", "$"))
    f = r.filter(kind.isin("n", "a") & ((kind == "n") | (F.col("next.kind") == ">")) & (F.col("body.kind") != "$"))
    end = F.when(F.col("body.kind") == "{", F.col("shut.stop")).otherwise(F.col("body.stop"))
    return f.select(*FILE, "name", "line", "pos", end.alias("end"), F.coalesce("doc", "above").alias("doc")).filter("end is not null")


def spans(files: DataFrame) -> DataFrame:
    """(repo_id, path, name, start_line, end_line, comment, code): the functions of every file, texts cut out of the source."""
    found = functions_of(files).groupBy(*FILE).agg(F.collect_list(F.struct("name", "line", "pos", "end", "doc")).alias("found"))
    texts = _keyed(files).groupBy(*FILE).agg(F.first("repo_id").alias("repo_id"), F.first("path").alias("path"), F.first("source").alias("source"))
    f = texts.join(found, FILE).select("repo_id", "path", "source", F.explode("found").alias("x"))
    cut = lambda a, b: F.substring(F.col("source"), a + 1, b - a)
    f = f.select("repo_id", "path", "x.name", F.col("x.line").alias("start_line"), cut(F.col("x.doc.pos"), F.col("x.doc.stop")).alias("comment"), cut(F.col("x.pos"), F.col("x.end")).alias("code"))
    return f.select("repo_id", "path", "name", "start_line", (F.col("start_line") + F.length("code") - F.length(F.replace("code", F.lit("\n")))).alias("end_line"), "comment", "code")


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def described(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Live function records with a docstring, with ``description`` and ``code`` of the function in the source.

    Among several functions of one name in a file the one nearest to the record's start_line counts.
    """
    f = functions.filter(F.col("docstring").isNotNull() & (F.trim("docstring") != ""))
    f = f.select("repo_id", "path", "name", "id", "class_id", "signature", "docstring", "start_line")
    s = spans(files).select("repo_id", "path", "name", F.col("start_line").alias("at"), "comment", "code")
    j = f.join(s, ["repo_id", "path", "name"], "left")
    off = F.coalesce(F.abs(F.col("at") - F.col("start_line")), F.lit(0))
    g = j.groupBy("repo_id", "id", "class_id", "name", "signature", "docstring").agg(F.min_by(F.struct("comment", "code"), F.struct(off, "at")).alias("best"))
    same = _letters(F.col("best.comment")) == _letters(F.col("docstring"))
    return g.select("repo_id", "id", "class_id", "name", "signature", F.when(same, F.col("best.comment")).otherwise(F.col("docstring")).alias("description"), F.col("best.code").alias("code"))


def pairs(functions: DataFrame, classes: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, function_id, signature, description, code) of the functions whose description says something."""
    own = classes.groupBy("repo_id", F.col("id").alias("class_id")).agg(F.max("docstring").alias("class_doc"))
    f = described(functions, files).join(own, ["repo_id", "class_id"], "left")
    repeats = F.coalesce(_letters(F.col("description")) == _letters(F.col("class_doc")), F.lit(False))
    f = f.filter(~repeats & _informative("description", "name", "signature"))
    return f.select("repo_id", F.col("id").alias("function_id"), "signature", "description", "code")
