"""Per-document text quality statistics, their distributions per language, and natural prose.

Statistics come from one pass over the lines of each text (Arrow batches; a dozen measures of a line cost one Python visit,
where as many separate expressions over arrays of lines cost five times as much). Distributions are mergeable quantile
sketches (KLL) per language and statistic, built map-side; values become percentiles and robust z-scores against them, and
distribution tails are flagged. Natural prose is what runs for the most part and lies in none of the tails of its language.

Null, empty and blank texts have zero words, null ratios, and are no prose. Repeated rows give equal rows. Only ``text`` is
read besides the key: the language is taken from the text, as lang is often missing or wrong. Scripts without a word list
here are languages of their own. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.session import spread

# Words that running text of a language cannot do without.
COMMON = {
    "en": "the a an of to in is are was were be been it its that this these those and or but not no for with on by as at from when while if than which who what has have had do does will would can cannot must should may only so because although unless whenever until before after since our we you they them one each every",
    "de": "der die das den dem des ein eine einen einem ist sind war und oder aber nicht mehr in im auf mit von zu zum für als wenn weil denn dieser diese dieses jeder jede wird werden bis nach vor sich er sie es wir kein keine sonst wo",
    "fr": "le la les l un une des du de et ou mais ne n pas plus est sont que qui qu il elle on nous dans sur pour par avec car si ce cette ces chaque se s en au aux jusqu puis après",
    "es": "el la los las un una de del y o pero no ya se es está que en por para con cada este esta estos porque si después hasta una su más al lo nos hay",
}
_ANY = frozenset(w for words in COMMON.values() for w in words.split())

# Words of running text are looked up per language and over all of them.
_WORDS = {k: frozenset(w.split()) for k, w in COMMON.items()}
#: A line that is an item of a list, a heading, a row, a path or a block mark rather than running text.
_LIST = re.compile(r"\s*(?:[-*+•–—·○▪►>#]+\s|\[[ xX]?\]|\(?(?:\d{1,3}|[a-zA-Z]|[ivx]{1,4})[.):]\s|#{1,6}|\||[│├└╭╰─+=]{2}|@\w|:\w+)", re.A)
#: Marks of code in a line: its end, its start, and what only code holds.
_CODE = re.compile(
    r"[{};]\s*$|[=!<>+]=|->|=>|::|\w\(\)|\w+\(\w*+(?:, ?\w++)*+\)\s*[;{]?\s*$|\A\s*(?://|/\*|\*/|\"\"\"|\'\'\'|#!|#\s.{60}"
    r"|(?:import|from|package|use|pub|fn|func|def|class|struct|impl|return|const|let|var|if|for|while|switch|case|#include|#define|public|private|static|export|async|try|catch|else|elif|except|assert|print|void|int|namespace|interface|trait|type|enum|self|raise|with)\b.*[(){}\[\]=:;<])", re.A
)
#: Signs that belong to the letter before them.
_SIGNS = r"\u0300-\u036f\u0591-\u05c7\u064b-\u065f\u0900-\u0dff\u0e30-\u0e4e\u1000-\u109f"
_SYMBOL = re.compile(rf"[^\w\s{_SIGNS}.,;:!?'\"()。、，！？…’“”«»।؟،-]|\d+")
_WORD = re.compile(rf"[^\W\d_]+(?:[{_SIGNS}]+[^\W\d_]*)*")
_CJK = re.compile(r"[\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f]")
_KANA = re.compile(r"[\u3041-\u309f]")
_JOINT = re.compile(r"[。、，！？\u3041-\u309f的了在是会这以从不]")
_STRAY = re.compile(r"[\u0300-\u036f\u20d0-\u20ff\ufffd]")
#: Scripts whose languages have no word list here.
_SCRIPTS = {
    "cyrl": "\u0400-\u052f", "grek": "\u0370-\u03ff", "hebr": "\u0590-\u05ff", "arab": "\u0600-\u06ff\u0750-\u077f", "deva": "\u0900-\u097f", "indic": "\u0980-\u0dff", "thai": "\u0e00-\u0e7f",
    "kore": "\u1100-\u11ff\uac00-\ud7af", "armn": "\u0530-\u058f", "geor": "\u10a0-\u10ff", "ethi": "\u1200-\u137f", "khmr": "\u1780-\u17ff",
}
_OTHER = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
_ANY_OTHER = re.compile(f"[{''.join(_SCRIPTS.values())}]")
_BLOCK_TAG, _TAG = re.compile(r"</(?:p|div|li|h\d|td|tr)>|<br ?/?>"), re.compile(r"</?[a-zA-Z][^<>\n]*>|\ufeff|\u200b")
_MARKUP = re.compile(r"^[ \t]*(?:>[ \t]?)++|`[^`\n]*`|\[([^\[\]\n]*)\]\([^()\s]*\)", re.M)
_BREAK = re.compile(r"\r\n|[\r\n\u2028\x85]")
_SENTENCE = re.compile(r"[.!?。！？।؟\r\n]+")
_ENDED = re.compile(r"[.!?:…。！？।؟][\"')»”]*\Z")


def lines_of(text: str) -> list[str]:
    """Trimmed, non-empty lines without markup tags; a quote mark at the start of a mail line is no list mark."""
    bare = _TAG.sub("", _BLOCK_TAG.sub("\n", text)) if "<" in text or not text.isascii() else text
    bare = _MARKUP.sub(r"\1", bare) if ">" in bare or "`" in bare or "](" in bare else bare
    return [x for x in (x.strip() for x in _BREAK.split(bare)) if x]


def measured(line: str) -> tuple[int, bool, bool]:
    """(characters, running text, list item or code) of a line. Languages with a word list, Chinese and Japanese are known
    by the words and letters that join sentences; for other scripts a line of several words of that script counts."""
    size = len("".join(line.split()))
    marked, code = _LIST.match(line) is not None, _CODE.search(line) is not None
    if code:
        return size, False, True
    symbols = len(_SYMBOL.findall(line)) + line.count("_")
    running = False
    if symbols <= 0.12 * size:
        words = _WORD.findall(line.lower())
        n = len(words)
        if n >= 2 and sum(w in _ANY for w in words) >= 0.2 * n:
            running = not marked or n >= 13
        elif not line.isascii():
            cjk = len(_CJK.findall(line))
            if cjk >= 6 and cjk >= 0.25 * size:
                running = len(_JOINT.findall(line)) >= 0.04 * cjk and (not marked or n >= 13 or cjk >= 25)
            elif (other := len(_ANY_OTHER.findall(line))) >= 0.6 * size:
                running = (n >= 4 or other >= 25) and (not marked or n >= 13)
    return size, running, marked


def measure(text: str | None) -> tuple:
    """The statistics of one text, in the order of ``STATISTICS``."""
    t = text or ""
    size = len("".join(t.split()))
    if not size:
        return (0, *[None] * (len(MEASURES)), 0, "und")
    lines = lines_of(t)
    chars = prose = other = ended = 0
    for line in lines:
        n, running, item = measured(line)
        chars += n
        prose += n * running
        other += n * item
        ended += _ENDED.search(line) is not None
    low = t.lower()
    words = _WORD.findall(low)
    common = sum(w in _ANY for w in words)
    digits = sum(map(t.count, "0123456789"))
    letters = sum(map(len, words))
    stray = cjk = 0
    language = "und"
    if not t.isascii():
        stray, cjk = len(_STRAY.findall(t)), len(_CJK.findall(t))
    if cjk > 0.2 * size:
        language = "ja" if len(_KANA.findall(t)) > 0.05 * cjk else "zh"
    else:
        inside = {k: sum(w in s for w in words) for k, s in _WORDS.items()}
        best = max(inside.values())
        if best:
            language = next(k for k in inside if inside[k] == best)
        if not t.isascii() and len(_ANY_OTHER.findall(t)) > 0.5 * letters:
            language = max(_OTHER, key=lambda k: len(_OTHER[k].findall(t)))
    pieces = [p for p in (p.strip() for p in _SENTENCE.split(low)) if p]
    whole = sum(map(len, pieces))
    symbols = len(t) - len(t.translate(_PUNCTUATION)) if t.isascii() else len(_MARKS.findall(t))
    n = len(words)
    return (
        n, letters / n if n else None, symbols / size, digits / size, ended / len(lines) if lines else None, common / n if n else None, prose / chars if chars else None,
        other / chars if chars else None, sum(map(len, set(pieces))) / whole if whole else None, stray / size, size, language,
    )


_MARKS = re.compile(rf"[^\w\s{_SIGNS}]|_")
_PUNCTUATION = {c: None for c in range(33, 127) if not chr(c).isalnum()}
MEASURES = ["mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "prose_ratio", "list_ratio", "distinct_ratio", "mark_ratio"]
STATISTICS = ["words", *MEASURES, "chars", "language"]


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, words, mean_word_length, symbol_ratio, digit_ratio, line_end_ratio, common_ratio,
    prose_ratio, list_ratio, distinct_ratio (share of the characters of sentences that are said once), mark_ratio (stray
    combining and replacement marks), chars, language (by the text). One pass over Arrow batches, every line read once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([measure(t) for t in b["text"]], columns=STATISTICS)
            out.insert(0, key, b["key"].to_numpy())
            yield out.astype({m: "float64" for m in MEASURES})

    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, words bigint, {', '.join(f'{m} double' for m in MEASURES)}, chars bigint, language string"
    d = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInPandas(run, schema)
    nan = lambda m: F.when(~F.isnan(m), F.col(m)).alias(m)
    return d.select(key, "words", *[nan(m) for m in MEASURES], "chars", "language")


#: Share of a text's characters that must run for it to be "mostly running sentences".
MOSTLY = 0.5
#: Robust deviations beyond which a value lies in a tail, and the least spread of a measure (distributions of clean text
#: are often a single value).
TAIL = 7.0
SPREAD = {"distinct_ratio": 0.08, "mark_ratio": 0.007, "list_ratio": 0.07}
LEAST_SPREAD = 0.02
#: Tails that running text does not have: too few joining words, the same said over and over, stray marks, items and code.
LOW_TAILS, HIGH_TAILS = ("common_ratio", "distinct_ratio"), ("mark_ratio", "list_ratio")


def sketches(stats: DataFrame) -> DataFrame:
    """(language, measure, sketch, n): mergeable quantile sketches of every measure. Built map-side, so a language with most
    rows costs one sketch per task."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])).alias("x")
    long = stats.select("language", pairs).select("language", "x.*").filter("value is not null")
    return long.groupBy("language", "measure").agg(F.expr("kll_sketch_agg_double(value)").alias("sketch"), F.count(F.lit(1)).alias("n"))


def quantiles(sk: DataFrame) -> DataFrame:
    """(language, measure, n, q): 101 quantiles of each sketch."""
    ranks = ", ".join(f"{i / 100}D" for i in range(101))
    return sk.select("language", "measure", "n", F.expr(f"kll_sketch_get_quantile_double(sketch, array({ranks}))").alias("q"))


def scored(stats: DataFrame, quants: DataFrame) -> DataFrame:
    """``stats`` with a percentile (0..1) and a robust z-score (from the median, in normalised interquartile ranges) of every
    measure within its language, and ``tails``: the number of measures beyond 3.5 robust deviations. There are as many
    languages as ``measure`` knows, so the quantiles are a few numbers and are broadcast."""
    q = quants.groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("measure", "q"))).alias("qs"))
    out = stats.join(F.broadcast(q), "language", "left")
    far = []
    for m in MEASURES:
        at = F.col("qs")[m]
        spread = F.greatest((at[75] - at[25]) / 1.349, F.lit(SPREAD.get(m, LEAST_SPREAD)))
        out = out.withColumn(f"{m}_pct", _rank(at, F.col(m)))
        out = out.withColumn(f"{m}_z", F.round((F.col(m) - at[50]) / spread, 4))
        far.append(F.when(F.abs(F.col(f"{m}_z")) > 3.5, 1).otherwise(0))
    return out.withColumn("tails", reduce(lambda a, b: a + b, far)).drop("qs")


def _rank(q: Column, value: Column) -> Column:
    return F.size(F.filter(q, lambda v: v <= value)) / F.size(q)


def prose(stats: DataFrame) -> DataFrame:
    """Scored rows of ``stats`` whose text is natural prose.

    Texts of mostly running lines are compared with their like: sketches per language over these texts give robust z-scores,
    and a text in one of the tails that running text does not have (a table full of short words, one line said over and
    over, garbled letters) is none. The bulk of a language sets its own measure, so no bound is fixed per language.
    """
    running = stats.filter(F.col("prose_ratio") >= MOSTLY)
    s = scored(running, quantiles(sketches(running)))
    keep = [F.coalesce(F.col(f"{m}_z") >= -TAIL, F.lit(True)) for m in LOW_TAILS] + [F.coalesce(F.col(f"{m}_z") <= TAIL, F.lit(True)) for m in HIGH_TAILS]
    return s.filter(reduce(lambda a, b: a & b, keep))
