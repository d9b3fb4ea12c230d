"""Structural tokens of source files: what opens, closes, names and documents functions.

The lexer reads a file once and keeps the tokens that delimit: comments, brackets, statement ends, names that may head a
function, and for Python indentation and the strings that open a suite. Strings, comments and regular expressions are
consumed as wholes, so nothing inside of them counts. Groups in parentheses that hold none of these tokens are dropped on
the spot, as are names that no body can follow.

Kinds: c comment, n name of a function, a name that an arrow function may be assigned to, ( ) parentheses and square
brackets, { } braces or an indented suite, e an empty pair of braces, ; end of a statement, > arrow, s string that opens a
suite. Every token has its start and end offset; names and comments also their lines.
"""

from __future__ import annotations

import re
from functools import lru_cache

from weftgraph.llm.lexers import _BLOCK, _CPP, _DQ, _LINE, _PYSTR, _SQ, _TPL

# Words that stand before a parenthesis and head no function.
CONTROL = frozenset(
    "if for while switch catch return else do synchronized new throw sizeof with await match loop super this assert case typeof defined elif using "
    "async typedef delete yield co_return co_await alignas decltype static_assert noexcept throws import".split()
)
#: Words at the start of a statement that make what follows an expression.
_EXPRESSION = frozenset("return new else throw delete await yield case goto co_return if for while switch do".split())
_GENERIC = r"\s*(?:<[^<>(){};]*(?:<[^<>(){};]*>[^<>(){};]*)*>\s*)?"
_REGEX = r"(?<=[(,=:\[!&|?{};+])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_CALLED = rf"(?<![\w$@.])(?<!->)~?[A-Za-z_$#][\w$]*(?={_GENERIC}\()"
_ASSIGNED = r"(?<![\w$.])(?:const|let|var)\s+[\w$]+(?=\s*(?::[^=;(){}\n]+)?=\s*(?:async\b\s*)?(?:\(|<|[\w$]+\s*=>))"
_FUNCTION = r"(?<![\w$.])(?:const|let|var)\s+[\w$]+(?=\s*(?::[^=;(){}\n]+)?=\s*(?:async\s+)?function\b)"

_PARTS = {
    "java": dict(c=rf"{_LINE}|{_BLOCK}", s=rf'"""[\s\S]*?"""|{_DQ}|{_SQ}', k=r"\b(?:case\b[^:;{}\n]*|default\s*):(?!:)", n=_CALLED, b=r"[(){}\[\];]"),
    "go": dict(c=rf"{_LINE}|{_BLOCK}", s=rf"{_DQ}|`[^`]*`|{_SQ}", n=r"(?<![\w.])func\s*(?:\([^()]*\)\s*)?\w+(?=\s*(?:\[[^\]]*\]\s*)?\()", k=r"\b(?:interface|struct)\s*\{\s*\}", b=r"[(){}\[\];]"),
    "rust": dict(c=rf"{_LINE}|{_BLOCK}", s=r"""b?r(?P<h>#*)"[\s\S]*?"(?P=h)|b?"(?:\\[\s\S]|[^"\\])*"|b?'(?:\\[^\n]{1,10}?|[^'\\\n])'""", n=r"(?<!\w)fn\s+\w+", b=r"[(){}\[\];]"),
    "js": dict(c=rf"{_LINE}|{_BLOCK}", s=rf"{_REGEX}|{_DQ}|{_SQ}|{_TPL}", g=_FUNCTION, a=_ASSIGNED, n=_CALLED, f="=>", k=r"\b(?:case\b[^:;{}\n]*|default\s*):", b=r"[(){}\[\];]"),
    "c": dict(k=rf"{_CPP}|\b(?:public|private|protected|default|case\b[^:;{{}}\n]*)\s*:(?!:)", c=rf"{_LINE}|{_BLOCK}", s=r'(?:\b(?:L|u8|u|U))?R"(?P<h>\w*)\([\s\S]*?\)(?P=h)"|"(?:\\[\s\S]|[^"\\\n])*"|' + r"'(?:\\[\s\S]|[^'\\\n])+'", n=_CALLED, b=r"[(){}\[\];]"),
    "python": dict(c=r"#[^\n]*", s=_PYSTR, k=r"\\\r?\n", l=r"\n[ \t\f]*", n=r"(?<![\w.])def[ \t]+\w+", b=r"[(){}\[\]]"),
}
_PARTS["ts"], _PARTS["cpp"] = _PARTS["js"], _PARTS["c"]


@lru_cache(maxsize=16)
def _pattern(lang: str) -> re.Pattern[str]:
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in _PARTS[lang].items()), re.M)


_BLANK = re.compile(r"\s*")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")


class Tokens:
    """Columns of the structural tokens of one file."""

    __slots__ = ("kinds", "pos", "stop", "line", "to", "names")

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.pos: list[int] = []
        self.stop: list[int] = []
        self.line: list[int] = []
        self.to: list[int] = []
        self.names: list[str | None] = []

    def add(self, kind: str, pos: int, stop: int, line: int = 0, to: int = 0, name: str | None = None) -> None:
        self.kinds.append(kind)
        self.pos.append(pos)
        self.stop.append(stop)
        self.line.append(line)
        self.to.append(to)
        self.names.append(name)

    def pop(self) -> None:
        for column in (self.kinds, self.pos, self.stop, self.line, self.to, self.names):
            column.pop()


def structure(lang: str, source: str) -> Tokens:
    return _suites(source) if lang == "python" else _braces(lang, source)


def _braces(lang: str, source: str) -> Tokens:
    t = Tokens()
    kinds, add, pop = t.kinds, t.add, t.pop
    declares = lang in ("java", "rust")
    typed, script = lang in ("java", "c", "cpp"), lang in ("js", "ts")
    mark = at = 0
    ln = 1
    for m in _pattern(lang).finditer(source):
        g = m.lastgroup
        if g == "s":
            continue
        a, b = m.span()
        if g == "b":
            ch = source[a]
            if ch in "([":
                add("(", a, b)
            elif ch in ")]":
                while kinds and kinds[-1] in "na":
                    pop()
                if kinds and kinds[-1] == "(":
                    opened = t.pos[-1]
                    pop()
                    if script and kinds and kinds[-1] == "n" and source[t.stop[-1] : opened].strip()[:1] in ("", "<"):
                        t.stop[-1] = b
                else:
                    add(")", a, b)
            elif ch == "{":
                if script and kinds and kinds[-1] == "n" and source[t.stop[-1] : a].strip()[:1] not in ("", ":", "<", "("):
                    pop()
                add("{", a, b)
                mark = b
            elif ch == "}":
                while kinds and kinds[-1] in "na":
                    pop()
                if kinds and kinds[-1] == "{" and t.stop[-1] == a:
                    kinds[-1], t.stop[-1] = "e", b
                else:
                    add("}", a, b)
                mark = b
            else:
                while kinds and kinds[-1] in "na" and not (declares and t.to[-1]):
                    pop()
                if kinds and kinds[-1] not in ";({":
                    add(";", a, b)
                mark = b
        elif g == "c":
            ln += source.count("\n", at, a)
            to = ln + source.count("\n", a, b)
            add("c", a, b, ln, to)
            at, ln, mark = b, to, b
        elif g == "f":
            if kinds and kinds[-1] == "a":
                add(">", a, b)
        elif g == "k":
            if source[a] not in "is":
                mark = b
        else:
            word = m.group()
            name = word if g == "n" and lang not in ("go", "rust") else word.split()[-1]
            if lang == "go":
                name = re.split(r"[\s)]", word)[-1]
            if name in CONTROL or name == "function":
                continue
            head = _BLANK.match(source, mark).end()
            declared = int(lang == "rust")
            if typed:
                before = source[head:a]
                first = _WORD.match(before)
                if first and first.group() in _EXPRESSION or "=" in before and not before.lstrip().startswith(("@", "template")):
                    continue
                declared = 1 if before.strip() else 0
            if head > at:
                ln += source.count("\n", at, head)
                at = head
            add("a" if g == "a" else "n", head, b, ln, declared, name)
    return t


def _suites(source: str) -> Tokens:
    t = Tokens()
    kinds, add = t.kinds, t.add
    stack, depth, at, ln = [0], 0, 0, 1
    start = _BLANK.match(source).end()
    eol: int | None = None
    pending = False
    for m in _pattern("python").finditer(source):
        g = m.lastgroup
        a, b = m.span()
        if g == "b":
            depth = depth + 1 if source[a] in "([{" else max(0, depth - 1)
        elif g == "l":
            if depth or a < start:
                continue
            if eol is None:
                eol = a - (source[a - 1 : a] == "\r")
            if source[b : b + 1] in ("", "\n", "\r", "#"):
                continue
            width = len(m.group()[1:].expandtabs(8))
            if width > stack[-1]:
                stack.append(width)
                add("{", b, b)
            else:
                if pending:
                    add(";", eol, eol)
                while width < stack[-1]:
                    stack.pop()
                    add("}", eol, eol)
            pending, start, eol = False, b, None
        elif g == "s":
            if a == start and kinds and kinds[-1] == "{" and t.pos[-1] == a:
                add("s", a, b)
        elif g == "n":
            ln += source.count("\n", at, start)
            at = max(at, start)
            pending = True
            add("n", start, b, ln, 1, m.group().split()[-1])
    end = eol if eol is not None else len(source.rstrip())
    if pending:
        add(";", end, end)
    for _ in stack[1:]:
        add("}", end, end)
    return t
