"""Lexers: a source text to a string with one character per token class.

One compiled pattern per language runs over the text with ``findall``; classes of token texts are cached, so the cost per
token is a dictionary lookup. White space and comments give nothing; what cannot be lexed (an open string or comment, a
stray character, a merge conflict mark) gives the class ERROR.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Suffix to language. The suffix decides, as the language column may be wrong.
SUFFIXES = {
    ".py": "python", ".pyw": "python", ".java": "java", ".go": "go", ".rs": "rust", ".ts": "ts", ".tsx": "ts", ".js": "js", ".jsx": "js",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
}

#: Class characters: identifier, number, string, error; brackets stand for themselves.
ID, NUM, STR, ERROR, NEWLINE = "i", "n", "s", "E", "\n"

# Reserved words that matter to the grammars.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "java": "abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while boolean byte char double float int long short void",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self static struct super trait type unsafe use where while",
    "js": "async await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new of return static super switch this throw try typeof var void while with yield",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while",
}
KEYWORDS["ts"] = KEYWORDS["js"] + " abstract declare enum implements interface private protected public readonly"
KEYWORDS["cpp"] = KEYWORDS["c"].replace(" restrict", "") + (
    " alignas alignof bool catch class constexpr decltype delete explicit friend mutable namespace new noexcept operator override private protected public template this throw try typeid typename using virtual static_cast dynamic_cast const_cast reinterpret_cast"
)

# Operators by class. BIN: binary only; PM: binary or prefix; NOT: prefix only; INC: prefix or postfix; ASG: assignment with an operator.
OPERATORS = {
    "python": {"BIN": "** // / % << >> == != <= >= < > ^ | &", "STAR": "*", "PM": "+ -", "NOT": "~", "ASG": "+= -= *= /= //= %= **= >>= <<= &= |= ^= @=", "WALRUS": ":=", "ARROW": "->"},
    "java": {"BIN": "/ % == != <= >= && || ^ | << <<<", "STAR": "*", "AMP": "&", "PM": "+ -", "NOT": "! ~", "INC": "++ --", "ASG": "+= -= *= /= %= >>= >>>= <<= &= |= ^=", "ARROW": "->", "SCOPE": "::", "DOTS": "..."},
    "go": {"BIN": "/ % == != <= >= && || | << >> &^ <  >", "PM": "+ - ^ & *", "NOT": "! ~", "INC": "++ --", "ASG": "+= -= *= /= %= >>= <<= &= |= ^= &^=", "WALRUS": ":=", "CHAN": "<-", "DOTS": "..."},
    "rust": {"BIN": "/ % == != <= >= && ^ << +", "BAR": "| ||", "STAR": "*", "PM": "- &", "NOT": "!", "ASG": "+= -= *= /= %= >>= <<= &= |= ^=", "ARROW": "->", "FAT": "=>", "SCOPE": "::", "RANGE": ".. ..= ..."},
    "js": {"BIN": "/ % == != === !== <= >= && || ?? ^ | & << ** * >> >>>", "PM": "+ -", "NOT": "! ~", "INC": "++ --", "ASG": "+= -= *= /= %= **= >>= >>>= <<= &= |= ^= &&= ||= ??=", "FAT": "=>", "OPT": "?.", "DOTS": "..."},
    "c": {"BIN": "/ % == != <= >= && || ^ | << >>", "STAR": "* &", "PM": "+ -", "NOT": "! ~", "INC": "++ --", "ASG": "+= -= *= /= %= >>= <<= &= |= ^=", "ARROW": "->", "DOTS": "..."},
}
OPERATORS["ts"] = {**OPERATORS["js"], "BIN": OPERATORS["js"]["BIN"].replace(" >> >>>", "").replace("| & ", ""), "BAR": "| &"}
OPERATORS["cpp"] = {**OPERATORS["c"], "BIN": OPERATORS["c"]["BIN"].replace(" >>", "") + " <=>", "STAR": "* & &&", "SCOPE": "::"}
OPERATORS["cpp"]["BIN"] = OPERATORS["cpp"]["BIN"].replace(" &&", "")
#: Words that act as values.
VALUES = {"java": "this super", "js": "this super", "ts": "this super", "python": "None True False", "rust": "self super crate", "cpp": "this", "c": "", "go": ""}
SINGLE = ", ; : . ? = < > ( ) [ ] { } @ #"


@lru_cache(maxsize=16)
def alphabet(lang: str) -> dict[str, str]:
    """Token class or literal -> class character. The same names are the terminals of the grammars."""
    out = {"ID": ID, "NUM": NUM, "STR": STR, "ERROR": ERROR, "NEWLINE": NEWLINE, "INDENT": "I", "DEDENT": "D", "L": "L"}
    out |= {x: x for x in SINGLE.split()}
    free = (chr(c) for c in range(0x100, 0x2FF))
    for name in OPERATORS[lang]:
        out[name] = next(free)
    for word in KEYWORDS[lang].split():
        out[word] = next(free)
    return out


_MARK = r"^(?:<{7}|={7}|>{7}|\|{7})(?![<=>|])[^\n]*"
_LINE, _BLOCK = r"//[^\n]*", r"/\*[\s\S]*?\*/"
_DQ, _SQ = r'"(?:\\[\s\S]|[^"\\\n])*"', r"'(?:\\[\s\S]|[^'\\\n])*'"
_NUM = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_']*(?:\.\d[\d_]*)?\.?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)\w*"
_RNUM = r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)\w*"
_WORD = r"[^\W\d]\w*"
_JSRE = r"(?:[(,=:\[!&|?{};+]|\breturn)\s*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_TPL = r"`(?:\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|\$(?!\{)|[^`\\$])*`"
_PYSTR = r"(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')"
_CPP = r"^[ \t]*#[ \t]*(?:(?:include|define|undef|if|ifdef|ifndef|elif|else|endif|error|warning|pragma|line)\b(?:\\\r?\n|[^\n])*|$)"


def _ops(lang: str) -> str:
    ops = sorted({o for v in OPERATORS[lang].values() for o in v.split()} | set(SINGLE.split()), key=lambda o: -len(o))
    return "|".join(re.escape(o) for o in ops)


@lru_cache(maxsize=16)
def pattern(lang: str) -> re.Pattern[str]:
    parts = {
        "python": [_MARK, r"#[^\n]*", _PYSTR, r"\\\r?\n", r"\n[ \t\f]*", r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)\w*"],
        "java": [_MARK, _LINE, _BLOCK, r'"""[\s\S]*?"""', _DQ, _SQ, _NUM],
        "go": [_MARK, _LINE, _BLOCK, _DQ, r"`[^`]*`", _SQ, r"\n", _NUM],
        "rust": [_MARK, _LINE, _BLOCK, r'b?r(#*)"[\s\S]*?"\1', r'b?"(?:\\[\s\S]|[^"\\])*"', r"b?'(?:\\[^\n]{1,10}?|[^'\\\n])'", r"'[^\W\d]\w*", r"r#\w+", _RNUM],
        "js": [_MARK, _LINE, _BLOCK, _JSRE, _DQ, _SQ, _TPL, r"\n", _NUM, r"#?[^\W\d][\w$]*|\$[\w$]*"],
        "c": [_MARK, _CPP, _LINE, _BLOCK, r'(?:L|u8|u|U)?"(?:\\[\s\S]|[^"\\\n])*"', r"(?:L|u)?'(?:\\[\s\S]|[^'\\\n])+'", _NUM],
    }
    parts["ts"] = parts["js"]
    parts["cpp"] = [*parts["c"][:4], r'(?:L|u8|u|U)?R"(\w*)\([\s\S]*?\)\1"', *parts["c"][4:]]
    return re.compile("|".join([*parts[lang], _WORD, _ops(lang), r"\S"]), re.M)


class _Classes(dict):
    """Token text -> class characters, filled as texts are met."""

    def __init__(self, lang: str):
        super().__init__()
        self.lang, self.letters = lang, alphabet(lang)
        self.ops = {o: self.letters[name] for name, v in OPERATORS[lang].items() for o in v.split()}
        self.words = set(KEYWORDS[lang].split()) - set(VALUES[lang].split())
        self.values = set(VALUES[lang].split())

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            self.clear()
        self[t] = c = self._class(t)
        return c

    def _class(self, t: str) -> str:
        lang, a = self.lang, t[0]
        if t in self.words:
            return self.letters[t]
        if t in self.values:
            return ID
        if lang in ("python", "go", "js", "ts") and a == "\n":
            return t if lang == "python" else NEWLINE
        if t[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
            return ERROR
        if lang == "python":
            if a == "#" or (a == "\\" and len(t) > 1):
                return ""
        elif t[:2] in ("//", "/*"):
            return "" if t[:2] == "//" or (len(t) > 3 and t.endswith("*/")) else ERROR
        if lang in ("c", "cpp") and a in "# \t" and t.lstrip()[:1] == "#":
            return "" if len(t) > 1 else ERROR
        if t in self.ops:
            return self.ops[t]
        if t in self.letters and len(t) == 1:
            return t if not t.isalpha() else ID
        if lang in ("js", "ts") and len(t) > 2 and (a in "(,=:[!&|?{};+" or t.startswith("return")) and "/" in t:
            head = re.match(r"return|.", t).group()
            return self[head] + STR
        if a.isdigit() or (a == "." and len(t) > 1):
            return NUM
        if lang == "rust" and a == "'":
            return STR if len(t) > 2 and t[-1] == "'" else "L" if len(t) > 1 else ERROR
        if a in "\"'`" or (t[-1] in "\"'#" and len(t) > 1 and ('"' in t or "'" in t)):
            closed = len(t) > 1 and t[-1] in "\"'`#"
            return STR if closed else ERROR
        if a == "_" or a.isalpha() or a in "$#" and len(t) > 1:
            return ID
        return ERROR


@lru_cache(maxsize=16)
def classes(lang: str) -> _Classes:
    return _Classes(lang)


def lex(lang: str, source: str) -> str:
    """The class string of a source text; for Python with NEWLINE, INDENT and DEDENT, for Go with its inserted semicolons."""
    get = classes(lang).__getitem__
    found = pattern(lang).finditer(source) if lang in ("rust", "cpp") else None
    tokens = [m.group() for m in found] if found is not None else pattern(lang).findall(source)
    if lang == "python":
        return _python_lines(tokens, get)
    out = "".join(map(get, tokens))
    if lang == "go":
        return _go_semicolons(out)
    if lang in ("js", "ts"):
        return _js_semicolons(out, lang)
    return out


def _python_lines(tokens: list[str], get) -> str:
    """Logical lines: newlines inside brackets and of blank lines vanish; a change of indentation gives INDENT or DEDENTs."""
    out: list[str] = []
    depth, stack, line, pending = 0, [0], False, ""
    width = 0
    for t in tokens:
        if t[0] == "\n":
            if depth == 0:
                if line:
                    out.append(NEWLINE)
                    line = False
                pending = t[1:]
            continue
        c = get(t)
        if not c:
            continue
        if not line:
            line = True
            width = len(pending.expandtabs(8))
            if width > stack[-1]:
                stack.append(width)
                out.append("I")
            else:
                while width < stack[-1]:
                    stack.pop()
                    out.append("D")
                if width != stack[-1]:
                    out.append(ERROR)
        out.append(c)
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
    if line:
        out.append(NEWLINE)
    return "".join(out) + "D" * (len(stack) - 1)


@lru_cache(maxsize=4)
def _go_end() -> re.Pattern[str]:
    a = alphabet("go")
    words = "".join(a[w] for w in ("break", "continue", "fallthrough", "return"))
    return re.compile(f"([ins)\\]}}{a['INC']}{words}])\n+")


def _go_semicolons(s: str) -> str:
    return re.sub(r"(?<=[ins)\]}])\Z", ";", _go_end().sub(r"\1;", s).replace("\n", "")) if s else s


@lru_cache(maxsize=4)
def _js_end(lang: str) -> re.Pattern[str]:
    a = alphabet(lang)
    go_on = "".join(a[w] for w in ("in", "instanceof", "of", "else", "catch", "finally", "extends"))
    words = "".join(a[w] for w in KEYWORDS[lang].split() if w in a and w not in VALUES[lang].split())
    ends = "".join(a[w] for w in ("break", "continue", "return", "debugger"))
    starts = "".join(c for c in words if c not in go_on)
    return re.compile(f"([ins)\\]{a['INC']}{ends}])\n+(?=[ins@{{{starts}{a['NOT']}])")


def _js_semicolons(s: str, lang: str) -> str:
    return _js_end(lang).sub(r"\1;", s).replace("\n", "")
