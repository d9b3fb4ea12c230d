"""Entities of brace languages (Java, TypeScript and JavaScript, Go, Rust, C and C++) by a lexical scan.

Strings and comments are masked, braces are matched, and declarations are found by their heads; what a declaration
belongs to is the innermost type whose braces hold it. This covers declarations as people lay them out; it is no full
parser, and heads that macros or unusual layouts hide are missed.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from weftgraph.parse.records import Records

_BLANK = {
    "rust": r'//[^\n]*|/\*[\s\S]*?\*/|r(#*)"[\s\S]*?"\1|"(?:\\[\s\S]|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'',
    "go": r'//[^\n]*|/\*[\s\S]*?\*/|`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "ts": r"//[^\n]*|/\*[\s\S]*?\*/|(?<=[(,=:\[!&|?{};+])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`",
    "": r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`",
}
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "synchronized", "new", "throw", "sizeof", "with", "function", "await", "match", "loop", "super", "this", "assert", "case", "typeof", "defined", "elif"}
_BRANCH = re.compile(r"\b(?:if|for|while|catch|case|match)\b|&&|\|\||\?(?![.:?])")
_CALL = re.compile(r"(?<![\w.])(?:new\s+)?(?:[\w$]+(?:\.|::|->))*([A-Za-z_$][\w$]*)!?\s*(?:<[\w, ]*>)?\(")
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|export|default|declare|async|override|readonly|virtual|inline|constexpr|explicit|native|strictfp|synchronized|friend)\s+)*"
_TYPES = {
    "java": re.compile(rf"(?P<mods>{_MODS})\b(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)\s*(?:<[^{{]*?>)?\s*(?P<rest>[^{{;]*)\{{"),
    "ts": re.compile(rf"(?P<mods>{_MODS})\b(?P<kind>class|interface|enum)\s+(?P<name>[\w$]+)\s*(?:<[^{{]*?>)?\s*(?P<rest>[^{{;=]*)\{{"),
    "go": re.compile(r"^(?P<mods>)type\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*(?P<kind>struct|interface)(?P<rest>)\s*\{", re.M),
    "rust": re.compile(r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?)(?P<kind>struct|enum|trait)\s+(?P<name>\w+)\s*(?:<[^{;(]*>)?\s*(?P<rest>[^{;(]*)(?:\{|;|\()", re.M),
    "cpp": re.compile(r"(?P<mods>)\b(?P<kind>class|struct|enum(?:\s+class)?|union)\s+(?P<name>\w+)\s*(?:final\s*)?(?P<rest>(?::[^{;()]*)?)\{"),
}
_FUNCS = {
    "java": re.compile(rf"(?P<mods>{_MODS})(?:<[^>]*>\s*)?(?P<ret>[\w.<>,\[\]? ]+?\s+)?(?P<name>\w+)\s*\((?P<params>[^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*)\)\s*(?:throws\s+[\w., ]+)?(?P<end>[{{;])"),
    "ts": re.compile(rf"(?P<mods>{_MODS})(?P<fn>function\s*\*?\s*)?(?P<name>#?[\w$]+)\s*(?:<[^>(]*>)?\((?P<params>[^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*)\)\s*(?::\s*(?P<ret>[^{{;=]+?))?\s*(?P<end>\{{)"),
    "go": re.compile(r"^(?P<mods>)func\s*(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<params>[^{}]*?)\)\s*(?P<ret>[^{\n]*?)\s*(?P<end>\{)", re.M),
    "rust": re.compile(r"^[ \t]*(?P<mods>(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*)fn\s+(?P<name>\w+)\s*(?:<[^(]*>)?\s*\((?P<params>[^{;]*?)\)\s*(?:->\s*(?P<ret>[^{;]+?))?\s*(?:where[^{]*)?(?P<end>[{;])", re.M),
    "cpp": re.compile(r"(?P<mods>)(?P<ret>(?:[\w:<>,]+[\s*&]+)+)(?:\w+::)*(?P<name>~?\w+)\s*\((?P<params>[^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?:const|noexcept|override|final|\s)*(?P<end>[{;])"),
}
_ARROW = re.compile(r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)(?:\s*:[^=\n]+)?\s*=\s*(?P<async>async\s+)?(?:function\b[^(]*)?\((?P<params>[^()]*)\)\s*(?::\s*(?P<ret>[^={]+?))?\s*(?:=>)?\s*(?P<end>\{?)", re.M)


def family(lang: str) -> str:
    return {"js": "ts", "c": "cpp"}.get(lang, lang)


class _Text:
    def __init__(self, lang: str, source: str):
        self.source = source
        self.masked = re.sub(_BLANK.get(lang, _BLANK[""]), lambda m: re.sub(r"[^\n]", "\x02", m.group()), source)
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.close: dict[int, int] = {}
        stack = []
        for m in re.finditer(r"[{}]", self.masked):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def doc(self, at: int) -> str | None:
        """Contiguous comment lines right above a declaration, without their marks."""
        lines = self.source[: self.starts[self.line(at) - 1]].split("\n")[:-1]
        out: list[str] = []
        while lines and (re.match(r"\s*(?://|/\*|\*|#\[|@\w)", lines[-1])):
            out.append(lines.pop())
        text = [re.sub(r"^\s*(?:/\*\*?|\*/|\*|///?!?)\s?|\s*\*/\s*$", "", x) for x in reversed(out) if not re.match(r"\s*(?:#\[|@\w)", x)]
        return "\n".join(text).strip() or None

    def marks(self, at: int) -> list[str]:
        lines = self.source[: self.starts[self.line(at) - 1]].split("\n")[:-1]
        out: list[str] = []
        while lines and (m := re.match(r"\s*(?:@([\w.]+)|#\[([^\]]*)\])", lines[-1])):
            out.insert(0, m.group(1) or m.group(2))
            lines.pop()
        return out


def _names(text: str) -> list[str]:
    flat = text
    while re.search(r"<[^<>]*>", flat):
        flat = re.sub(r"<[^<>]*>", "", flat)
    return [re.split(r"\s+", x.strip())[-1] for x in flat.split(",") if x.strip()]


def _heirs(lang: str, rest: str) -> tuple[list[str], list[str]]:
    """(base classes, interfaces) written behind a type's name."""
    if lang == "cpp":
        return _names(rest.lstrip(": ")), []
    if lang == "rust":
        return [], []
    ext = re.search(r"\bextends\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", rest, re.S)
    imp = re.search(r"\bimplements\s+(.*?)(?=\bpermits\b|$)", rest, re.S)
    return _names(ext.group(1)) if ext else [], _names(imp.group(1)) if imp else []


def _params(lang: str, text: str) -> list[dict]:
    out = []
    for p in re.split(r",(?![^<(\[]*[>)\]])", text):
        p = p.strip()
        if not p:
            continue
        p, _, default = p.partition("=")
        p = p.strip()
        if lang in ("ts", "rust"):
            name, _, kind = p.partition(":")
        elif lang == "go":
            name, _, kind = p.partition(" ")
        else:
            kind, _, name = p.rpartition(" ")
            while name[:1] in ("*", "&"):
                kind, name = kind + name[0], name[1:]
        out.append({"name": name.strip() or "_", "type": kind.strip() or None, "default": default.strip() or None})
    return out


def parse(lang: str, path: str, source: str) -> Records:
    lang = family(lang)
    out, text = Records(path), _Text(lang, source)
    types: list[tuple[int, int, str, str]] = []
    for m in _TYPES[lang].finditer(text.masked):
        brace = m.end() - 1 if text.masked[m.end() - 1] == "{" else -1
        end = text.close.get(brace, m.end())
        kind, name = m["kind"].split()[0], m["name"]
        at = m.start(  "kind") if not m["mods"].strip() else m.start("mods")
        holders = [t for t in types if t[0] < m.start() < t[1]] if lang == "java" else []
        local = ":".join([*(t[3] for t in holders), name])
        bases, faces = _heirs(lang, m["rest"])
        if lang == "go" and kind == "struct":
            bases = [x.strip().lstrip("*") for x in text.masked[brace + 1 : end].split("\n") if re.fullmatch(r"\s*\*?[\w.]+\s*", x)]
        if kind in ("interface", "trait"):
            body = text.masked[brace + 1 : end] if brace >= 0 else ""
            out.interface(name, local, text.doc(at), re.findall(r"(?:fn\s+)?(\w+)\s*(?:<[^>(]*>)?\(", body))
        else:
            cid = out.klass(name, local, text.doc(at), text.line(at), text.line(end), "abstract" in m["mods"], text.marks(at), bases, faces, kind)
            for b in bases:
                out.detect(name, b, "EXTENDS", 0.95, "tree_query", text.line(at))
            for b in faces:
                out.detect(name, b, "IMPLEMENTS", 0.95, "tree_query", text.line(at))
            types.append((brace, end, cid, name))
    if lang == "rust":
        for m in re.finditer(r"^impl\b\s*(?:<[^{]*?>\s*)?(?:(?P<trait>[\w:<>, ]+?)\s+for\s+)?(?P<name>\w+)[^{;]*\{", text.masked, re.M):
            types.append((m.end() - 1, text.close.get(m.end() - 1, m.end()), out.id(m["name"]), m["name"]))
            if m["trait"]:
                trait = re.sub(r"<.*", "", m["trait"]).split("::")[-1].strip()
                out._add("Implements", src_id=out.id(m["name"]), name=trait)
                out.detect(m["name"], trait, "IMPLEMENTS", 0.95, "tree_query", text.line(m.start()))
    _imports(out, lang, text)
    _functions(out, lang, text, types)
    return out


def _functions(out: Records, lang: str, text: _Text, types: list[tuple[int, int, str, str]]) -> None:
    found = [(m, False) for m in _FUNCS[lang].finditer(text.masked)]
    if lang == "ts":
        found += [(m, True) for m in _ARROW.finditer(text.masked)]
    spans: list[tuple[int, int]] = []
    for m, arrow in sorted(found, key=lambda x: x[0].start()):
        name = m["name"]
        if name in _CONTROL or any(a < m.start("name") < b for a, b in spans) and not arrow:
            continue
        at = m.start("name")
        holder = max((t for t in types if t[0] < at < t[1]), key=lambda t: t[0], default=None)
        d = m.groupdict()
        if lang == "java" and holder is None or lang == "ts" and not arrow and not d.get("fn") and holder is None:
            continue
        if lang == "cpp" and (d["ret"].split() or [""])[0] in {"return", "else", "new", "throw", "typedef", "using", "delete", "case"}:
            continue
        brace = m.end("end") - 1 if d["end"] == "{" else -1
        end = text.close.get(brace, m.end())
        if brace >= 0:
            spans.append((brace, end))
        owner = holder[2] if holder and not arrow else None
        if d.get("recv"):
            owner = out.id(re.sub(r"\[.*|[*&\s]", "", d["recv"].strip().split(" ")[-1]))
        params, ret = _params(lang, d["params"]), (d.get("ret") or "").strip() or None
        if lang == "rust":
            params = [p for p in params if not re.fullmatch(r"&?\s*(?:'\w+\s+)?(?:mut\s+)?self", p["name"])]
        mods = d.get("mods") or ""
        shown = {"java": f"{ret or ''} {name}({d['params'].strip()})".strip(), "cpp": f"{ret or ''} {name}({d['params'].strip()})".strip()}.get(lang)
        if shown is None:
            shown = f"({', '.join(p['name'] + (f': {p['type']}' if p['type'] and lang != 'go' else f' {p['type']}' if p['type'] else '') for p in params)})" + ({"ts": ": ", "rust": " -> ", "go": " "}[lang] + ret if ret else "")
        body = text.masked[brace:end] if brace >= 0 else ""
        if lang == "go":
            seen = "public" if name[:1].isupper() else "private"
        elif lang == "rust":
            seen = "public" if "pub" in mods else "private"
        else:
            seen = "private" if "private" in mods or name[0] == "#" else "protected" if "protected" in mods else "public"
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        fid = out.function(
            name, owner, shown, text.doc(start), text.line(start), text.line(end), is_async="async" in mods or bool(d.get("async")), is_static="static" in mods or lang == "rust" and owner is not None and "self" not in d["params"],
            returns=ret, complexity=1 + len(_BRANCH.findall(body)), params=params, visibility=seen,
        )
        for c in [] if arrow else _CALL.finditer(body):
            if c.group(1) not in _CONTROL:
                line = text.line(brace + c.start())
                out.call(fid, c.group(1), line)
                fresh = c.group().lstrip().startswith("new ") or (lang != "go" and c.group(1)[:1].isupper())
                out.detect(fid, c.group(1), "INSTANTIATES" if fresh else "CALLS", 0.9 if c.group().lstrip().startswith("new ") else 0.8, "tree_query", line)


def _imports(out: Records, lang: str, text: _Text) -> None:
    s = text.source
    if lang == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)(\.\*)?\s*;", s, re.M):
            last = m.group(1).split(".")[-1]
            out.imported(f"import:{m.group(1)}", last, m.group(1), True, [] if m.group(2) else [last])
    elif lang == "ts":
        for m in re.finditer(r"^\s*import\s+(?:type\s+)?(?:([\w$]+)?\s*,?\s*(?:\{([^}]*)\}|\*\s+as\s+([\w$]+))?\s*from\s+)?['\"]([^'\"]+)['\"]", s, re.M):
            symbols = [x.strip().split(" as ")[0].strip() for x in (m.group(2) or "").split(",") if x.strip()]
            out.imported(f"import:{m.group(4)}", m.group(1) or m.group(4).split("/")[-1], m.group(4), not m.group(4).startswith("."), symbols)
    elif lang == "go":
        for block in re.finditer(r"^import\s*(?:\(([^)]*)\)|(.*))$", s, re.M):
            for m in re.finditer(r"([\w.]+\s+)?\"([^\"]+)\"", block.group(1) or block.group(2) or ""):
                out.imported(f"import:{m.group(2)}", (m.group(1) or m.group(2).split("/")[-1]).strip(), m.group(2), True, [])
    elif lang == "rust":
        for m in re.finditer(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", s, re.M):
            for source, name in use_tree(m.group(1)):
                out.imported(f"import:{source}", name, source, not source.startswith(("crate", "self", "super")), [name])
    else:
        for m in re.finditer(r"^\s*#\s*include\s*([<\"])([^>\"]+)[>\"]", s, re.M):
            out.imported(f"import:{m.group(2)}", m.group(2).split("/")[-1], m.group(2), m.group(1) == "<", [])


def use_tree(text: str, prefix: str = "") -> list[tuple[str, str]]:
    """(source, bound name) of every leaf of a use declaration."""
    text = text.strip()
    head, brace, tail = text.partition("{")
    if brace:
        base = prefix + head.strip()
        out, depth, item = [], 0, ""
        for c in tail[: tail.rindex("}")] + ",":
            if c == "," and depth == 0:
                if item.strip():
                    out += use_tree(item, base)
                item = ""
            else:
                depth += (c == "{") - (c == "}")
                item += c
        return out
    source, _, alias = text.partition(" as ")
    source = prefix + source.strip()
    if source.endswith("self") and prefix:
        source = prefix.removesuffix("::")
    return [(source, alias.strip() or source.split("::")[-1])]
