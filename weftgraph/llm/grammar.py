"""Grammars over token classes: permissible adjacent pairs and recognisers of nested texts.

A grammar is a set of rules ``Name := expression`` whose expressions use quoted or named terminals, other rules,
``( ) | * + ?`` and bracket groups ``'(' X ')'``. Rules may recurse through bracket groups only. From that follow

* ``pairs``: every pair of tokens that may stand side by side (with ``^`` before and ``$`` behind the text), from the first
  and last sets of the parts;
* ``recogniser``: one automaton for the text itself and one for each content that a group has in the rules. A group is
  judged by the contents of the productions that may open it where it stands, and only those that accept it go on. As
  recursion goes through groups only, each level is a regular language. Recognisers are position automata, determinised
  as they run.
"""

from __future__ import annotations

import re
from functools import lru_cache

from weftgraph.llm.lexers import alphabet

#: Brackets; the indented lines of a Python suite are a group as well.
OPEN = {"(": ")", "[": "]", "{": "}", "I": "D"}


class _Parser:
    def __init__(self, text: str):
        self.toks = re.findall(r"'[^']+'|\w+|[()|*+?]", text)
        self.i = 0

    def peek(self) -> str | None:
        return self.toks[self.i] if self.i < len(self.toks) else None

    def alt(self):
        parts = [self.seq()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.seq())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def seq(self):
        items = []
        while (t := self.peek()) is not None and t not in "|)":
            if t == "(":
                self.i += 1
                node = self.alt()
                self.i += 1
            else:
                self.i += 1
                node = ("lit", t[1:-1]) if t[0] == "'" else ("name", t)
            while (q := self.peek()) is not None and q in "*+?":
                self.i += 1
                node = ("opt", node) if q == "?" else ("star", node) if q == "*" else ("seq", [node, ("star", node)])
            items.append(node)
        return ("seq", _grouped(items))


def _grouped(items: list) -> list:
    """Literal brackets and what lies between them become one group node."""
    out, i = [], 0
    while i < len(items):
        n = items[i]
        if n[0] == "lit" and n[1] in OPEN:
            depth, j = 1, i
            while depth:
                j += 1
                if items[j][0] == "lit":
                    depth += (items[j][1] == n[1]) - (items[j][1] == OPEN[n[1]])
            out.append(("group", n[1], ("seq", _grouped(items[i + 1 : j]))))
            i = j
        else:
            out.append(n)
        i += 1
    return out


class Grammar:
    def __init__(self, lang: str, rules: str, top: str = "Top"):
        self.letters = alphabet(lang)
        self.rules = {}
        for line in re.split(r"\n(?=\w+ :=)", rules.strip()):
            name, body = line.split(":=", 1)
            self.rules[name.strip()] = _Parser(body).alt()
        self.top = top
        self._cache: dict = {}
        self.contents: list = [("opt", ("name", top))]
        self._numbers: dict[int, int] = {}
        self._same: dict[str, int] = {}

    def letter(self, name: str) -> str:
        return self.letters[name]

    def nullable(self, node) -> bool:
        return self._sets(node)[0]

    def _sets(self, node) -> tuple[bool, frozenset, frozenset]:
        """(nullable, first, last) at token level."""
        key = id(node)
        if key in self._cache:
            return self._cache[key]
        kind = node[0]
        if kind == "lit" or (kind == "name" and node[1] not in self.rules):
            s = frozenset(self.letter(node[1]))
            r = (False, s, s)
        elif kind == "name":
            r = self._sets(self.rules[node[1]])
        elif kind == "group":
            r = (False, frozenset(node[1]), frozenset(OPEN[node[1]]))
        elif kind == "alt":
            xs = [self._sets(x) for x in node[1]]
            r = (any(x[0] for x in xs), frozenset().union(*(x[1] for x in xs)), frozenset().union(*(x[2] for x in xs)))
        elif kind in ("opt", "star"):
            x = self._sets(node[1])
            r = (True, x[1], x[2])
        else:
            null, first, last = True, frozenset(), frozenset()
            for x in map(self._sets, node[1]):
                first = first | x[1] if null else first
                last = last | x[2] if x[0] else x[2]
                null = null and x[0]
            r = (null, first, last)
        self._cache[key] = r
        return r

    @property
    def pairs(self) -> set[str]:
        """All permissible adjacent pairs as two-character strings."""
        out: set[str] = set()
        seen: set[str] = set()

        def cross(a, b):
            out.update(x + y for x in a for y in b)

        def walk(node):
            kind = node[0]
            if kind == "name" and node[1] in self.rules:
                if node[1] not in seen:
                    seen.add(node[1])
                    walk(self.rules[node[1]])
            elif kind == "alt":
                for x in node[1]:
                    walk(x)
            elif kind in ("opt", "star"):
                walk(node[1])
                if kind == "star":
                    _, f, la = self._sets(node[1])
                    cross(la, f)
            elif kind == "seq":
                for i, x in enumerate(node[1]):
                    walk(x)
                    for y in node[1][i + 1 :]:
                        cross(self._sets(x)[2], self._sets(y)[1])
                        if not self._sets(y)[0]:
                            break
            elif kind == "group":
                walk(node[2])
                null, f, la = self._sets(node[2])
                cross(node[1], f)
                cross(la, OPEN[node[1]])
                if null:
                    out.add(node[1] + OPEN[node[1]])

        walk(("name", self.top))
        null, f, la = self._sets(("name", self.top))
        cross("^", f)
        cross(la, "$")
        out.add("^$")  # an empty file and one of comments only are valid everywhere
        return out

    def content(self, node) -> int:
        """The number of a group's content; equal contents have one number. 0 is the text itself."""
        if id(node) not in self._numbers:
            self._numbers[id(node)] = n = self._same.setdefault(repr(node), len(self.contents))
            if n == len(self.contents):
                self.contents.append(node)
        return self._numbers[id(node)]

    def inside(self, bracket: str) -> list[int]:
        """The contents that groups of this bracket have in the rules."""
        out: dict[int, None] = {}

        def walk(node):
            if node[0] in ("alt", "seq"):
                for x in node[1]:
                    walk(x)
            elif node[0] in ("opt", "star"):
                walk(node[1])
            elif node[0] == "group":
                if node[1] == bracket:
                    out[self.content(node[2])] = None
                walk(node[2])

        for rule in self.rules.values():
            walk(rule)
        return list(out)


class _Rule:
    """Position automaton of one rule; a symbol is a class character, the name of another rule, or (bracket, content) of a group."""

    def __init__(self, g: Grammar, node):
        self.symbols: list = []
        self.call: list[bool] = []
        self.follow: list[set[int]] = []
        self.null, self.first, self.last = self._build(g, node)

    def _build(self, g: Grammar, node):
        kind = node[0]
        if kind in ("lit", "name", "group"):
            p = len(self.symbols)
            called = kind == "name" and node[1] in g.rules
            self.symbols.append(node[1] if called else (node[1], g.content(node[2])) if kind == "group" else g.letter(node[1]))
            self.call.append(called)
            self.follow.append(set())
            return called and g.nullable(node), {p}, {p}
        if kind == "alt":
            null, first, last = False, set(), set()
            for x in node[1]:
                n, f, la = self._build(g, x)
                null, first, last = null or n, first | f, last | la
            return null, first, last
        if kind in ("opt", "star"):
            n, f, la = self._build(g, node[1])
            if kind == "star":
                for p in la:
                    self.follow[p] |= f
            return True, f, la
        null, first, last = True, set(), set()
        for x in node[1]:
            n, f, la = self._build(g, x)
            for p in last:
                self.follow[p] |= f
            first = first | f if null else first
            last = last | la if n else la
            null = null and n
        return null, first, last


class _State:
    """Configurations that a part of a level leads to: their moves by class character, and by the contents of a group."""

    def __init__(self, configs: frozenset, moves: dict, done: bool):
        self.configs, self.moves, self.done = configs, moves, done
        self.inside: dict[str, list[int]] = {}
        for s in moves:
            if isinstance(s, tuple):
                self.inside.setdefault(s[0], []).append(s[1])
        self.runs: dict = {}


class Recogniser:
    """Recogniser of a text with its groups: a network of rule automata that call each other, made deterministic as it runs.

    A configuration is the stack of places in the rules that led to the last token. As rules recurse through brackets
    only, stacks are short; only configurations that texts really reach are ever made.
    """

    #: States, and judged short groups, that are kept.
    STATES, GROUPS = 20_000, 200_000

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.parts = re.compile("[" + re.escape("".join([*OPEN, *OPEN.values()])) + "]|[^" + re.escape("".join([*OPEN, *OPEN.values()])) + "]+")
        self.rules: dict[str, _Rule] = {}
        self.roots: dict[int, _Rule] = {}
        self.clear()

    def clear(self) -> None:
        self.next: dict = {}
        self.states: dict[frozenset, _State] = {}
        self.starts: dict[int, _State] = {}
        self.known: dict[tuple[int, str], bool] = {}

    def _rule(self, name: str) -> _Rule:
        if name not in self.rules:
            self.rules[name] = _Rule(self.grammar, self.grammar.rules[name])
        return self.rules[name]

    def _after(self, config: tuple | int) -> tuple[dict, bool]:
        """(symbol -> configurations, whether the level may end) behind a configuration; a number is the start of a content."""
        if config in self.next:
            return self.next[config]
        out: dict = {}
        seen: set = set()
        done = False
        work: list[tuple[bool, tuple, _Rule, int]] = []  # (entering?, callers, rule, place)

        def leave(callers, rule, p):
            nonlocal done
            for q in rule.follow[p]:
                work.append((True, callers, rule, q))
            if p in rule.last:
                if callers:
                    work.append((False, callers[:-1], *callers[-1]))
                else:
                    done = True

        if isinstance(config, int):
            if config not in self.roots:
                self.roots[config] = _Rule(self.grammar, self.grammar.contents[config])
            root = self.roots[config]
            done = root.null
            work += [(True, (), root, p) for p in root.first]
        else:
            leave(config[0], config[1], config[2])
        while work:
            item = work.pop()
            if item in seen:
                continue
            seen.add(item)
            enter, callers, rule, p = item
            if not enter:
                leave(callers, rule, p)
            elif not rule.call[p]:
                out.setdefault(rule.symbols[p], set()).add((callers, rule, p))
            else:
                inner = self._rule(rule.symbols[p])
                work += [(True, (*callers, (rule, p)), inner, q) for q in inner.first]
                if inner.null:
                    leave(callers, rule, p)
        self.next[config] = (out, done)
        return out, done

    def _state(self, configs: frozenset) -> _State:
        if configs not in self.states:
            moves: dict = {}
            done = False
            for x in configs:
                out, end = self._after(x)
                done = done or end
                for s, to in out.items():
                    moves.setdefault(s, set()).update(to)
            self.states[configs] = _State(configs, moves, done)
        return self.states[configs]

    def _start(self, content: int) -> _State:
        if content not in self.starts:
            self.starts[content] = self._state(frozenset([content]))
        return self.starts[content]

    def _run(self, state: _State, part: str | tuple) -> _State | None:
        """Behind tokens without brackets, or behind a group that has the given (bracket, content)s."""
        if part not in state.runs:
            to: _State | None = state
            if isinstance(part, tuple):
                to = self._state(frozenset().union(*(state.moves[s] for s in part))) if part else None
            elif len(part) == 1:
                to = self._state(frozenset(state.moves[part])) if part in state.moves else None
            else:
                for c in part:
                    if (to := self._run(to, c)) is None:
                        break
            state.runs[part] = to
        return state.runs[part]

    def _partners(self, parts: list[str]) -> list[int] | None:
        """For each opening bracket the place of its partner, else -1; None if the brackets do not pair."""
        at, opened = [-1] * len(parts), []
        closing = set(OPEN.values())
        for i, p in enumerate(parts):
            if p in OPEN:
                opened.append(i)
            elif p in closing:
                if not opened or OPEN[parts[opened[-1]]] != p:
                    return None
                at[opened.pop()] = i
        return None if opened else at

    def accepts(self, s: str, content: int = 0) -> bool:
        """Whether s is a text of the language, or another content of the grammar."""
        if len(self.states) > self.STATES or len(self.known) > self.GROUPS:
            self.clear()
        parts = self.parts.findall(s)
        partner = self._partners(parts)
        if partner is None:
            return False
        here: dict[tuple[int, int], bool] = {}  # (content, place of the bracket) -> accepted
        work: list[list] = [[(content, -1), 0, len(parts), self._start(content)]]
        while work:
            frame = work[-1]
            key, i, end, state = frame
            good: bool | None = None
            while i < end:
                j = partner[i]
                if j < 0:
                    state, i = self._run(state, parts[i]), i + 1
                else:
                    text = "".join(parts[i : j + 1]) if j - i <= 12 else None
                    kept, asked = [], None
                    for c in state.inside.get(parts[i], ()):
                        known = here.get((c, i)) if text is None else self.known.get((c, text))
                        if known is None:
                            asked = c
                            break
                        if known:
                            kept.append((parts[i], c))
                    if asked is not None:
                        frame[1:] = i, end, state
                        work.append([(asked, i if text is None else text), i + 1, j, self._start(asked)])
                        break
                    state, i = self._run(state, tuple(kept)), j + 1
                if state is None:
                    good = False
                    break
            else:
                good = state.done
            if good is not None:
                (here if isinstance(key[1], int) else self.known)[key] = good
                work.pop()
        return here[(content, -1)]


@lru_cache(maxsize=16)
def grammar(lang: str) -> Grammar:
    from weftgraph.llm.rules import RULES

    return Grammar(lang, RULES[lang])


@lru_cache(maxsize=16)
def recogniser(lang: str) -> Recogniser:
    return Recogniser(grammar(lang))


class _Level:
    """Accepts what some group of a bracket may hold."""

    def __init__(self, lang: str, bracket: str):
        self.recogniser, self.contents = recogniser(lang), grammar(lang).inside(bracket)

    def accepts(self, s: str) -> bool:
        return any(self.recogniser.accepts(s, c) for c in self.contents)


@lru_cache(maxsize=16)
def levels(lang: str) -> dict[str, _Level]:
    """For each opening bracket what its groups may hold somewhere in a text."""
    return {b: _Level(lang, b) for b in OPEN}
