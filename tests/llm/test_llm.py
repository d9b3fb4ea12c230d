import pytest
from pyspark.sql import functions as F

from weftgraph.llm import docpairs, handwritten, mixture, quality, syntax, tokens
from weftgraph.llm.grammar import grammar, levels
from weftgraph.llm.rules import RULES


def test_tokens_equal_whole_encoding(spark):
    texts = ["", None, "don't stop  \n\n now 'r'e <|endoftext|> ", "日本語 text " * 300, "a" * 5000, "x  y\t\tz\r\n" * 400]
    texts.append("".join(chr(0x4E00 + i * i % 2999) for i in range(60_000)))
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows + rows[2:4], "doc_id bigint, text string")
    enc, _ = tokens.encoder(tokens.TOKENIZERS, "byte_bpe_50k")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(d).collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}


@pytest.mark.parametrize("mean", [2, 7, 64])
def test_joints(mean):
    enc, pat = tokens.encoder(tokens.TOKENIZERS, "byte_bpe_50k")
    text = "we'll  see 've it's\n\n  done 123,456 ---- 'll'l x'rex 日本" * 9
    parts = []
    for c, _ in tokens.cuts([text], mean=mean, safe=1)[0]:
        found = pat.findall(c)
        tail = tokens.tail_of(found)
        parts.append((c, enc.encode_ordinary(c), len(tail), sum(len(enc.encode_ordinary(p)) for p in pat.findall(tail))))
    assert tokens.join_chunks(parts, enc.encode_ordinary, pat) == enc.encode_ordinary(text)
    for t in (text, "a b " * 300, "x\u00a0 y\u3000 z\x1c q\t\n" * 60, "日本" * 200, "  \n \n\n a" * 90):
        cut = tokens.cuts([t], mean=mean, safe=1)[0]
        assert "".join(c for c, _ in cut) == t
        assert tokens.repaired([c for c, _ in cut], [enc.encode_ordinary(c) for c, _ in cut], [g for _, g in cut], enc.encode_ordinary, pat) == enc.encode_ordinary(t)


def test_broken_sources(spark):
    good = [("a.py", "def f(x):\n    return [x for x in y if x]\n"), ("b.go", "package a\n\nfunc f() int {\n\treturn 1\n}\n"), ("c.rs", ""), ("d.ts", "const s = '<<<<<<< a';\nexport function f(a: string): void { g(a); }\n"), ("e.java", "class A { int f() { return 1; } }"), ("f.c", "// only\n")]
    bad = [("g.py", "def f(x)\n    return 1\n"), ("h.go", "package a\nfunc f() {\n"), ("i.js", "function f(a: string) {}\n"), ("j.java", "class A {\n<<<<<<< HEAD\n}\n"), ("k.c", "int f() { return \"x; }"), ("l.rs", "<html><p>x</p></html>")]
    d = spark.createDataFrame([("r", p, s) for p, s in good + bad + good[:1]] + [("r", "n.py", None), (None, "o.txt", "((")], "repo_id string, path string, source string")
    assert {r.path for r in syntax.broken(d).collect()} == {p for p, _ in bad}


def test_groups_are_judged_where_they_stand(spark):
    good = [("a.rs", "m! { let = => 3 let }\n#[cfg(any(x = \"a\", y))]\nfn f(v: Vec<u8>) -> u8 {\n    if v.len() > 1 { g(1, &v)?; }\n    match v[0] { 1 | 2 => 3, _ => h!(let let) }\n}\n"), ("b.java", "class A { int f() { if (a) { return 1; } while (b) { c(); } } }"), ("c.c", "int f(void) { if (a) { return 1; } g(); }")]
    bad = [("d.rs", "fn f() { let = = 3 let }"), ("e.rs", "fn f() { g(fn fn); }"), ("f.rs", "fn f(let x) {}"), ("g.rs", "fn f() { { { let x = [while 3]; } } }"), ("h.java", "class A { int f() { if () { return 1; } } }"), ("i.java", "class A { int f() { while () { } } }"), ("j.java", "class A { return 1; }"), ("k.js", "if () { f(); }"), ("l.c", "int f(void) { while () { } }")]
    d = spark.createDataFrame([("r", p, s) for p, s in good + bad], "repo_id string, path string, source string")
    assert {r.path for r in syntax.broken(d).collect()} == {p for p, _ in bad}


def test_python_compound_statements(spark):
    whole = ["try:\n    f()\nexcept A as e:\n    g()\nexcept:\n    pass\nelse:\n    h()\nfinally:\n    i()\n", "try: f()\nfinally: g()\n", "if a:\n    b()\nelif c:\n    if d: e()\n    else: g()\nelse:\n    for x in y:\n        pass\n    else:\n        f()\n", "@d\n@e(1)\nasync def f():\n    pass\n", "match a:\n    case [x, y] if x:\n        pass\n    case _:\n        pass\n", "class A:\n\n    def f(self):\n        try:\n            return 1\n        except* B:\n            raise\n# end\n"]
    cut = ["def f():\n    try:\n        g()\n", "try:\n    g()\nh()\n", "except A:\n    pass\n", "x = 1\nelse:\n    y()\n", "if a:\n    b()\nelse:\n    c()\nelif d:\n    e()\n", "try:\n    f()\nelse:\n    g()\n", "try:\n    f()\nexcept:\n    g()\nexcept A:\n    h()\n", "finally:\n    f()\n", "@d\nx = 1\n", "def f():\n    if a:\n        b()\n  c()\n"]
    d = spark.createDataFrame([("r", f"{k}{i}.py", s) for k, ss in (("whole", whole), ("cut", cut)) for i, s in enumerate(ss)], "repo_id string, path string, source string")
    assert {r.path for r in syntax.broken(d).collect()} == {f"cut{i}.py" for i in range(len(cut))}


def test_handwritten(spark):
    ref = "\n".join(f"int name{i}(int value{i}) {{ return other{i} + {i}; }}" for i in range(40))
    d = [("vendor/a.c", "int x;"), ("b.js", "// Code generated by x 1.0. DO NOT EDIT.\nf();"), ("c.py", "x = '// @generated'\n"), ("d.py", "# Not generated code, although tools reads it\nx = 1\n"), ("e.c", ref + "\nint more;"), ("src/vendors/f.py", "x = 1"), ("g.min.js", "f()"), ("h.py", "D = [\n" + "1, 22, 333,\n" * 60 + "]\n"), ("i.py", None)]
    d += [("j.py", 'BLOB = "' + "aB3//x9Qz/k" * 40 + '"\n'), ("k.go", "// Diese Datei wurde von x 1.2 erzeugt und wird überschrieben.\npackage a\n"), ("l.js", "f();"), ("m.py", "X = [1, 2, 3]\n"), (None, "x")]
    up = spark.createDataFrame([(ref,)], "source string")
    got = {r.path for r in handwritten.not_handwritten(spark.createDataFrame([("r", p, s) for p, s in d], "repo_id string, path string, source string"), up).collect()}
    assert got == {"vendor/a.c", "b.js", "e.c", "g.min.js", "h.py", "j.py", "k.go"}


def test_docstrings():
    say = lambda d, n="pushGridStage", s="(x)": docpairs.informative(d, n, s)
    assert say("Blocks until the unit has room for another tag.") and say("Returns -1 if no rule fits.") and say("TODO: tidy up.\nrankを更新し、変更された数を返します。")
    assert not any(map(say, [None, "", "  ", "Push grid stage.", "TODO", "@param x the x\n@return the result", "return tail + 1;", "noqa: E501", "Licensed under the terms in NOTICE.", "==========", "Created 2023-08-18"]))


def test_pairs(spark):
    f = spark.createDataFrame([("r", "a.py", "f", "a.py:f", None, "(x)", "Blocks until the unit has room for another tag.", 1)], "repo_id string, path string, name string, id string, class_id string, signature string, docstring string, start_line int")
    c = spark.createDataFrame([], "repo_id string, id string, docstring string")
    s = spark.createDataFrame([("r", "a.py", "def f(x):\n    return 1\n\ny = 2\n")], "repo_id string, path string, source string")
    assert [r.code for r in docpairs.pairs(f, c, s).collect()] == ["def f(x):\n    return 1"]
    assert [r.code for r in docpairs.pairs(f, c, s.limit(0)).collect()] == [None]


def test_documentation_comes_from_the_source(spark):
    java = 'class A {\n  int x;\n\n  // Licence of nothing.\n\n  // Blocks until the unit has room,\n  // then takes the next tag.\n  @Override(note = "}")\n  public int f(int x) {\n    String s = "{ /* no */";\n    return g(x);\n  }\n  /** Holds the lock while the store is open. */\n  int h() { return 1; }\n  int k() { return 2; }\n}\n'
    js = "const a = (x) => {\n  return x;\n};\n// Sends every batch twice when the line is slow.\nexport const b = async (x) => g(x);\nfoo(a)\nif (b) { c(); }\n"
    s = spark.createDataFrame([("r", "A.java", java), ("r", "A.java", java), ("r", "b.js", js), ("r", "c.py", ""), ("r", "d.txt", "int f() {}"), (None, "e.py", None)], "repo_id string, path string, source string")
    got = {(r.path, r.name): (r.start_line, r.end_line, r.comment) for r in docpairs.spans(s).collect()}
    assert got == {
        ("A.java", "f"): (8, 12, "// Blocks until the unit has room,\n  // then takes the next tag."), ("A.java", "h"): (14, 14, "/** Holds the lock while the store is open. */"), ("A.java", "k"): (15, 15, None),
        ("b.js", "a"): (1, 3, None), ("b.js", "b"): (5, 5, "// Sends every batch twice when the line is slow."),
    }
    rec = lambda name, doc, line, owner="A.java:A": ("r", "A.java", name, f"A.java:A:{name}", owner, "()", doc, line)
    f = spark.createDataFrame([rec("f", "Blocks until the unit has room, then takes the next tag.", 8), rec("h", "Holds the lock while the store is open.", 14), rec("k", None, 15)], "repo_id string, path string, name string, id string, class_id string, signature string, docstring string, start_line int")
    c = spark.createDataFrame([("r", "A.java:A", "Holds the lock while the store is open.")], "repo_id string, id string, docstring string")
    assert [(r.function_id, r.description[:2]) for r in docpairs.pairs(f, c, s).collect()] == [("A.java:A:f", "//")]


def test_spans_of_whole_functions(spark):
    java = "class A {\n    int f(int x) {\n        if (x > 1) {\n            x--;\n        }\n        while (x < 9) {\n            x++;\n        }\n        for (int a : b) {\n            g(a);\n        }\n        switch (x) {\n            default: x = 1;\n        }\n        return x;\n    }\n}\n"
    cpp = "int h(int a);\n\nvoid f(int a)\n{\n    run();\n}\n\nint g()\n{\n    do {\n        x();\n    } while (y);\n    return 1;\n}\n"
    py = "def f(x):\n    def g(y):\n        return y\n    return g(x)\n\nz = 1\n"
    js = "function f(x) {\n  function g(y) {\n    return y;\n  }\n  return g(x);\n}\n"
    rust = "fn a() -> i32 { 1 }\nfn b(x: i32) -> i32 {\n    x\n}\n"
    s = spark.createDataFrame([("r", p, t) for p, t in [("A.java", java), ("b.cpp", cpp), ("c.py", py), ("d.js", js), ("e.rs", rust)]], "repo_id string, path string, source string")
    got = {(r.path, r.name): (r.start_line, r.end_line) for r in docpairs.spans(s).collect()}
    assert got == {("A.java", "f"): (2, 16), ("b.cpp", "f"): (3, 6), ("b.cpp", "g"): (8, 14), ("c.py", "f"): (1, 4), ("c.py", "g"): (2, 3), ("d.js", "f"): (1, 6), ("d.js", "g"): (2, 4), ("e.rs", "a"): (1, 1), ("e.rs", "b"): (2, 4)}


def test_mixture_caps_repeats(spark):
    docs = spark.createDataFrame([(i, "A b" if i % 3 else " a_B", "some words here " * 50) for i in range(60)] + [(100, "small", "few words " * 30), (101, None, "x"), (102, "small", None)], "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("a_b", 0.9, 1), ("small", 0.1, 3), ("none", 0.2, 4)], "source string, target_share double, max_repeats int")
    m = mixture.mixture(docs, t)
    assert m.groupBy("doc_id").count().join(m.select("doc_id", "source"), "doc_id").filter("(source = 'small' and count > 3) or (source = 'a_b' and count > 1)").count() == 0
    assert {r.source: r.tokens for r in mixture.report(docs, t).collect()}["none"] == 0
    # a recount of the mixture gives the report
    rows = m.collect()
    for r in mixture.report(docs, t).collect():
        mine = [x for x in rows if x.source == r.source]
        uses = {d: sum(x.doc_id == d for x in mine) for d in {x.doc_id for x in mine}}
        assert (r.tokens, r.uses, r.texts, r.max_uses) == (sum(x.tokens for x in mine), len(mine), len(uses), max(uses.values(), default=0))
    full = {r.source: r for r in mixture.report(docs, t, total=mixture.available(docs, t)).collect()}
    assert full["small"].max_uses == 3 and full["small"].short > 0 and full["a_b"].max_uses == 1 and full["none"].tokens == 0
    assert mixture.mixture(docs.limit(0), t).count() == 0 and mixture.mixture(docs, t.limit(0)).count() == 0


@pytest.mark.parametrize("quota", [[4096 * 9], [4096 * 1000, 4096 * 3, 5], [1, 1, 1], [4096 * 700, 4096 * 701, 4097]])
def test_slots_never_run_short(spark, quota):
    q = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(quota)], "source string, quota bigint")
    got = {r.source: r["count"] for r in mixture.slots(q).groupBy("source").count().collect()}
    assert all(got[f"s{i}"] >= -(-x // mixture.BLOCK) for i, x in enumerate(quota))


def test_prose(spark):
    prose = "The old reader was slow, so we moved it out of the loop. It is safe to call it twice because the store keeps what it has seen. "
    d = spark.createDataFrame([(1, prose), (2, "- a\n- b c\n- d\n" * 9), (3, ""), (4, None), (5, "int f() { return 1; }\n" * 9), (6, prose * 2 + "\n\n    f(x)\n")], "doc_id bigint, text string")
    st = quality.statistics(d)
    assert {r.doc_id for r in quality.prose(st).collect()} == {1, 6}
    assert st.filter(F.col("words") == 0).count() == 2


def test_prose_tails_and_scripts(spark):
    say = "The old reader number {} was slow, so we moved it out of the loop. It is safe to call it {} times because the store keeps what it has seen. "
    russian = "Старый читатель работал слишком медленно, поэтому мы вынесли его из цикла. Теперь он ждёт, пока хранилище освободится.\n"
    hindi = "पुराना पाठक बहुत धीमा था इसलिए हमने उसे लूप से बाहर कर दिया। अब वह भंडार के खाली होने तक प्रतीक्षा करता है।\n"
    rows = [(i, say.format(i, i + 1) + say.format(i + 2, i + 3)) for i in range(60)]
    rows += [(100, "It stays in the cache.\n" * 60), (101, "\n".join(f"load_x{i}\tno\t{i}\tno\ta\tgrid" for i in range(30))), (102, russian), (103, hindi), (104, say + "\n\n- one\n- two\n"), (105, "T\u0336h\u0336e\u0336 \u0336o\u0336l\u0336d\u0336 is in the loop of it and the one\u0336.")]
    st = quality.statistics(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id for r in quality.prose(st).collect()} == {*range(60), 102, 103, 104}
    s = quality.scored(st, quality.quantiles(quality.sketches(st)))
    assert s.filter("doc_id = 5 and (prose_ratio_pct <= 0 or abs(common_ratio_z) > 3.5)").count() == 0 and s.count() == st.count()
    assert quality.prose(st.limit(0)).count() == 0


def test_grammars_accept_reduced_groups():
    for lang in RULES:
        lv = levels(lang)
        for s in ("", "i", "s", "i,n,s"):
            assert lv["("].accepts(s), (lang, s)
        assert "^$" in grammar(lang).pairs
