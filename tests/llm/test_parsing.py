import ast
import json
import random

import pytest

from quarrylight.llm import parsing as p
from quarrylight.llm.syntax import grammars
from quarrylight.llm.syntax.chart import SPANS, paired_spans, paired_stacks, parse, unpaired

GOOD = {
    "json": ['{"a": [1, -2.5e3, "x\\n", null, {}]}', "3", '"s"', "[]"],
    "javascript": [
        "", "a\nb", "const re = /[({]+\\/\\*/g;", "export const f = (a, { b = 1, ...c } = {}) => {\n  return a ?? b;\n};",
        "class A extends B { static #x = 1; get y() { return this.#x } async *z() { yield* a } }", "for (const [k, v] of m) if (k) continue; else break;",
        "import a, { b as c } from 'x'; export default function () {}", "x = a ? b : c ? d : e;", "label: for (;;) { break label }", "`a${`b${1}`}c`", "if (a) b(); else { c() }", "let i = j++ / 2 / k",
        "switch (a) { case 1: case 2: b(); break; default: }", "try { a() } catch { } finally { }", "do x(); while (y)", "a = async (x) => await x;", "var o = { get a() { return 1 }, 'b': 2, [c]: 3, d, async e() {} };",
    ],
    "typescript": [
        "interface A<T> extends B { readonly a: string; b?: number | null; [k: string]: any; m(x: T): void }", "const m: Map<string, Array<number>> = new Map<string, Array<number>>();", "export type U = 'a' | { b: number }[];",
        "function f<T extends object>(this: A, x?: T, ...r: string[]): x is B { return x!.y as unknown as B }", "enum E { A = 1, B }", "abstract class C { constructor(private a: string, b = 2) {} abstract d(): void; }", "declare module 'x' { }",
    ],
    "go": [
        "package a\n", 'package a\n\nimport (\n\t"fmt"\n\tb "x/y"\n)\n\nfunc (s *T[K]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if b == 2 {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tfor i := range xs {\n\t\tcontinue\n\t}\n\treturn\n}\n',
        "package a\n\ntype S struct {\n\tA, B int `json:\"a\"`\n\t*T\n\tc map[string][]func(int) error\n}\n\nvar x = []S{{A: 1}, {B: 2}}\n\nfunc F[T any](x T) { switch y := x.(type) { case int, string: default: } ; select { case v := <-c: _ = v; default: } }\n",
    ],
    "java": [
        "", "package a.b;\n\nimport java.util.*;\n\n@A(x = 1)\npublic final class C<T extends D> implements E, F {\n  private static final Map<String, List<T>> m = new HashMap<>();\n  public C(int... a) throws X { this.a = a; }\n  @Override public <R> R f(Function<T, R> g) { return m.stream().map(x -> g.apply(x)).collect(toList()); }\n  enum G { A, B(1) { void h() {} }; int z; }\n}\n",
        "class A { int f(Object o) { for (int i = 0, j = 1; i < j; i++) { if (o instanceof String s && !s.isEmpty()) continue; } int[] a = {1, 2}; char c = (char) a[0]; return switch (c) { case 'a' -> 1; default -> { yield 2; } }; } }", "record R(int a, String b) { }", 'class T { String s = """\n  text "q"\n  """; }',
    ],
    "rust": [
        "", "use std::{fs, io::{self, Read}};\n\n#[derive(Debug)]\npub struct A<'a, T: Clone> where T: Copy {\n    pub a: &'a str,\n    b: Vec<Option<T>>,\n}\n\nimpl<'a, T> A<'a, T> {\n    pub fn f(&mut self, x: u32) -> Result<(), Box<dyn Error>> {\n        let v: Vec<_> = self.b.iter().filter(|y| y.is_some()).collect::<Vec<_>>();\n        if let Some(z) = v.get(0) { println!(\"{}\", x) } else { return Ok(()) }\n        match x { 0 => 1, n if n > 3 => { 2 } _ => 3 };\n        for (i, w) in v.iter().enumerate() { acc += *w as u64 * 2; }\n        Ok(())\n    }\n}\n",
        "fn main() { let c = 'a'; let s = r#\"x\"y\"#; loop { break } let A { a, .. } = b; while x < 3 { x += 1; } }",
    ],
    "c": ["", '#include <a.h>\n#define X(a) \\\n  { a\nstatic int f(const char *s, size_t n)\n{\n    for (i = 0; i < n; i++) {\n        if (s[i] == \'\\0\')\n            return -1;\n    }\n    return (int)n & 0x7fff;\n}\n', "struct a { unsigned b : 3; struct a *next; char c[4]; };\nenum e { A = 1, B, };\ntypedef int (*fn)(void *, ...);\nstatic const int t[] = { 1, 2, [4] = 3 };\n"],
    "shell": [
        "", "#!/bin/bash\nset -euo pipefail\nif [ \"${A:-}\" = \"b\" ]; then\n  echo \"$(ls \"x\" | wc -l)\" >&2\nelif ! true; then :; else exit 1\nfi\nf() {\n  local a=\"$1\"\n  for i in \"$a\"/*.x; do cp \"$i\" y; done\n}\nwhile read -r l; do echo $l; done < z\ncase \"$1\" in\n  a|b) echo 1 ;;\n  *) echo 2 ;;\nesac\ncat <<'EOT' > x\nif (\nEOT\na=(1 2 3)\n(( i++ )) && [[ -n $a && ( b ) ]]\n", "echo if then done fi",
    ],
    "python": [
        "", "# only\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> None:\n    return [x for x in a if x] or {**e, 'k': lambda y=1: y}\n\n\n@d.e(1)\nasync def g():\n    async with a as b, c:\n        await z\n    try:\n        raise X from y\n    except (A, B) as e:\n        pass\n    else:\n        yield\n    finally: a = b = c\n", "class A(B, metaclass=C):\n    '''doc'''\n    x: int\n    if x: pass\n    else:\n        y = x if 1 else 2\n", "x = (1,\n  2)\nmatch x:\n    case [a, *_] if a:\n        print(f'{a!r:>{2}}')\n    case _:\n        pass\n", "from . import (a as b, c,)\nx[1:2, ::3] = y\nprint(*a, **b)\nwith (open(a) as f, open(b)):\n    pass\nglobal_ = not a in b\n",
    ],
}
BAD = {
    "json": ["", "{'a': 1}", '{"a": 1,}', '{"a": 01}', '{"a"', "// x\n{}", "NaN", '{"a": 1} x', '"\t"'],
    "javascript": ["f(", "const = 1", "interface A { b: string; }", "function f(a: string) {}", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "x = ;", "a b", "class A B { }", "'abc", "package a\n\nfunc f() {}\n", "return Object.entriesrest).map(1);", "foo(a, b;", "type A = B;"],
    "typescript": ["interface A {", "package a", "const x: = 1;", "f(a, b;", ">>>>>>> main\n"],
    "go": ["", "func f() {}\n", "package a\n\nfunc f( {\n}\n", "package a\n\nfunc f() {\n", "package a\n\nimport x\n", "package a\n}\n", "package a\n\nfunc f() { x = = 1 }\n"],
    "java": ["class A {", "class A { void f() { int x = ; } }", "def f():\n  pass\n", "class A { /* ", "class A { int f() { return 1 } }"],
    "rust": ["fn f( {}", "fn f() {", "class A {}", "fn f() { let x = ; }", "use a", "package a;"],
    "c": ["int f(void) {", "int f() { return 1 }", "import a;\nclass B {}", "int a[] = { 1, 2;", "<<<<<<< ours\n"],
    "shell": ["if true; then\n echo 1\n", "echo 'a", "for i in a; do echo; \n", "f() {\n", "}\n", "int f(void)\n{\n", "case a in b) x ;;", "done\n"],
    "python": ["def f(:\n  pass\n", "if x\n  y\n", "  x = 1\n", "def f():\nx\n", "print 'a'\n", "x = (1\n", "try:\n  a\nb\n", "for x in y:\n", "import { a } from 'b';\n", "<<<<<<< HEAD\n", "x = 'a\n", "class A:\n    def f(self):\n        a\n      b\n", "a b\n"],
}
LANGS = {k: grammars.language(k) for k in GOOD}


@pytest.mark.parametrize("lang", GOOD)
def test_texts_that_parse(lang):
    for text in GOOD[lang]:
        assert p.exact(lang, text) in (True, None), text
        assert p.check(LANGS[lang], lang, text)[1] == 0, text
        assert p.check(LANGS[lang], lang, text.replace("\n", "\r\n"))[1] == 0, text


@pytest.mark.parametrize("lang", BAD)
def test_texts_that_do_not(lang):
    for text in BAD[lang]:
        assert p.exact(lang, text) in (False, None), text
        assert p.check(LANGS[lang], lang, text)[1] > 0, text


CODE = {
    "javascript": "function f(a) {\n  if (a[0]) {\n    return g({ b: [1, 2] });\n  }\n}\n",
    "typescript": "function f(a: number[]): void {\n  if (a[0]) {\n    g({ b: [1, 2] });\n  }\n}\n",
    "go": "package a\n\nfunc f(a []int) int {\n\tif a[0] > 1 {\n\t\treturn g(T{b: []int{1, 2}})\n\t}\n\treturn 1\n}\n",
    "java": "class A {\n  int f(int[] a) {\n    if (a[0] > 1) {\n      return g(new int[] {1, 2});\n    }\n    return 1;\n  }\n}\n",
    "rust": "fn f(a: &[i32]) -> i32 {\n    if a[0] > 1 {\n        return g(T { b: [1, 2] });\n    }\n    1\n}\n",
    "c": "int f(int *a)\n{\n    int b[2] = { 1, 2 };\n    if (a[0] > 1) {\n        return g(b[1]);\n    }\n    return 1;\n}\n",
    "python": "def f(a):\n    if a[0]:\n        return g({'b': [1, 2]})\n",
}


@pytest.mark.parametrize("lang", CODE)
def test_any_missing_or_doubled_bracket_is_noticed(lang):
    text = CODE[lang]
    assert p.check(LANGS[lang], lang, text)[1] == 0
    for i, c in enumerate(text):
        if c in "({[)]}":
            assert p.check(LANGS[lang], lang, text[:i] + text[i + 1 :])[1] >= 1, text[:i]
            assert p.check(LANGS[lang], lang, text[:i] + c + text[i:])[1] >= (1 if c in "]}" or lang in ("go", "java") else 0), text[:i]


def test_edits_are_least():
    def edits(t):
        return p.check(LANGS["javascript"], "javascript", t)[1]

    assert [edits(t) for t in ("a = ;", "f(1;", "x = (1 + ) * 2;", "a b c", "if (x) {\n")] == [1, 1, 1, 1, 1]


def test_tables_give_the_same_language():
    tables = grammars.tables("go")
    again = grammars.language("go", tables)
    for text in GOOD["go"] + BAD["go"]:
        assert p.check(again, "go", text) == p.check(LANGS["go"], "go", text)


def test_bracket_repair_is_cheapest():
    pairs, closers = {"(": ")", "[": "]"}, {")": "(", "]": "["}

    def cost(t):
        a, b = unpaired(t, pairs, closers)
        return len(a) + len(b)

    assert [cost(t) for t in ("", "()", "(", ")", "([)]", "(]", "[(()]", "(((" , ")(")] == [0, 0, 1, 1, 2, 2, 1, 3, 2]


def test_causes():
    js = "function f() {\n  return 1;\n}\n" * 20
    assert p.check(LANGS["javascript"], "javascript", js + "<<<<<<< HEAD\na();\n=======\nb();\n>>>>>>> x\n")[2] == "conflict"
    assert p.check(LANGS["javascript"], "javascript", js + "function g() {\n  if (a")[2] == "truncation"
    assert p.check(LANGS["javascript"], "javascript", js + "f(1;\n" + js)[2] == "local"
    assert p.check(LANGS["javascript"], "javascript", max(GOOD["python"], key=len))[2] == "mismatch"


def test_own_sources_parse():
    from pathlib import Path

    for f in Path(p.__file__).parent.rglob("*.py"):
        text = f.read_text()
        ast.parse(text)
        assert p.check(LANGS["python"], "python", text)[1] == 0, f
    assert p.check(LANGS["json"], "json", json.dumps({"a": [{"b": None}] * 50}))[1] == 0


def test_rows(spark):
    files = spark.createDataFrame(
        [(1, "r", "a.py", ".py", "x = 1\n", "z"), (2, "r", "b.PY", None, "x = (\n", "z"), (2, "r", "b.PY", None, "x = (\n", "z"), (3, "r", "c.md", ".md", "x = (", "z"), (4, None, "d.json", ".json", "", "z"), (5, "r", "e.py", ".py", None, "z"), (None, "r", "f.py", ".py", "(", "z"), (6, "r", None, None, "(", "z"), (7, "r", "g.js", ".js", "", "z")],
        "file_id long, root string, rel_path string, ext string, content string, lang string",
    )
    langs = spark.createDataFrame([(".py", "python", True), (".json", "json", True), (".md", "markdown", False), (".js", "javascript", True), (".zig", "zig", True)], "ext string, lang string, parse_checked boolean")
    got = p.parsed(files, langs)
    assert sorted((r.file_id, r.lang, r.edits > 0) for r in got.collect()) == [(1, "python", False), (2, "python", True), (4, "json", True), (7, "javascript", False)]
    assert {(r.root, r.lang, r.n_files, r.n_bad) for r in p.rates(got).collect()} == {("r", "python", 2, 1), (None, "json", 1, 1), ("r", "javascript", 1, 0)}
    assert p.parsed(files.limit(0), langs).count() == 0


LOOSE = ["1 = x\n", "f() = 1\n", "f(a=1, 2)\n", "def f(a=1, b):\n    pass\n"]
STRICT = ["x = 1\n", "\ufeffx = 1\r\n", "f(1, a=2)\n", "def f(a, b=1):\n    pass\n"]


def test_python_is_taken_only_as_its_parser_takes_it(spark):
    rows = [(i, ".py", t) for i, t in enumerate(LOOSE + STRICT)]
    files = spark.createDataFrame([(i, "r", f"a{i}.py", e, t) for i, e, t in rows], "file_id long, root string, rel_path string, ext string, content string")
    languages = spark.createDataFrame([(".py", "python", True)], "ext string, lang string, parse_checked boolean")
    got = {r.file_id: (r.edits, r.cause) for r in p.parsed(files, languages).collect()}
    assert got == {i: (1, "local") if i < len(LOOSE) else (0, None) for i in range(len(rows))}


def test_many_brackets_cost_no_more_than_they_have_to():
    js = LANGS["javascript"]
    for n in (60, 121, 400):
        assert p.check(js, "javascript", "function f(){" * n + "return 1;")[1:] == (n, "truncation")
    assert len(unpaired("(" * 300 + "[" + ")" * 300, {"(": ")", "[": "]"}, {")": "(", "]": "["})[0]) == 1


def test_stacks_leave_as_few_alone_as_spans():
    rnd = random.Random(2)
    pairs, closers = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
    for _ in range(300):
        kinds = [rnd.choice("([{)]}" if rnd.random() < 0.7 else "()") for _ in range(rnd.randint(0, min(40, SPANS)))]
        one, two = paired_spans(kinds, pairs), paired_stacks(kinds, pairs, closers)
        assert len(one) == len(two), kinds
        used = sorted([*two, *two.values()])
        assert len(set(used)) == 2 * len(two) and all(pairs[kinds[a]] == kinds[b] and a < b for a, b in two.items())
        assert not any(a < c < b < d for a, b in two.items() for c, d in two.items())


def test_causes_come_from_edits():
    js = LANGS["javascript"]
    conflict = "a();\n<<<<<<< HEAD\nb();\n=======\nc();\n>>>>>>> x\nd();\n"
    assert p.check(js, "javascript", conflict)[2] == "conflict"
    text = "const t = `\n=======\n`;\n" + "f(1);\n" * 30 + "x = ;\n" + "g(2);\n" * 30
    assert p.check(js, "javascript", text)[2] == "local"


def test_least_edits_are_no_more():
    rnd = random.Random(4)
    js = LANGS["javascript"]
    for _ in range(40):
        toks = [rnd.choice(["a", "=", "1", ";", "if", "return", "+", ",", "class", "const"]) for _ in range(rnd.randint(5, 25))]
        t = js.tokens(" ".join(toks))
        assert parse(js.grammar, t, least=True).cost <= parse(js.grammar, t).cost
