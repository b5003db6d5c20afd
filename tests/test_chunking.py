import random

import pytest
from tests.conftest import rows

from quarrylight.operators import chunking as c


def merged(parts):
    out = parts[0]
    for p in parts[1:]:
        k = next(k for k in range(min(len(out), len(p)), -1, -1) if out.endswith(p[:k]))
        out += p[k:]
    return out


def test_lines():
    assert c.lines_of("") == []
    assert c.lines_of("hello\r\nworld\r\n") == ["hello\r\n", "world\r\n", ""]
    assert c.lines_of("a\n\nb") == ["a\n", "\n", "b"]


def test_windows_over_a_long_line():
    assert c.windows("abcdef", 3, 2, 2) == [(x, 3, 3) for x in ("ab", "bc", "cd", "de", "ef")]
    assert c.windows("", 7, 5, 2) == []


def test_text_chunks_cover_the_text_in_order():
    rnd = random.Random(3)
    for _ in range(60):
        text = "".join(f"{i}:" + "x" * rnd.randint(0, 30) + "\n" for i in range(rnd.randint(1, 40)))
        got = c.text_chunks(text, 60, 15)
        assert merged([t for t, *_ in got]) == text
        assert all(len(t) <= 60 for t, *_ in got) and got[0][1] == 1 and got[-1][2] == text.count("\n") + 1
        assert all(a[1] < b[1] <= a[2] + 1 for a, b in zip(got, got[1:], strict=False))


def test_blank_and_small_texts():
    assert c.text_chunks(" \n\t\n") == []
    assert c.text_chunks("a\n") == [("a\n", 1, 2)]
    assert c.code_chunks(" \n", "go") == [(" \n", 1, 2)]
    assert c.limits(0, 0) == (4000, 500) and c.limits(100, 90) == (100, 50)


def test_code_chunks_keep_declarations_whole():
    text = "package a\n\nimport \"fmt\"\n\n" + "".join(f"// F{i} says so.\nfunc F{i}() {{\n\tfmt.Println({i})\n}}\n\n" for i in range(8))
    got = c.code_chunks(text, ".go", 120, 20)
    assert "".join(t for t, *_ in got) == text
    assert all(t.count("func ") == t.count("}\n") for t, *_ in got)
    assert all(t.startswith("//") for t, *_ in got[1:])
    py = "import os\n\n" + "".join(f"@mark\ndef f{i}():\n    return {i}\n\n\n" for i in range(8))
    assert all(t.lstrip().startswith("@mark") for t, *_ in c.code_chunks(py, "py", 80, 20)[1:])
    assert c.code_chunks("def f(:\n" * 40, "py", 80, 20) == c.text_chunks("def f(:\n" * 40, 80, 20)


def test_payload_limit():
    numbers = [f"{i:05d}" for i in range(6_000)]
    for text in ("".join(numbers), "".join(f"é<&>{i}\n" for i in numbers), "func A() {\n" + "".join(f"\tb{i}()\n" for i in numbers) + "}\n"):
        parts = c.within_payload("a/b.go", "go", "/r", (text, 5, 5 + text.count("\n")))
        assert len(parts) > 1 and all(c.payload_bytes("a/b.go", "go", "/r", p) <= c.PAYLOAD for p in parts)
        assert parts[0][1] == 5 and merged([p[0] for p in parts]) == text


def test_stored_chunks(spark):
    f = spark.createDataFrame([("a.go", ".go", "package a\n", 1), ("n.go", None, None, 2), (None, ".go", "x", 3), ("e.md", ".md", "", 4)], "rel_path string, ext string, content string, ordinal int")
    got = c.build_chunks(f, "/r").collect()
    assert [(r.rel_path, r.start_line, r.end_line, r.ext, r.metadata) for r in got] == [("a.go", 1, 2, "go", '{"codebasePath":"/r"}')]
    assert got[0].id.startswith("chunk_") and len(got[0].id) == 22


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "ab"), (3, ""), (4, None)], "i int, content string")
    assert rows(c.fixed_windows(df, 4, 1)) == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (2, 0, "ab")]


PARTS = {
    "rb": ("require 'x'\n\nclass A\n  def m\n    1\n  end\nend\n\ndef f\n  2\nend\n", [(0, False), (2, True), (8, True)]),
    "lua": ("local x = 1\nlocal function f()\n  return 1\nend\nfunction M.g()\nend\n", [(0, False), (1, True), (4, True)]),
    "ml": ("open List\nlet f x =\n  x + 1\ntype t =\n  | A\n", [(0, False), (1, True), (3, True)]),
    "tf": ('resource "a" "b" {\n  x = 1\n}\nvariable "c" {\n}\n', [(0, True), (3, True)]),
    "toml": ('a = 1\n[t]\nb = 2\n[[u]]\nc = [\n 1\n]\n', [(0, False), (1, True), (3, True)]),
    "json": ('{\n  "a": 1,\n  "b": {\n    "c": [1,\n 2]\n  },\n  "d": 2\n}\n', [(1, True), (2, True), (6, True)]),
    "yaml": ("a: 1\nb:\n  c: 2\n# no\n- x\n", [(0, True), (1, True), (3, False), (4, True)]),
    "html": ("<html>\n<head>\n<meta x>\n</head>\n<body>\n<p>a</p>\n</body>\n</html>\n", [(1, True), (4, True)]),
    "xml": ("<?xml version='1.0'?>\n<r>\n <a/>\n <b>\n  <c/>\n </b>\n</r>\n", [(2, True), (3, True)]),
    "svelte": ("<script>\nlet a = '<b>';\n</script>\n<h1>x</h1>\n<style>\n</style>\n", [(0, True), (3, True), (4, True)]),
    "sh": ("set -e\nf() {\n  x\n}\nif a; then\n  b\nfi\n", [(0, False), (1, True), (4, False)]),
    "dockerfile": ("FROM a AS b\nRUN x \\\n  && y\nFROM c\n", [(0, True), (1, False), (3, True)]),
    "mk": ("A := 1\nall: b\n\tcc\nb:\n\tdd\n", [(0, False), (1, True), (3, True)]),
}


@pytest.mark.parametrize("ext", PARTS)
def test_parts_of_other_languages(ext):
    text, want = PARTS[ext]
    assert c.unit_starts(text, ext) == want
    for size in (10, 30, 60):
        got = c.code_chunks(text, ext, size, 1)
        lines = text.split("\n")
        assert got and all(t.rstrip("\n").split("\n")[0] in lines[s - 1] for t, s, e in got)
        assert {k for _, s, e in got for k in range(s, e + 1)} >= {i + 1 for i, x in enumerate(lines) if x}


def test_markup_that_does_not_nest_has_no_parts():
    assert c.unit_starts("<a><b></a>", "xml") is None
    assert c.unit_starts('{"a": [', "json") is None


def test_languages_by_extension_and_content(spark):
    from pyspark.sql import functions as F

    from quarrylight.functions import languages as la

    assert len(la.LANGUAGES) == 36 and la.BY_EXT[".tofu"] == "hcl"
    rows = [(".GO", "x"), (".x", "#!/usr/bin/env -S python3\n1"), (".x", "a\n# vim: set ts=4 ft=ruby:\n"), ("", "// -*- mode: c++; tab: 2 -*-\n"), (".x", "-*- lua -*-"), (".x", "nothing"), (None, None), (".x", "\n" * 9 + "# vim: ft=go" + "\n" * 9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ext string, content string")
    got = [r.l for r in df.select("i", la.language(F.col("ext"), F.col("content")).alias("l")).orderBy("i").collect()]
    assert got == ["go", "python", "ruby", "cpp", "lua", None, None, None]
    assert [r.e for r in df.select("i", la.read_as(F.col("ext"), F.col("content")).alias("e")).orderBy("i").collect()][:3] == [".GO", ".py", ".rb"]


def test_grouped_declarations_of_go():
    from quarrylight.operators import symbols

    src = "package a\n\nvar (\n\tone = 1\n\ttwo, three int\n)\n\ntype (\n\tT struct {\n\t\tx int\n\t}\n\tU = T\n)\n\nvar four = 4\n"
    assert symbols.symbols_of(src, "go") == [("one", "variable", 4, 4), ("two", "variable", 5, 5), ("T", "type", 9, 11), ("U", "type", 12, 12), ("four", "variable", 15, 15)]
    assert symbols.merge_symbols([("a", "type", 1, 5)], [("a", "type", 5, 6), ("a", "variable", 5, 6), ("a", "type", 6, 7), (" ", "type", 9, 9)]) == [("a", "type", 1, 5), ("a", "variable", 5, 6), ("a", "type", 6, 7)]
