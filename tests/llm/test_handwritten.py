import numpy as np

from quarrylight.llm import handwritten as h

FILES = "file_id long, root string, rel_path string, ext string, content string, reason string, shared int, rule long"
GETTERS = "package a\n\n" + "".join(f"func (x *T) GetName{i}() int64 {{\n\tif x != nil {{\n\t\treturn x.Name{i}\n\t}}\n\treturn 0\n}}\n\n" for i in range(12))
HAND = "package a\n\nimport \"fmt\"\n\n// This module is written by hand, not generated.\nfunc Add(a, b int) int {\n\treturn a + b\n}\n\nfunc Show(s string) {\n\tfmt.Println(s)\n}\n"
TABLE = "var names = map[string]string{\n" + "".join(f'\t"key.{i}": "some words of message {i}",\n' for i in range(150)) + "}\n"
NUMBERS = "static const unsigned t[] = {\n" + "".join(f"    {i * 7919 % 65536}, {i * 104729 % 65536},\n" for i in range(1, 200)) + "};\n"
MINIFIED = "!function(e,t){" + "".join(f"for(var a=0;a<{i};a++)e[a]^={i};" for i in range(300)) + "}(window,document);"
SQL = "".join(f"INSERT INTO t VALUES ({i},'Kx{i}a9Z{i}q',{i * 7919});\n" for i in range(120))


def reason(spark, *files):
    df = spark.createDataFrame([(i, *f, "x", 1, 2) for i, f in enumerate(files)], FILES)
    return [r.reason for r in h.judged(df).orderBy("file_id").collect()]


def test_reasons(spark):
    got = reason(
        spark,
        ("r", "a/x.go", ".go", GETTERS),
        ("r", "a/y.go", None, HAND),
        ("r", "a/t.go", ".go", TABLE),
        ("r", "a/n.c", ".c", NUMBERS),
        ("r", "a/m.js", ".js", MINIFIED),
        ("r", "a/d.sql", ".sql", SQL),
        ("r", "package-lock.json", ".json", "{}"),
        ("r", "a/node_modules/b/c.go", ".go", HAND),
        ("r", "a/vendors/c.go", ".go", HAND),
        ("r", "a/thirdparty_billing/c.go", ".go", HAND),
        ("r", "a/g.go", ".go", "// Code generated by x. DO NOT EDIT.\n" + HAND),
        ("r", "a/gen.go", ".go", HAND + "const head = `// Code generated by x. DO NOT EDIT.`\n"),
        ("r", "a/c.go", ".go", "// Copyright 2025 Own. All rights reserved.\n" + HAND),
        ("r", "a/l.go", ".go", "// This file is part of the zip library, version 1.2.\n" + HAND),
        ("r", "a/o.js", ".js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n'),
    )
    assert got == ["generated", None, None, "data", "minified", "data", "lock file", "third party", None, None, "declared generated", None, None, "third party", "compiled"]


def test_copies_shared_by_repositories(spark):
    body = "".join(f"func F{chr(97 + i)}(v int) int {{\n\tif v > {i} {{\n\t\treturn v * {i} + lookup(v, \"{chr(97 + i)}\")\n\t}}\n\treturn helper.Call(v)\n}}\n" for i in range(3))
    twice = body + body.replace("package", "")
    assert reason(spark, ("r1", "a.go", ".go", twice), ("r2", "b.go", ".go", twice), ("r1", "c.go", ".go", HAND)) == ["shared by repositories"] * 2 + [None]
    assert reason(spark, ("r1", "a.go", ".go", twice), ("r1", "b.go", ".go", twice)) == [None, None]


def expand(sym, size, table):
    return sum(size)


def test_repair_keeps_lengths_and_compresses_repeats():
    rnd = np.random.default_rng(1)
    for _ in range(20):
        a = rnd.integers(1, 5, rnd.integers(1, 300)) * 2 + 1
        doc = np.sort(rnd.integers(0, 3, len(a)))
        sym, where, size = h.repair(a.astype(np.int64), doc)
        assert (np.bincount(where, weights=size, minlength=3) == np.bincount(doc, minlength=3)).all()
        for d in range(3):  # no pair of symbols is left twice without overlapping
            s = sym[where == d].tolist()
            seen = {}
            for i, p in enumerate(zip(s, s[1:], strict=False)):
                assert p not in seen or i - seen[p] < 2
                seen.setdefault(p, i)
    unique = -np.ones(50, dtype=np.int64)
    assert len(h.repair(unique, np.zeros(50, dtype=int))[0]) == 50


def test_same_rules_in_other_batches():
    a = np.array([3, 5, 7, 9] * 20, dtype=np.int64)
    one = h.repair(a, np.zeros(80, dtype=int))[0]
    two = h.repair(np.r_[np.array([11, 13], dtype=np.int64), a], np.r_[[0, 0], np.ones(80, dtype=int)])
    assert set(one) <= set(two[0])


def test_nulls_empty_and_repeats(spark):
    df = spark.createDataFrame([(1, None, None, None, GETTERS, "", 1, 1), (1, None, None, None, GETTERS, "", 1, 1), (2, "r", "a.go", ".go", None, "", 1, 1), (3, "r", "a.go", ".go", "", "", 1, 1), (None, "r", "a.go", ".go", GETTERS, "", 1, 1)], FILES)
    assert [(r.file_id, r.reason) for r in h.judged(df).collect()] == [(1, "generated")]
    assert h.judged(spark.createDataFrame([], FILES)).count() == 0


def lone(seed: int, n: int = 120) -> str:
    """A body of which no stretch of two tokens comes twice, with a literal no rule can hold."""
    rnd = np.random.default_rng(seed)
    return "".join(f"w{''.join(map(chr, rnd.integers(97, 123, 9)))} " for _ in range(n)) + f'"{seed}aB3xZ9qL0pK"\n'


def test_copies_that_repeat_nothing_within_themselves(spark):
    body = lone(1)
    assert reason(spark, ("r1", "a.go", ".go", body), ("r2", "b.go", ".go", body), ("r2", "c.go", ".go", lone(2))) == ["shared by repositories"] * 2 + [None]
    assert reason(spark, ("r1", "a.go", ".go", body), ("r1", "b.go", ".go", body)) == [None, None]
    changed = lone(3, 20) + lone(1, 900) + lone(4, 20)
    assert reason(spark, ("r1", "a.go", ".go", changed), ("r2", "b.go", ".go", lone(1, 900))) == ["shared by repositories"] * 2
    assert reason(spark, ("r1", "a.go", ".go", body + lone(5, 900)), ("r2", "b.go", ".go", body + lone(6, 900))) == [None, None]


def test_literals_of_one_length_are_no_copies(spark):
    one, two = ("".join(f'"{a}{i}aB3xZ9qL0pK{i}"\n' for i in range(10, 50)) for a in "ab")
    assert reason(spark, ("r1", "a.go", ".go", one), ("r2", "b.go", ".go", two)) == [None, None]


def test_blocks_make_up_files_and_move_with_their_content():
    rnd = np.random.default_rng(3)
    sizes = [0, 5, h.LONG - 1, h.LONG, 70, 500, 3_000]
    a = rnd.integers(1, 1 << 40, sum(sizes))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rule, where, size = h.blocks(a, doc)
    assert (size >= h.LONG).all()
    assert np.bincount(where, weights=size, minlength=len(sizes)).tolist() == [n if n >= h.LONG else 0 for n in sizes]
    assert len(rule) > 25 and len(set(rule.tolist())) == len(rule)
    moved = h.blocks(np.r_[rnd.integers(1, 1 << 40, 17), a[doc == 6]], np.zeros(3_017, dtype=np.int64))[0]
    assert len(set(moved.tolist()) & set(rule[where == 6].tolist())) >= (where == 6).sum() - 1
    assert [len(x) for x in h.blocks(a[:0], doc[:0])] == [0, 0, 0]
