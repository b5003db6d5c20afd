import random
import re

import pytest
from tests.conftest import DATA

from quarrylight.llm import leakage, mixing, repetition

DOCS = "doc_id long, text string, source string, term int, pos int, wins string, tokens string"  # the last ones clash with inner names


def docs(spark, *texts, source="s"):
    return spark.createDataFrame([(i, t, source, 1, 2, "", "") for i, t in enumerate(texts)], DOCS)


# leakage --------------------------------------------------------------------------------------------------------------


def leaks_by_brute_force(texts, items, share=0.5):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in enumerate(texts):
        ws = words(t)
        grams = {tuple(ws[k : k + 6]) for k in range(len(ws) - 5)}
        for i, p in items:
            ps, hit = words(p), set()
            for k in range(len(ps) - 5):
                if tuple(ps[k : k + 6]) in grams:
                    hit |= set(range(k, k + 6))
            if len(ps) >= 6 and len(hit) >= share * len(ps):
                out.add((d, i))
    return out


@pytest.mark.parametrize("block", [10**6, 150])
def test_leaks_equal_brute_force(spark, block):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.randint(3, 25))) for i in range(30)] + [(90, None), (91, ""), (None, say(9)), (3, say(12))]
    texts = [say(40) for _ in range(60)]
    for k in range(0, 60, 3):
        p = items[rnd.randint(0, 29)][1].split()
        a = rnd.randint(0, len(p) // 2)
        texts[k] += "\n# " + ",\n// ".join(p[a : a + rnd.randint(4, 20)]).upper() + " " + say(5)
    texts += ["", None, texts[0], "x " * 50_000 + items[5][1]]
    df = spark.createDataFrame(items, "item_id long, passage string").selectExpr("*", "'z' as term", "1 as n_words")
    got = [(r.doc_id, r.item_id) for r in leakage.leaks(docs(spark, *texts), df, block=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == leaks_by_brute_force(texts, [x for x in items if x[0] is not None])


def test_kinds_and_items(spark):
    p = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(7, p)], "item_id long, passage string")
    found = leakage.leaks(docs(spark, "say: " + p.upper(), "one two three four five six, or seven eight nine ten eleven twelve", "one two three four five and six"), df)
    assert sorted((r.doc_id, r.kind, r.longest, r.share, r.span) for r in found.collect()) == [(0, "exact", 12, 1.0, 12), (1, "proximity", 6, 1.0, 13)]
    far = leakage.leaks(docs(spark, "one two three four five six " + "x " * 40 + "seven eight nine ten eleven twelve"), df).first()
    assert (far.kind, far.span) == ("scattered", 52)
    assert [tuple(r) for r in leakage.leaked_items(found).collect()] == [(7, 2, 1)]
    assert leakage.leaks(docs(spark).limit(0), df).count() == 0 and leakage.leaks(docs(spark, p), df.limit(0)).count() == 0


def test_the_index_holds_all_postings_and_serves_other_test_sets(spark):
    texts = ["b a b c " * 300, "a", "zz b"]
    d = docs(spark, *texts)
    made = leakage.index(d)
    n = {r.word: r.n for r in made.groupBy("word").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    h = leakage.Hashes()
    assert {w: n[h[w]] for w in ("a", "b", "c", "zz")} == {"a": 301, "b": 601, "c": 300, "zz": 1} and len(n) == 5
    for p in ("a b c b a b c", "b a b c b a b"):
        df = spark.createDataFrame([(1, p)], "item_id long, passage string")
        assert [(r.doc_id, r.item_id) for r in leakage.leaks(d, df, postings=made).collect()] == [(0, 1)]
    for gaps in ([3], [1, 300, 301], [70_000, 70_001]):
        assert leakage.unpacked(leakage.packed(__import__("numpy").array(gaps))).tolist() == gaps


# repetition -----------------------------------------------------------------------------------------------------------


def share_by_brute_force(text):
    ws, seen = re.findall(r"[^\W\d_]+", (text or "").lower()), set()
    said = [False] * len(ws)
    for i in range(len(ws) - 5):
        g = tuple(ws[i : i + 6])
        if g in seen:
            said[i : i + 6] = [True] * 6
        seen.add(g)
    return sum(said) / max(1, len(ws))


def samples():
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 6) for _ in range(n))
    for k in range(120):
        base = [say(rnd.randint(1, 30)) for _ in range(rnd.randint(1, 12))]
        lines = base + [rnd.choice(base) for _ in range(rnd.randint(0, 14))]
        rnd.shuffle(lines)
        yield rnd.choice([" ", "\n", ".\r\n", "\n\n"]).join(lines)


def test_shares_equal_brute_force(spark):
    texts = [*samples(), "", None, "a " * 7, "a", "A1a2A3 a, a a a\na"]
    field = repetition.train(docs(spark, *texts))
    got = {r.doc_id: r for r in repetition.repetition(docs(spark, *texts), field, content=1.0).collect()}
    for i, t in enumerate(texts):
        assert got[i].repeated_share == pytest.approx(share_by_brute_force(t)), t
    want = {i for i, t in enumerate(texts) if share_by_brute_force(t) >= 0.45}
    assert {r.doc_id for r in repetition.repetitive(docs(spark, *texts)).collect()} == want and len(want) > 10


def test_field_finds_all_repetitive_documents_of_the_test_data(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id for r in d.collect() if share_by_brute_force(r.text) >= 0.45}
    assert {r.doc_id for r in repetition.repetitive(d).collect()} == want


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    f = repetition.Field()
    rnd = np.random.default_rng(0)
    f.w, f.t = rnd.normal(size=len(f.w)), rnd.normal(size=(2, 2))
    doc, code = np.array([0, 0, 0, 0, 1, 1, 2]), rnd.integers(0, np.prod(repetition.SHAPES), 7)
    e = f.emission(code)
    got = f.decode(doc, code)
    for d in range(3):
        i = np.flatnonzero(doc == d)
        score = lambda y, i=i: sum(e[k] * b for k, b in zip(i, y, strict=True)) + sum(f.t[a, b] for a, b in itertools.pairwise(y))
        assert score(tuple(got[i])) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=len(i))))


def test_empty_tables(spark):
    assert repetition.repetition(docs(spark, "x").limit(0)).count() == 0


# mixing ---------------------------------------------------------------------------------------------------------------


def test_water_filling():
    got = mixing.fill({"a": 100, "b": 10, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}, {"a": 1, "b": 2, "c": 1, "d": 1}, 300)
    assert got == {"a": 100, "b": 20, "c": pytest.approx(180), "d": 0}
    assert mixing.fill({"a": 5}, {"a": 1.0}, {"a": 2}, 100) == {"a": 10}
    assert mixing.fill({}, {"a": 1.0}, {"a": 2}, 100) == {"a": 0}


def test_mixture_meets_shares_and_caps(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("word" for _ in range(rnd.randint(1, 40))), rnd.choice(["A_b ", "a-b", "c"] if i % 3 else ["c", None, "zz"])) for i in range(3000)] + [(9001, "", "c"), (9002, None, "c"), (None, "x", "c"), (5, "again one two", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "2 as repeats", "3 as _bin")
    targets = spark.createDataFrame([("a-b", 0.7, 3), ("c", 0.2, 1), ("none-such", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    sized = mixing.sized_once(d)
    plan = mixing.plan(spark, sized, targets)
    mixed = mixing.mixture(spark, sized, plan)
    out = {r.source: r for r in mixing.report(mixed, plan).collect()}
    assert out["a-b"].actual_share == pytest.approx(7 / 9, abs=0.01) and out["c"].actual_share == pytest.approx(2 / 9, abs=0.01)
    assert out["none-such"].used_tokens == 0 and out["a-b"].most_repeats <= 3 and out["c"].most_repeats == 1
    assert {(r.source, r.within_cap, r.as_planned) for r in mixing.checks(mixed, plan).collect()} == {(s, True, True) for s in ("a-b", "c", "none-such")}
    again = mixing.mixture(spark, sized, plan)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    other = mixing.mixture(spark, sized, plan, seed=1)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, mixed.collect()))


def test_empty_mixture(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    sized = mixing.sized_once(none)
    plan = mixing.plan(spark, sized, targets)
    assert mixing.mixture(spark, sized, plan).count() == 0
    assert [tuple(r) for r in mixing.report(mixing.mixture(spark, sized, plan), plan).collect()] == [("a", 1.0, 0.0, 0, 0, 1, 0)]
    assert mixing.report(mixing.mixture(spark, sized, mixing.plan(spark, sized, targets.limit(0))), mixing.plan(spark, sized, targets.limit(0))).count() == 0


def test_the_field_decides(spark):
    texts = [*samples(), "", None, "a " * 7]
    blind = repetition.Field()
    blind.w[:] = -9.0  # all lines are content
    assert repetition.repetitive(docs(spark, *texts), field=blind).count() == 0
    seen = repetition.repetition(docs(spark, *texts)).collect()
    assert all((r.repeated_share is None) == (r.content_share > repetition.CONTENT) for r in seen)


def test_field_finds_repetition_of_held_out_texts():
    texts = list(samples())
    some = repetition.Batch(texts[:60])
    doc, _, code = some.lines()
    field = repetition.Field().fit(doc, code, some.weak())
    rest = repetition.Batch(texts[60:])
    doc, size, code = rest.lines()
    y = field.decode(doc, code)
    want = [share_by_brute_force(t) >= repetition.SHARE for t in texts[60:]]
    for k, t in enumerate(texts[60:]):
        content = 1 - (size * y)[doc == k].sum() / size[doc == k].sum()
        assert content <= repetition.CONTENT or not want[k], t
    assert (y == rest.weak()).mean() > 0.9
