import pytest
from pyspark.sql import functions as F
from tests.conftest import rows

from quarrylight.operators import manifest, search, symbols
from quarrylight.operators.filters import FilterError, clauses, compile_filter, search_filter
from quarrylight.sources.store import ChunkStore, ModeMismatch, NoCollection

CHUNKS = [
    ("a", "the lazy token handler", "src/a.go", 1, 9, "go", "{}"),
    ("b", "token token", "src1/b.go", 10, 30, "go", "{}"),
    ("c", "nothing here", "src/c_%.ts", 5, 6, "ts", None),
    ("d", None, "OWNERS", 1, 1, "", None),
]
SCHEMA = "id string, content string, rel_path string, start_line int, end_line int, ext string, metadata string"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ('relativePath == "src/a.go"', "a"),
        ('fileExtension in ["go", "ts"]', "abc"),
        ('relativePath like "src/%"', "ac"),
        ('relativePath like "src/c_%"', "c"),
        ("startLine >= 5 and endLine == 30", "b"),
        ('id in []', ""),
        (' ', "abcd"),
    ],
)
def test_filters(chunks, text, ids):
    p = compile_filter(text)
    assert "".join(sorted(r.id for r in (chunks if p is None else chunks.where(p)).collect())) == ids


@pytest.mark.parametrize("text", ["nope == 1", 'startLine == "x"', "fileExtension in go", 'relativePath like "a"', 'a or b', 'relativePath == "a" or id == "b"'])
def test_filters_that_are_none(text):
    with pytest.raises(FilterError):
        clauses(text)


def test_filters_reach_the_scan(spark):
    import __spark_entry__ as entry

    plans = {n: entry.queries()[n](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for n in ("filter_prefix", "filter_in", "filter_numeric", "filter_and", "chunk_counts")}
    assert "StringStartsWith(rel_path,core/)" in plans["filter_prefix"] and "In(ext, [py,ts])" in plans["filter_in"]
    assert "GreaterThanOrEqual(start_line,40)" in plans["filter_numeric"] and "StringStartsWith(rel_path,lib/)" in plans["filter_and"]
    assert all("content" not in p for p in plans.values())


def test_index_and_texts_give_the_same_scores(spark, tmp_path):
    s = ChunkStore(spark, f"file://{tmp_path}/store")
    s.create("c", 2)
    rows_in = spark.createDataFrame([(f"i{k}", t, f"d{k % 2}/f.py", 1, 2, "py", "{}", [1.0, float(k)]) for k, t in enumerate(["lazy token", "token token handler", "", "other words here", "handler lazy lazy"])], SCHEMA + ", embedding array<float>")
    s.upsert("c", rows_in)
    words = search.query_terms("lazy token handler")
    about = lambda: s.read("c").select("id", "n_terms", "rel_path")
    score = lambda df: {r.id: r.score for r in df.collect()}
    assert score(search.bm25_indexed(s.postings("c", words), about(), "lazy token handler")) == score(search.bm25(s.read("c"), "lazy token handler"))
    s.delete("c", 'id in ["i0"]')  # its postings find no chunk
    for k in range(3):
        s.upsert("c", rows_in.where(f"id = 'i{k + 1}'"))
    assert score(search.bm25_indexed(s.postings("c", words), about(), "lazy token handler")) == score(search.bm25(s.read("c"), "lazy token handler"))
    assert set(score(search.bm25_indexed(s.postings("c", words), about(), "lazy token handler", 5, F.col("rel_path").startswith("d0/")))) == {"i4"}
    with pytest.raises(Exception, match="dimensions"):
        s.upsert("c", rows_in.withColumn("embedding", F.array(F.lit(1.0))))


def test_rerank_failures_and_queries(spark, chunks):
    hits = chunks.select("id", "content", "rel_path", F.ascii("id").cast("double").alias("rrf_score"))
    order = lambda df: [r.id for r in df.orderBy("rank").collect()]
    assert order(search.rerank(hits, lambda q, t: F.length(t), "q")) == ["a", "c", "b", "d"]
    with pytest.warns(UserWarning, match="scorer failed"):
        assert order(search.rerank(hits, lambda q, t: F.raise_error(F.lit("down")), "q")) == ["d", "c", "b", "a"]
    assert "rerank_score" not in search.rerank(hits.limit(1), lambda q, t: F.length(t), "q").columns
    assert [search.rerank_query(*x) for x in ((" p ", "s", "d"), (None, "s", "d"), ("", " ", "d"), ())] == ["p", "s", "d", ""]


def test_deleting_needs_a_filter():
    with pytest.raises(FilterError):
        compile_filter("", deleting=True)
    with pytest.raises(FilterError):
        compile_filter('id in ["a"] and startLine > 1', deleting=True)


def test_filter_text():
    assert search_filter("/r", "/r/a b", [".go", "", "TS"]) == 'relativePath like "a b/%" and fileExtension in ["go", "TS"]'
    assert search_filter("/r/", "/r", []) == ""
    with pytest.raises(FilterError):
        search_filter("/r", "/r2", [])


def test_bm25_and_fusion(chunks):
    got = search.bm25(chunks, "The token, handler? x", 5).collect()
    assert [r.id for r in got] == ["a", "b"] and [r["rank"] for r in got] == [1, 2]
    assert search.bm25(chunks, "? x", 5).count() == 0
    fused = rows(search.rrf([search.bm25(chunks, "token handler", 5)]))
    assert fused == [("a", round(1 / 61, 9)), ("b", round(1 / 62, 9))]


def test_dense_checks_dimensions(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "id string, embedding array<float>")
    assert [r.id for r in search.dense_topk(v, [1.0, 0.0], 2).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="dimensions"):
        search.dense_topk(v, [1.0, 0.0, 0.0], 2).collect()
    for bad in (0, -1, 1.5, float("nan"), True):
        with pytest.raises(ValueError):
            search.positive("k", bad)


def test_auxiliary_files_come_last_before_the_cut(chunks):
    hits = chunks.select("id", "rel_path", F.when(F.col("id") == "d", 9).otherwise(F.ascii("id")).alias("o"))
    assert [r.id for r in search.demote_auxiliary(hits, 3, [F.col("o")]).orderBy("rank").collect()] == ["a", "b", "c"]


def test_symbols_and_the_one_around():
    src = "package a\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) M() {\n\tif true {\n\t}\n}\n\nfunc F() { return }\n"
    assert symbols.symbols_of(src, ".go") == [("T", "type", 3, 5), ("M", "method", 7, 10), ("F", "function", 12, 12)]
    assert symbols.symbols_of("class A:\n    def m(self):\n        pass\n", "py") == [("A", "class", 1, 3), ("m", "method", 2, 3)]
    assert symbols.symbols_of("def (", "py") == [] and symbols.symbols_of("x", "unknown") == []


def test_enclosing(spark):
    s = spark.createDataFrame([("f", "outer", "class", 1, 50), ("f", "inner", "method", 5, 20), ("f", "later", "method", 30, 34)], "rel_path string, name string, kind string, start_line int, end_line int")
    h = spark.createDataFrame([("1", "f", 6, 9), ("2", "f", 18, 60), ("3", "f", 31, 90), ("4", "g", 1, 2)], "id string, rel_path string, start_line int, end_line int")
    assert {r.id: r.symbol for r in search.enclosing_symbols(h, s).collect()} == {"1": "inner", "2": "outer", "3": None, "4": None}


def test_manifest_rules(spark):
    m = "rel_path string, hash string, chunk_count int, size long, mtime_ns long"
    old = spark.createDataFrame([("same", "1", 2, 1, 1), ("touched", "1", 2, 1, 1), ("mod", "1", 3, 1, 1), ("gone", "1", 4, 1, 1), ("unread", "1", 1, 1, 1)], m)
    new = spark.createDataFrame([("same", "x", 0, 1, 1), ("touched", "1", 0, 1, 2), ("mod", "2", 1, 1, 2), ("new", "1", 1, 1, 1), ("unread", None, 0, 2, 2), ("unread2", None, 0, 2, 2)], m)
    d = manifest.diff(new, old)
    assert rows(d) == [("gone", "Deleted"), ("mod", "Modified"), ("new", "Added")]
    assert manifest.removed_chunks(old, d).first()[0] == 7
    assert sorted(r.rel_path for r in manifest.files_to_process(new, d).collect()) == ["mod", "new"]
    assert sorted(r.rel_path for r in manifest.needs_hash(new, old).collect()) == ["mod", "new", "touched", "unread", "unread2"]


def test_store(spark, tmp_path, chunks):
    s = ChunkStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(NoCollection):
        s.read("c")
    s.create("c", 64)
    s.create("c", 64)
    with pytest.raises(ModeMismatch):
        s.create("c", 32)
    s.upsert("c", chunks)
    s.upsert("c", chunks.where("id = 'a'").withColumn("content", F.lit("new")))
    assert s.read("c").count() == 4 and s.query("c", 'id in ["a"]').first().content == "new"
    s.delete("c", 'fileExtension == "ts"')
    s.replace_files("c", spark.createDataFrame([("src/a.go",)], "rel_path string"), chunks.where("id = 'a'").withColumn("id", F.lit("a2")))
    assert sorted(r.id for r in s.read("c").collect()) == ["a2", "b", "d"]
    s.vacuum("c")
    assert s.read("c").count() == 3 and s.collections() == ["c"]
    s.drop("c")
    s.drop("c")
    assert not s.exists("c")
