"""Search over chunks: dense and sparse legs, rank fusion, reranking, demotion of auxiliary files, enclosing symbols.

Each leg is a plan of its own that ends in a top-k; only ids and scores are ranked, texts are joined to the hits at the end.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions.code import is_auxiliary, query_terms, terms
from quarrylight.session import materialise

RRF_K = 60
DENSE_MAX, LIMIT_DEFAULT, LIMIT_MAX = 100, 10, 20
BM25_K1, BM25_B = 1.2, 0.75


def search_limit(limit: float | None) -> int:
    return min(max(int(limit or LIMIT_DEFAULT), 1), LIMIT_MAX)


def positive(name: str, n: float) -> int:
    if isinstance(n, bool) or n != n or n in (float("inf"), float("-inf")) or n <= 0 or int(n) != n:
        raise ValueError(f"{name} has to be a positive whole number")
    return int(n)


def rerank_pool(limit: int) -> int:
    return min(max(5 * limit, 20), 100)


def sparse_pool(limit: int) -> int:
    return min(max(3 * limit, 20), 50)


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine of an array column and a fixed vector, without leaving the JVM."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    length = sum(float(x) ** 2 for x in query) ** 0.5
    return F.when(norm > 0, dot / (norm * F.lit(length)))


def dense_topk(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``id, score, rank`` of the ``k`` vectors nearest to ``query``; vectors of another length are an error."""
    k = min(positive("k", k), DENSE_MAX)
    rows = vectors if keep is None else vectors.where(keep)
    size = F.size(vec_col)
    checked = F.when(size == len(query), F.col(vec_col)).otherwise(F.raise_error(F.concat(F.lit(f"vectors of {len(query)} dimensions are expected, found "), size.cast("string"))))
    top = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.round(cosine(checked, query), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return ranked(top)


def ranked(top: DataFrame) -> DataFrame:
    """Rank from 1 by score and id; for top-k lists only, whose size is bounded."""
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def _equals(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def bm25(chunks: DataFrame, text: str, k: int | None = None, keep: Column | None = None, id_col: str = "id", text_col: str = "content", repeated: bool = False) -> DataFrame:
    """``id, score[, rank]`` by BM25 of the terms of ``text``; ``repeated``: rows of one id may be there more than once.

    The corpus statistics are of all chunks that pass the filter. One pass cuts every text down to the query's terms, observes the
    statistics and writes the hits; texts are neither shuffled nor read again.
    """
    words = query_terms(text)
    rows = chunks if keep is None else chunks.where(keep)
    docs = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("_t"))
    if not words:
        return docs.select("id", F.lit(0.0).alias("score"), *([F.lit(0).alias("rank")] if k is not None else [])).limit(0)
    asked = docs.select("id", F.size("_t").alias("_dl"), F.filter("_t", lambda x: x.isin(*words)).alias("_q"))
    per = asked.select("id", "_dl", *(F.size(F.filter("_q", _equals(w))).alias(f"_tf{i}") for i, w in enumerate(words)))
    if repeated:  # counts are compared, not texts
        per = per.dropDuplicates(["id"])
    seen = Observation()
    counted = per.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("_dl").alias("length"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(words))))
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"_tf{i}") > 0)
    found = materialise(counted.where(hit), "bm25-hits")
    stats = seen.get
    return _bm25_scored(found, stats["n"], stats["length"], [stats[f"df{i}"] for i in range(len(words))], k)


def _bm25_scored(found: DataFrame, n: int, length: int | None, df: list[int], k: int | None) -> DataFrame:
    """Scores of ``id, _dl, _tf0, _tf1 ...`` by the statistics of the corpus."""
    mean, score = (length or 0) / n if n else 1.0, F.lit(0.0)
    for i, d in enumerate(df):
        t = F.col(f"_tf{i}")
        score = score + F.lit(math.log(1 + (n - d + 0.5) / (d + 0.5))) * t * (BM25_K1 + 1) / (t + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_dl") / F.lit(mean or 1.0)))
    scored = found.select("id", F.round(score, 6).alias("score"))
    return scored if k is None else ranked(scored.orderBy(F.desc("score"), "id").limit(positive("k", k)))


def bm25_indexed(postings: DataFrame, chunks: DataFrame, text: str, k: int | None = None, keep: Column | None = None) -> DataFrame:
    """The same from an index: ``postings`` are ``term, id, tf`` of the terms of ``text``, ``chunks`` has ``id, n_terms``.

    No text is read. The corpus statistics are of all chunks; the filter takes out hits.
    """
    words = query_terms(text)
    counts = [F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, w in enumerate(words)]
    live = postings.groupBy("id").agg(*counts or [F.lit(0).alias("_tf0")]).join(chunks.withColumnRenamed("n_terms", "_dl"), "id")
    whole = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("length")).first()
    df = live.agg(F.count(F.lit(1)), *(F.count_if(F.col(f"_tf{i}") > 0) for i in range(len(words)))).first()[1:]
    return _bm25_scored(live if keep is None else live.where(keep), whole.n, whole.length, list(df), k)


def rrf(legs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """``id, rrf_score``: reciprocal ranks summed over the legs."""
    out = legs[0].select("id", "rank")
    for leg in legs[1:]:
        out = out.unionByName(leg.select("id", "rank"))
    return out.groupBy("id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("rrf_score"))


def hydrate(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Hits with those of ``columns`` that chunks have; missing values become empty ones."""
    have = [c for c in columns if c in chunks.columns and c != "id"]
    types = dict(chunks.dtypes)
    filled = [F.coalesce(F.col(c), F.lit("{}" if c == "metadata" else "")).alias(c) if types[c] == "string" else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in have]
    rows = chunks.join(F.broadcast(hits.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"]).select("id", *filled)  # hits: a top-k
    return hits.join(rows, "id", "left")


def demote_auxiliary(hits: DataFrame, limit: int, order: list[Column], path: str = "rel_path") -> DataFrame:
    """First the files that matter, then auxiliary ones, each in the order they had; cut to ``limit`` after that."""
    w = W.orderBy(F.col("_aux"), *order)
    return hits.withColumn("_aux", F.coalesce(is_auxiliary(F.col(path)), F.lit(False))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("_aux")


def rerank_query(params: str | None = None, sparse: str | None = None, dense: str | None = None) -> str:
    """The text to rerank by: the one asked for, else that of the sparse leg, else that of the dense one."""
    return next((t.strip() for t in (params, sparse, dense) if t and t.strip()), "")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None, query: str, text: str = "content") -> DataFrame:
    """Hits with ``rank`` by a pluggable scorer, unscored ones last, ties as before.

    The order stays as it is without a scorer, for a blank query, for fewer than two hits, and where the scorer fails. ``hits`` is a
    pool of bounded size: it is read once to find that out. A hit's text is its content, else its path, else all of it as JSON.
    """
    before = [F.desc("rrf_score"), F.col("id")]
    plain = hits.withColumn("rank", F.row_number().over(W.orderBy(*before)))
    if scorer is None or not query.strip():
        return plain
    shown = F.trim(F.coalesce(F.nullif(F.trim(F.col(text)), F.lit("")), F.nullif(F.trim(F.col("rel_path")), F.lit("")), F.to_json(F.struct("*"))))
    try:
        pool = materialise(hits.withColumn("rerank_score", scorer(F.lit(query.strip()), shown)), "rerank")
        few = pool.limit(2).count() < 2
    except Exception as e:
        warnings.warn(f"the scorer failed, hits stay in their order: {str(e)[:200]}", stacklevel=2)
        return plain
    return plain if few else pool.withColumn("rank", F.row_number().over(W.orderBy(F.col("rerank_score").desc_nulls_last(), *before)))


COLUMNS = ("rel_path", "start_line", "end_line", "ext", "content", "metadata")


def pools(limit: int, reranked: bool) -> tuple[int, int]:
    """Candidates of the dense and of the sparse leg."""
    return (rerank_pool(limit), sparse_pool(limit)) if reranked else (2 * limit, 2 * limit)


def fused_search(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, text: str, limit: int, keep: Column | None = None, scorer=None, columns: tuple[str, ...] = COLUMNS, query: str | None = None) -> DataFrame:
    """Two top-k legs fused, hydrated, reranked, auxiliary files last, cut to ``limit``.

    A dense hit without a chunk, or whose chunk the filter takes out, is none; the hits, at most ``DENSE_MAX``, are sent to the chunks.
    """
    of = chunks if keep is None else chunks.where(keep)
    live = of.join(F.broadcast(dense.select("id")), "id", "left_semi").select("id").distinct()
    fused = rrf([dense.join(live, "id", "left_semi"), sparse])
    top = fused.orderBy(F.desc("rrf_score"), "id").limit(rerank_pool(limit))
    return demote_auxiliary(rerank(hydrate(top, chunks, list(columns)), scorer, rerank_query(query, text)), limit, [F.col("rank")])


def hybrid_search(chunks: DataFrame, vectors: DataFrame, vector: list[float], text: str, limit: int, keep: Column | None = None, vector_keep: Column | None = None, scorer=None, columns: tuple[str, ...] = COLUMNS, query: str | None = None) -> DataFrame:
    """Both legs over tables without an index; ``id`` is unique in ``chunks``, so their texts are not shuffled."""
    limit = search_limit(limit)
    wide, deep = pools(limit, scorer is not None)
    return fused_search(dense_topk(vectors, vector, wide, vector_keep), bm25(chunks, text, deep, keep), chunks, text, limit, keep, scorer, columns, query)


def enclosing_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits with ``name, kind`` of the smallest symbol around them.

    If none holds all of a hit, one that holds its middle line does; ties go to the later start.
    """
    s = symbols.select("rel_path", F.col("start_line").alias("_s"), F.col("end_line").alias("_e"), "name", "kind")
    mid = F.floor((F.col("start_line") + F.col("end_line")) / 2)
    whole = (F.col("_s") <= F.col("start_line")) & (F.col("_e") >= F.col("end_line"))
    near = hits.select("id", "rel_path", "start_line", "end_line").join(s, "rel_path").withColumn("_tier", F.when(whole, 0).when((F.col("_s") <= mid) & (F.col("_e") >= mid), 1)).where("_tier is not null")
    best = near.groupBy("id").agg(F.min(F.struct("_tier", (F.col("_e") - F.col("_s")).alias("span"), (-F.col("_s")).alias("later"), "name", "kind")).alias("_b"))
    return hits.join(best.select("id", F.col("_b.name").alias("symbol"), F.col("_b.kind").alias("symbol_kind")), "id", "left")


def stale_hits(hits: DataFrame, files: DataFrame, manifest: DataFrame, key: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """Hits with ``stale``: their file is gone or no longer as the manifest has it."""
    now = files.select(*key, F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"))
    old = manifest.select(*key, "size", "mtime_ns")
    same = now.join(old, list(key)).where("_s = size and _m = mtime_ns").select(*key, F.lit(False).alias("_fresh"))
    return hits.join(same.distinct(), list(key), "left").withColumn("stale", F.coalesce("_fresh", F.lit(True))).drop("_fresh")


def nearest_ancestor(paths: DataFrame, states: DataFrame) -> DataFrame:
    """``path, ancestor``: the deepest proper ancestor that has a state."""
    from quarrylight.functions.code import ancestors

    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("ancestor"))
    known = up.join(states.select(F.col("path").alias("ancestor")).distinct(), "ancestor", "left_semi")
    return known.groupBy("path").agg(F.max_by("ancestor", F.length("ancestor")).alias("ancestor"))


def latest_state(states: DataFrame, key: str = "path", by: str = "last_updated") -> DataFrame:
    """The newest row of each root."""
    rest = [c for c in states.columns if c not in (key, by)]
    return states.groupBy(key).agg(F.max_by(F.struct(by, *rest), F.col(by)).alias("_r")).select(key, "_r.*")
