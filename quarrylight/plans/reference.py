"""Queries over the engine's own operators and their SQL.

Files are ``code_files``, stored chunks ``chunks`` (of both, identical repeated rows count once), manifests the two last ended runs of each root (queries named
``*_history``: all pairs of consecutive ended runs, by the later one), vectors ``embeddings`` (``vec_id`` stands for the chunk of that number in order of ids), lifecycle events ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.functions import code, languages
from quarrylight.operators import chunking, manifest, search, symbols
from quarrylight.operators.filters import compile_filter
from quarrylight.operators.snapshot_diff import clean_path, successful_runs
from quarrylight.session import join_small, scratch_path, table
from quarrylight.sources.store import ChunkStore
from quarrylight.streaming import lifecycle

QUESTION = "restore the lazy token handler"
KEY = ["root", "rel_path"]
RUN = ["root", "run_id"]
EACH = [*RUN, "rel_path"]
NODES = ("method_declaration", "function_item", "class_definition", "interface_declaration", "mod_item", "lexical_declaration", "pair", "import_statement", "rule_set", "arrow_function", "type_spec", "block")


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Rows of ``code_files`` with ``ext`` filled. Identical repeated rows are still there: results are made distinct, not texts."""
    f = table(spark, d, "code_files").withColumn("ext", F.coalesce("ext", code.effective_ext(F.col("rel_path"))))
    return f.select(*columns).distinct() if columns else f


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Stored chunks, identical repeated rows once, by the columns asked for; with none all rows and columns."""
    c = table(spark, d, "chunks")
    return c.select(*columns).distinct() if columns else c


_C = """c as (select id, max(file_id) as file_id, max(rel_path) as rel_path, max(ext) as ext, max(start_line) as start_line, max(end_line) as end_line,
  max(content) as content, max(metadata) as metadata from chunks group by id)"""


def manifests(spark: SparkSession, d: str, back: int) -> DataFrame:
    """Manifest of the ended run of each root that has ``back`` ended ones after it."""
    ok = successful_runs(table(spark, d, "sync_runs")).where(F.col("k") == F.col("n") - 1 - back).select("run_id", "root")
    m = join_small(table(spark, d, "manifest_snapshots"), ok, ["run_id", "root"], spread=F.col("rel_path"))
    clean = m.select("root", clean_path(F.col("rel_path")).alias("rel_path"), F.lower("hash").alias("hash"), "chunk_count", "size", "mtime_ns")
    return clean.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("hash", "chunk_count", "size", "mtime_ns")))


def history(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both manifests of every pair of consecutive ended runs of a root, under the ``run_id`` of the later one, and the pairs."""
    ended = successful_runs(table(spark, d, "sync_runs")).withColumn("later", F.lead("run_id").over(W.partitionBy("root").orderBy("k")))
    m = join_small(table(spark, d, "manifest_snapshots"), ended.select(*RUN, "k", "later"), RUN, spread=F.col("rel_path"))
    clean = m.select(*RUN, "k", "later", clean_path(F.col("rel_path")).alias("rel_path"), F.lower("hash").alias("hash"), "chunk_count", "size", "mtime_ns")
    each = clean.groupBy(*EACH).agg(*(F.max(c).alias(c) for c in ("hash", "chunk_count", "size", "mtime_ns", "k", "later")))
    new = each.where("k > 0").drop("k", "later")
    old = each.where("later is not null").withColumn("run_id", F.col("later")).drop("k", "later")
    return new, old, ended.where("k > 0").select(*RUN)


_M = """ok as (select run_id, root, row_number() over (partition by root order by started_at desc, run_id desc) as back
  from (select distinct run_id, root, started_at from sync_runs where status = 'indexed')),
m as (select o.back, s.root, regexp_replace(s.rel_path, '^(\\./)+', '') as rel_path, max(lower(s.hash)) as hash, max(s.chunk_count) as chunk_count,
  max(s.size) as size, max(s.mtime_ns) as mtime_ns from manifest_snapshots s join ok o on o.run_id = s.run_id and o.root = s.root where o.back <= 2 group by 1, 2, 3),
new as (select * from m where back = 1), old as (select * from m where back = 2),
d as (select coalesce(n.root, o.root) as root, coalesce(n.rel_path, o.rel_path) as rel_path,
  case when n.root is null then 'Deleted' when n.hash is null then null when o.root is null then 'Added'
       when n.size = o.size and n.mtime_ns = o.mtime_ns then null when n.hash = o.hash then null else 'Modified' end as change_type
  from new n full join old o on n.root = o.root and n.rel_path = o.rel_path),
ch as (select * from d where change_type is not null)"""


def _changes(spark, d):
    return manifest.diff(manifests(spark, d, 0), manifests(spark, d, 1), KEY)


def entity_project(spark, d):
    f = chunks(spark, d).select("rel_path", "ext", "start_line", "end_line", "content", F.get_json_object("metadata", "$.codebasePath").alias("root"))
    f = f.where("end_line is not null")
    return chunking.to_entities(f, F.col("root")).select("id", "rel_path", "start_line", "end_line", "ext", F.sha2("content", 256).alias("content_hash")).distinct()


def payload_bytes(spark, d):
    return chunks(spark, d).select("id", code.json_size(F.col("content")).cast("long").alias("bytes")).distinct()


def aux_flag(spark, d):
    return files(spark, d, "file_id", "rel_path").select("file_id", code.is_auxiliary(F.col("rel_path")).alias("auxiliary"))


def effective_ext(spark, d):
    return table(spark, d, "code_files").select("file_id", code.effective_ext(F.col("rel_path")).alias("effective_ext")).distinct()


def collections(spark, d):
    return table(spark, d, "codebases").select("path", code.collection_name(F.col("path"), F.lit("Host")).alias("collection"))


def symbol_kinds(spark, d):
    nodes = [(x,) for x in NODES]
    return spark.createDataFrame(nodes, "node string").select("node", code.symbol_kind(F.col("node")).alias("kind"))


def language_files(spark, d):
    f = files(spark, d, "file_id", "ext")
    return join_small(f, table(spark, d, "languages"), ["ext"], "left", spread=F.col("file_id")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_files"))


def registry_languages(spark, d):
    """Files by language of the registry, by extension or else by what their content names."""
    f = files(spark, d).select("file_id", languages.language(F.col("ext"), F.col("content")).alias("language")).distinct()
    return f.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


def content_language(spark, d):
    """Files by the language their contents name, whatever their extension."""
    f = files(spark, d).select("file_id", languages.by_content(F.col("content")).alias("language")).distinct()
    return f.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


def line_split(spark, d):
    lines = files(spark, d).where("content <> ''").select("file_id", code.split_lines(F.col("content")).alias("l"))
    return lines.select("file_id", F.size("l").cast("long").alias("n_lines"), F.array_max(F.transform("l", lambda x: F.length(x))).alias("longest")).distinct()


def fixed_window_chunks(spark, d):
    w = chunking.fixed_windows(table(spark, d, "documents").select("doc_id", "text"), 1500, 200, "text")
    return w.select("doc_id", "window", F.sha2("piece", 256).alias("piece_hash"))


def manifest_diff(spark, d):
    return _changes(spark, d)


def manifest_diff_by_hash(spark, d):
    return manifest.diff_by_hash(manifests(spark, d, 0), manifests(spark, d, 1), KEY)


def change_counts(spark, d):
    return manifest.change_counts(_changes(spark, d))


def files_to_process(spark, d):
    return manifest.files_to_process(manifests(spark, d, 0), _changes(spark, d), KEY).select(*KEY, "hash", "size")


def removed_chunks(spark, d):
    return manifest.removed_chunks(manifests(spark, d, 1), _changes(spark, d), KEY)


def progress_manifest(spark, d):
    return manifest.progress_manifest(manifests(spark, d, 0), _changes(spark, d), KEY).select(*KEY, "hash", "chunk_count")


def new_total(spark, d):
    new, old = manifests(spark, d, 0), manifests(spark, d, 1)
    changes = manifest.diff(new, old, KEY)
    removed = manifest.removed_chunks(old, changes, KEY)
    added = manifest.files_to_process(new, changes, KEY).agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("added"))
    have = old.agg(F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("existing"))
    one = have.join(F.broadcast(removed)).join(F.broadcast(added))  # one row each
    return one.select(manifest.new_total(F.col("existing"), F.col("removed_chunks"), F.col("added")).cast("long").alias("total"))


def needs_hash(spark, d):
    return manifest.needs_hash(manifests(spark, d, 0), manifests(spark, d, 1), KEY).select(*KEY)


def manifest_diff_history(spark, d):
    new, old, _ = history(spark, d)
    return manifest.diff(new, old, EACH)


def manifest_diff_by_hash_history(spark, d):
    new, old, _ = history(spark, d)
    return manifest.diff_by_hash(new, old, EACH)


def change_counts_history(spark, d):
    new, old, pairs = history(spark, d)
    return pairs.join(manifest.change_counts(manifest.diff(new, old, EACH), RUN), RUN, "left").fillna(0, ["added", "modified", "deleted"])


def files_to_process_history(spark, d):
    new, old, _ = history(spark, d)
    return manifest.files_to_process(new, manifest.diff(new, old, EACH), EACH).select(*EACH, "hash", "size")


def removed_chunks_history(spark, d):
    new, old, pairs = history(spark, d)
    return pairs.join(manifest.removed_chunks(old, manifest.diff(new, old, EACH), EACH, RUN), RUN, "left").fillna(0, ["removed_chunks"])


def progress_manifest_history(spark, d):
    new, old, _ = history(spark, d)
    return manifest.progress_manifest(new, manifest.diff(new, old, EACH), EACH).select(*EACH, "hash", "chunk_count")


def new_total_history(spark, d):
    new, old, pairs = history(spark, d)
    changes = manifest.diff(new, old, EACH)
    sums = lambda df, name: df.groupBy(*RUN).agg(F.sum("chunk_count").cast("long").alias(name))
    every = pairs.join(sums(old, "existing"), RUN, "left").join(manifest.removed_chunks(old, changes, EACH, RUN), RUN, "left").join(sums(manifest.files_to_process(new, changes, EACH), "added"), RUN, "left")
    return every.fillna(0, ["existing", "removed_chunks", "added"]).select(*RUN, manifest.new_total(F.col("existing"), F.col("removed_chunks"), F.col("added")).alias("total"))


def needs_hash_history(spark, d):
    new, old, _ = history(spark, d)
    return manifest.needs_hash(new, old, EACH).select(*EACH)


def stale_results_history(spark, d):
    new, old, _ = history(spark, d)
    return search.stale_hits(old.select(*EACH), new, old, tuple(EACH)).select(*EACH, "stale")


def chunk_counts(spark, d):
    return manifest.chunk_counts(chunks(spark, d, "id", "rel_path"))


def file_chunk_ids(spark, d):
    return manifest.chunk_ids(chunks(spark, d, "id", "rel_path", "start_line"))


def completed_files(spark, d):
    c = chunks(spark, d, "id", "rel_path", "end_line")
    return manifest.completed_files(c, c.where("end_line is not null"))


def stale_ids(spark, d):
    c = chunks(spark, d, "id", "rel_path", "start_line")
    return manifest.stale_ids(c, c.where("start_line < 60")).select("rel_path", "id")


def chunk_count_update(spark, d):
    f = files(spark, d, "rel_path", "size", "mtime_ns").withColumn("chunk_count", F.lit(0))
    return manifest.with_chunk_counts(f, manifest.chunk_counts(chunks(spark, d, "id", "rel_path"))).select("rel_path", "chunk_count")


def _filtered(text):
    return lambda spark, d: chunks(spark, d).where(compile_filter(text)).select("id", "rel_path", "start_line", "end_line").distinct()


def hydrate(spark, d):
    c = chunks(spark, d)
    return search.hydrate(search.bm25(c, QUESTION, 20, repeated=True), c, ["rel_path", "start_line", "end_line", "metadata", "none_such"])


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first().embedding]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def dense_topk(spark, d):
    return search.dense_topk(_vectors(spark, d), _query_vector(spark, d), 20)


def dense_filtered(spark, d):
    return search.dense_topk(_vectors(spark, d), _query_vector(spark, d), 20, F.col("label") % 2 == 1)


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat_ws(".", F.col("doc_id").cast("string"), "lang")).alias("rel_path"), F.coalesce("lang", F.lit("")).alias("ext"))


def bm25_topk(spark, d):
    return search.bm25(_docs(spark, d), QUESTION, 20)


def bm25_all(spark, d):
    return search.bm25(_docs(spark, d), QUESTION)


def rrf_fuse(spark, d):
    return search.rrf([search.dense_topk(_vectors(spark, d), _query_vector(spark, d), 40), search.bm25(_docs(spark, d), QUESTION, 40)])


def hybrid_search(spark, d):
    hits = search.hybrid_search(_docs(spark, d), _vectors(spark, d), _query_vector(spark, d), QUESTION, 20, columns=("rel_path", "ext"))
    return hits.select("id", "rel_path", "rrf_score", "rank")


def hybrid_aux_demote(spark, d):
    c = chunks(spark, d)
    hits = search.rrf([search.bm25(c, QUESTION, 40, repeated=True)])
    some = F.substring(F.md5("rel_path"), 1, 1).isin(*"01234")  # a third counts as auxiliary
    named = search.hydrate(hits, c, ["rel_path"]).withColumn("rel_path", F.when(some, F.concat(F.col("rel_path"), F.lit("/OWNERS"))).otherwise(F.col("rel_path")))
    return search.demote_auxiliary(named, 20, [F.desc("rrf_score"), F.col("id")]).select("id", "rank")


def symbol_enclosing(spark, d):
    hits = chunks(spark, d, "id", "rel_path", "start_line", "end_line").where("end_line is not null")
    s = files(spark, d).select("rel_path", F.lit("whole").alias("name"), F.lit("file").alias("kind"), F.lit(1).alias("start_line"), F.size(code.split_lines(F.col("content"))).alias("end_line")).distinct()
    halves = s.unionByName(s.select("rel_path", F.lit("half").alias("name"), F.lit("part").alias("kind"), F.lit(1).alias("start_line"), F.ceil(F.col("end_line") / 2).cast("int").alias("end_line")))
    return search.enclosing_symbols(hits, halves).select("id", "symbol")


def file_symbols(spark, d):
    return symbols.symbols(files(spark, d)).distinct()


def stale_results(spark, d):
    return search.stale_hits(manifests(spark, d, 1).select(*KEY).withColumn("rel_path", F.concat_ws("/", *KEY)), manifests(spark, d, 0).withColumn("rel_path", F.concat_ws("/", *KEY)), manifests(spark, d, 1).withColumn("rel_path", F.concat_ws("/", *KEY))).select("rel_path", "stale")


def nearest_ancestor(spark, d):
    return search.nearest_ancestor(files(spark, d, "abs_path").withColumnRenamed("abs_path", "path"), table(spark, d, "codebases"))


def latest_state(spark, d):
    return search.latest_state(table(spark, d, "codebases").select("path", "status", "last_updated"))


def latest_run(spark, d):
    return search.latest_state(table(spark, d, "sync_runs").select("root", "started_at", "run_id", "status"), "root", "started_at").select("root", "run_id", "status")


def status_lines(spark, d):
    return table(spark, d, "codebases").select("path", code.status_line().alias("line"))


def _chunked(mode):
    def run(spark, d):
        c = chunking.build_chunks(files(spark, d), F.col("root"), 1500, 200, mode)
        return c.select("id", "rel_path", "start_line", "end_line", F.length("content").alias("n_chars")).distinct()

    return run


def payload_resplit(spark, d):
    c = chunking.build_chunks(files(spark, d), F.col("root"), 40_000, 200, "text").select("rel_path", "id", F.octet_length("content").alias("n")).distinct()
    return c.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("n").alias("largest"))


def _events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", lifecycle.STARTED).when(F.col("event_type") == "view", lifecycle.STEP).when(F.col("event_type") == "click", lifecycle.PROGRESS).when(F.col("event_type") == "purchase", lifecycle.COMPLETED).otherwise(lifecycle.FAILED)
    return e.select("event_id", F.col("user_id").cast("string").alias("path"), kind.alias("type"), F.col("ts").cast("timestamp").alias("ts"))


def event_lifecycle(spark, d):
    return lifecycle.final_states(_events(spark, d))


def progress_throttle(spark, d):
    return lifecycle.throttled(_events(spark, d)).select("event_id", "path", "type", "operation")


def notifications(spark, d):
    return lifecycle.notifications(_events(spark, d))


def event_windows(spark, d):
    return lifecycle.windowed_counts(_events(spark, d)).select(F.unix_timestamp("window_start").alias("window_start"), "type", "n")


def _stored(spark, d, keep="true"):
    """A store with one collection ``c`` that holds the chunks ``keep`` lets in."""
    s = ChunkStore(spark, scratch_path(spark, "store"))
    s.create("c", 64)
    s.upsert("c", chunks(spark, d).where(keep))
    return s


def store_upsert(spark, d):
    s = _stored(spark, d, "start_line < 60")
    s.upsert("c", chunks(spark, d).where("start_line >= 40").withColumn("content", F.lit("newer text")))
    return s.read("c").select("id", "rel_path", F.length("content").alias("n_chars"), "n_terms")


def store_delete_file(spark, d):
    s = _stored(spark, d)
    path = s.read("c").agg(F.min("rel_path")).first()[0]
    s.delete("c", f'relativePath == "{path}"')
    return s.read("c").select("id", "rel_path")


def store_delete_ids(spark, d):
    s = _stored(spark, d)
    s.delete_ids("c", chunks(spark, d, "id", "start_line").where("start_line = 1"))
    return s.read("c").select("id", "rel_path")


def store_delete_filter(spark, d):
    s = _stored(spark, d)
    s.delete("c", 'fileExtension == "go" and startLine > 1')
    return s.read("c").select("id", "rel_path")


def store_replace_files(spark, d):
    s = _stored(spark, d)
    of = chunks(spark, d).where("ext in ('go', 'py')")
    s.replace_files("c", of.select("rel_path"), of.where("start_line = 1"))
    return s.read("c").select("id", "rel_path", "start_line")


FILTERS = {
    "filter_eq": ('fileExtension == "go"', "ext = 'go'"),
    "filter_in": ('fileExtension in ["py", "ts"]', "ext in ('py', 'ts')"),
    "filter_prefix": ('relativePath like "core/%"', "starts_with(rel_path, 'core/')"),
    "filter_numeric": ("startLine >= 40 and endLine <= 90", "start_line >= 40 and end_line <= 90"),
    "filter_and": ('relativePath like "lib/%" and fileExtension in ["go"] and startLine > 1', "starts_with(rel_path, 'lib/') and ext = 'go' and start_line > 1"),
}
QUERIES = {
    f.__name__: f
    for f in (
        entity_project, payload_bytes, aux_flag, effective_ext, collections, symbol_kinds, language_files, registry_languages, content_language, line_split, fixed_window_chunks, manifest_diff, manifest_diff_by_hash,
        change_counts, files_to_process, removed_chunks, progress_manifest, new_total, needs_hash, chunk_counts, file_chunk_ids, completed_files, stale_ids, chunk_count_update, hydrate,
        dense_topk, dense_filtered, bm25_topk, bm25_all, rrf_fuse, hybrid_search, hybrid_aux_demote, symbol_enclosing, file_symbols, stale_results, nearest_ancestor, latest_state, latest_run,
        status_lines, store_upsert, store_delete_file, store_delete_ids, store_delete_filter, store_replace_files, payload_resplit, event_lifecycle, progress_throttle, notifications, event_windows, manifest_diff_history, manifest_diff_by_hash_history, change_counts_history,
        files_to_process_history, removed_chunks_history, progress_manifest_history, new_total_history, needs_hash_history, stale_results_history,
    )
} | {k: _filtered(v[0]) for k, v in FILTERS.items()} | {"text_chunker": _chunked("text"), "code_chunker": _chunked("ast")}

_AUX = ", ".join(f"'{x}'" for x in code.AUXILIARY)
_F = "f as (select distinct on (file_id) * from code_files)"
_WORDS = code.query_terms(QUESTION)


def _bm25_sql(source: str, name: str) -> str:
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) as tf{i}" for i, w in enumerate(_WORDS))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(_WORDS)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(_WORDS)))
    any_ = " or ".join(f"tf{i} > 0" for i in range(len(_WORDS)))
    return f"""{name}_t as (select id, list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> '') as t from {source} where content is not null),
{name}_p as (select id, len(t) as dl, {tf} from {name}_t),
{name}_s as (select count(*) as n, avg(dl) as av, {df} from {name}_p),
{name} as (select id, round({score}, 6) as score from {name}_p, {name}_s where {any_})"""


_DOCS = "docs as (select doc_id as id, text as content, concat_ws('/', coalesce(source, 'none'), concat_ws('.', cast(doc_id as varchar), lang)) as rel_path from documents)"
_DENSE = """q as (select embedding as e from embeddings where vec_id = 0),
dense as (select vec_id as id, label, round(list_dot_product(cast(embedding as double[]), cast(e as double[])) / (sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_dot_product(cast(e as double[]), cast(e as double[])))), 6) as score from embeddings, q)"""
_LEGS = f"""{_DOCS}, {_bm25_sql("docs", "b")}, {_DENSE},
legs as (select * from (select id, row_number() over (order by score desc, id) as rank from dense) where rank <= 40
  union all select * from (select id, row_number() over (order by score desc, id) as rank from b) where rank <= 40)"""
_EVENTS = """e as (select event_id, cast(user_id as varchar) as path, case event_type when 'signup' then 'operation_started' when 'view' then 'step_updated'
  when 'click' then 'progress_updated' when 'purchase' then 'operation_completed' else 'operation_failed' end as type, ts from events),
n as (select *, sum(cast(type = 'operation_started' as int)) over (partition by path order by ts, event_id) as operation from e),
l as (select *, operation > 0 and coalesce(sum(cast(type in ('operation_completed', 'operation_failed') as int))
  over (partition by path, operation order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 0 as live from n)"""

SQL = {k: f"with {_C} select id, rel_path, start_line, end_line from c where {v[1]}" for k, v in FILTERS.items()} | {
    "entity_project": f"with {_C} select 'chunk_' || substr(sha256(concat_ws(':', rel_path, start_line, end_line, content)), 1, 16) as id, rel_path, start_line, end_line, regexp_replace(coalesce(ext, ''), '^\\.', '') as ext, sha256(content) as content_hash from c where end_line is not null",
    "payload_bytes": f"with {_C} select id, strlen(content) + 2 + len(regexp_extract_all(content, '[\"\\\\\\n\\r\\t]')) + 5 * len(regexp_extract_all(content, '[<>&]')) as bytes from c",
    "aux_flag": f"with {_F} select file_id, lower(regexp_extract(rel_path, '[^/]*$')) in ({_AUX}) as auxiliary from f",
    "effective_ext": r"""select distinct file_id, case when b in ('makefile', 'gnumakefile') then '.mk' when b = 'dockerfile' then '.dockerfile' when b = '.gitattributes' then b
  when b = 'go.sum' then '.go.sum' when b = 'requirements.txt' then '.requirements.txt' else regexp_extract(b, '\.[^.]*$') end as effective_ext
  from (select file_id, lower(regexp_extract(rel_path, '[^/]*$')) as b from code_files)""",
    "collections": "select path, 'code_chunks_' || md5('host:' || path) as collection from codebases",
    "language_files": f"with {_F} select l.lang, count(*) as n_files from f left join languages l on l.ext = coalesce(f.ext, lower(regexp_extract(f.rel_path, '\\.[^./]*$'))) group by 1",
    "line_split": f"with {_F}, s as (select file_id, unnest(string_split(content, chr(10))) as line, unnest(range(len(string_split(content, chr(10))))) as i, len(string_split(content, chr(10))) as n from f where content <> '') select file_id, count(*) as n_lines, max(length(line) + cast(i < n - 1 as int)) as longest from s group by 1",
    "fixed_window_chunks": "with w as (select doc_id, text, cast(unnest(range(case when length(text) <= 1500 then 1 else cast(ceil((length(text) - 1500) / 1300.0) as int) + 1 end)) as int) as \"window\" from documents where length(text) > 0) select doc_id, \"window\", sha256(substr(text, \"window\" * 1300 + 1, 1500)) as piece_hash from w",
    "manifest_diff": f"with {_M} select root, rel_path, change_type from ch",
    "manifest_diff_by_hash": f"with {_M} select coalesce(n.root, o.root) as root, coalesce(n.rel_path, o.rel_path) as rel_path, case when n.root is null then 'Deleted' when o.hash is null then 'Added' else 'Modified' end as change_type from new n full join old o on n.root = o.root and n.rel_path = o.rel_path where case when n.root is null then o.hash is not null when n.hash is null then false else o.hash is null or n.hash <> o.hash end",
    "change_counts": f"with {_M} select count(*) filter (change_type = 'Added') as added, count(*) filter (change_type = 'Modified') as modified, count(*) filter (change_type = 'Deleted') as deleted from ch",
    "files_to_process": f"with {_M} select n.root, n.rel_path, n.hash, n.size from new n join ch on ch.root = n.root and ch.rel_path = n.rel_path where change_type <> 'Deleted'",
    "removed_chunks": f"with {_M} select cast(coalesce(sum(o.chunk_count), 0) as bigint) as removed_chunks from ch join old o on o.root = ch.root and o.rel_path = ch.rel_path where change_type <> 'Added'",
    "progress_manifest": f"with {_M} select n.root, n.rel_path, n.hash, n.chunk_count from new n left join ch on ch.root = n.root and ch.rel_path = n.rel_path where ch.root is null",
    "new_total": f"with {_M}, t as (select (select coalesce(sum(chunk_count), 0) from old) as e, (select coalesce(sum(o.chunk_count), 0) from ch join old o on o.root = ch.root and o.rel_path = ch.rel_path where change_type <> 'Added') as r, (select coalesce(sum(n.chunk_count), 0) from ch join new n on n.root = ch.root and n.rel_path = ch.rel_path where change_type <> 'Deleted') as a) select cast(case when e - r + a < 0 then a else e - r + a end as bigint) as total from t",
    "needs_hash": f"with {_M} select n.root, n.rel_path from new n left join old o on o.root = n.root and o.rel_path = n.rel_path where o.size is null or n.size <> o.size or n.mtime_ns <> o.mtime_ns",
    "chunk_counts": f"with {_C} select rel_path, count(*) as n_chunks from c group by 1",
    "file_chunk_ids": f"with {_C} select rel_path, string_agg(id, ' ' order by start_line, id) as ids from c group by 1",
    "completed_files": f"with {_C} select rel_path, count(*) as n_chunks from c group by 1 having count(*) = count(end_line)",
    "stale_ids": f"with {_C} select rel_path, id from c where start_line >= 60",
    "chunk_count_update": f"with {_C}, {_F}, k as (select rel_path, cast(count(*) as int) as n from c group by 1) select f.rel_path, coalesce(k.n, 0) as chunk_count from f left join k on k.rel_path = f.rel_path",
    "dense_topk": f"with {_DENSE} select id, score, row_number() over (order by score desc, id) as rank from dense order by rank limit 20",
    "dense_filtered": f"with {_DENSE} select id, score, row_number() over (order by score desc, id) as rank from dense where label % 2 = 1 order by rank limit 20",
    "bm25_topk": f"with {_DOCS}, {_bm25_sql('docs', 'b')} select id, score, row_number() over (order by score desc, id) as rank from b order by rank limit 20",
    "bm25_all": f"with {_DOCS}, {_bm25_sql('docs', 'b')} select id, score from b",
    "rrf_fuse": f"with {_LEGS} select id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score from legs group by id",
    "hybrid_search": f"with {_LEGS}, r as (select id, round(sum(1.0::double / (60 + rank)), 9) as rrf_score from legs where id in (select id from docs) group by id), h as (select r.id, d.rel_path, rrf_score, lower(regexp_extract(d.rel_path, '[^/]*$')) in ({_AUX}) as aux from r join docs d on d.id = r.id) select id, rel_path, rrf_score, row_number() over (order by aux, rrf_score desc, id) as rank from h order by rank limit 20",
    "hydrate": f"with {_C}, {_bm25_sql('c', 'b')}, t as (select id, score, row_number() over (order by score desc, id) as rank from b order by rank limit 20) select t.id, t.score, t.rank, c.rel_path, coalesce(c.start_line, 0) as start_line, coalesce(c.end_line, 0) as end_line, coalesce(c.metadata, '{{}}') as metadata from t join c on c.id = t.id",
    "symbol_enclosing": f"""with {_C}, {_F}, s as (select rel_path, len(string_split(content, chr(10))) as n from f)
select c.id, case when c.end_line <= ceil(s.n / 2.0) then 'half' when c.end_line <= s.n then 'whole' when floor((c.start_line + c.end_line) / 2.0) <= ceil(s.n / 2.0) then 'half' when floor((c.start_line + c.end_line) / 2.0) <= s.n then 'whole' end as symbol
from c left join s on s.rel_path = c.rel_path where c.end_line is not null""",
    "stale_results": f"with {_M} select concat_ws('/', o.root, o.rel_path) as rel_path, n.root is null as stale from old o left join new n on n.root = o.root and n.rel_path = o.rel_path and n.size = o.size and n.mtime_ns = o.mtime_ns",
    "nearest_ancestor": "select f.abs_path as path, max_by(c.path, length(c.path)) as ancestor from (select distinct abs_path from code_files) f join codebases c on starts_with(f.abs_path, c.path || '/') group by 1",
    "latest_state": "select path, max(last_updated) as last_updated, max_by(status, last_updated) as status from codebases group by 1",
    "status_lines": "select path, case status when 'indexing' then 'indexing: ' || coalesce(step, '') || ' since ' || strftime(coalesce(started_at, last_updated), '%Y-%m-%dT%H:%M:%SZ') when 'indexed' then 'indexed, last updated ' || strftime(last_updated, '%Y-%m-%dT%H:%M:%SZ') when 'failed' then 'failed: ' || coalesce(error_message, '') else 'unknown status for ' || path end as line from codebases",
    "event_lifecycle": f"with {_EVENTS}, t as (select path, max_by(type, row(ts, event_id)) filter (live and type in ('operation_started', 'operation_completed', 'operation_failed')) as type, max(operation) as operations, max_by(event_id, row(ts, event_id)) as last_event from l group by path) select path, coalesce(case type when 'operation_started' then 'indexing' when 'operation_completed' then 'indexed' when 'operation_failed' then 'failed' end, 'not_found') as status, cast(operations as bigint) as operations, last_event from t",
    "progress_throttle": f"with {_EVENTS} select event_id, path, type, cast(operation as bigint) as operation from (select *, row_number() over (partition by path, operation, type = 'progress_updated', case when type = 'progress_updated' then date_trunc('second', ts) else null end, case when type = 'progress_updated' then 0 else event_id end order by ts desc, event_id desc) as r from l where live) where r = 1",
    "notifications": f"with {_EVENTS} select event_id, case when type = 'operation_failed' then 'error' else 'info' end as level, case type when 'operation_started' then 'started on ' when 'step_updated' then 'next step on ' when 'operation_completed' then 'completed on ' else 'failed on ' end || path as message from e where type <> 'progress_updated'",
    "event_windows": f"with {_EVENTS} select cast(epoch(date_trunc('hour', ts)) as bigint) as window_start, type, count(*) as n from e group by 1, 2",
}
_TERMS = "len(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: x <> ''))"
SQL["store_upsert"] = f"with {_C} select id, rel_path, cast(case when start_line >= 40 then 10 else length(content) end as int) as n_chars, cast(case when start_line >= 40 then 2 else {_TERMS} end as int) as n_terms from c"
SQL["store_delete_file"] = f"with {_C} select id, rel_path from c where rel_path <> (select min(rel_path) from c)"
SQL["store_delete_ids"] = f"with {_C} select id, rel_path from c where start_line <> 1"
SQL["store_delete_filter"] = f"with {_C} select id, rel_path from c where not (coalesce(ext, '') = 'go' and start_line > 1)"
SQL["store_replace_files"] = f"with {_C}, g as (select distinct rel_path from c where ext in ('go', 'py')) select id, rel_path, start_line from c where rel_path not in (select rel_path from g) or (ext in ('go', 'py') and start_line = 1)"
_NAMED = " ".join(f"when '{n}' then '{x}'" for n, x in languages.BY_NAME.items())


def _content_sql(text: str) -> str:
    """Language that ``text`` names; the same patterns over its edges."""
    edges = f"array_to_string(list_concat(string_split({text}, chr(10))[1:5], list_reverse(string_split({text}, chr(10)))[1:5]), chr(10))"
    found = [*(f"regexp_extract({edges}, '{p}', 1)" for p in languages.MODELINE), f"regexp_extract({text}, '{languages.SHEBANG}', 1)"]
    return "coalesce(" + ", ".join(f"case lower({x}) {_NAMED} end" for x in found) + ")"


_EXTS = " ".join(f"when '{e}' then '{x}'" for e, x in languages.BY_EXT.items())
SQL["registry_languages"] = f"with {_F}, e as (select file_id, content, coalesce(ext, case when b in ('makefile', 'gnumakefile') then '.mk' when b = 'dockerfile' then '.dockerfile' when b = '.gitattributes' then b when b = 'go.sum' then '.go.sum' when b = 'requirements.txt' then '.requirements.txt' else regexp_extract(b, '\\.[^.]*$') end) as ext from (select *, lower(regexp_extract(rel_path, '[^/]*$')) as b from f)) select coalesce(case lower(ext) {_EXTS} end, {_content_sql('content')}) as language, count(*) as n_files from e group by 1"
SQL["content_language"] = f"with {_F} select {_content_sql('content')} as language, count(*) as n_files from f group by 1"
SQL["text_chunker"] = """with recursive f as (select rel_path, ls, n, list_transform(ls, lambda x, k: cast(length(x) + case when k < n then 1 else 0 end as bigint)) as lens
  from (select distinct rel_path, string_split(content, chr(10)) as ls, len(string_split(content, chr(10))) as n from code_files where rel_path is not null and regexp_matches(content, '\\S'))),
p as (select *, list_concat([0::bigint], list_transform(range(1, n + 1), lambda k: cast(list_sum(lens[1:k]) as bigint))) as upto, list_filter(range(0, n), lambda k: lens[k + 1] > 1500) as longs from f),
e as (
  select rel_path, 0::bigint as i from p
  union all
  select rel_path, nxt from (
    select rel_path, n, ls, case when lens[i + 1] > 1500 then i + 1 when stop >= n then null
      when stop > i + 1 then least(stop - 1, greatest(i + 1, len(list_filter(upto, lambda x: x <= upto[stop + 1] - 200)) - 1)) else stop end as nxt
    from (select p.*, e.i, case when upto[n + 1] - upto[i + 1] <= 1500 then n
        else greatest(i + 1, least(coalesce(list_min(list_filter(longs, lambda x: x >= i)), n), len(list_filter(upto, lambda x: x <= upto[i + 1] + 1500)) - 1)) end as stop
      from e join p using (rel_path)))
  where nxt < n and not (nxt = n - 1 and ls[n] = '')),
c as (select p.*, e.i, case when upto[n + 1] - upto[i + 1] <= 1500 then n
    else greatest(i + 1, least(coalesce(list_min(list_filter(longs, lambda x: x >= i)), n), len(list_filter(upto, lambda x: x <= upto[i + 1] + 1500)) - 1)) end as stop from e join p using (rel_path)),
t as (
  select rel_path, i + 1 as s, stop as t, array_to_string(ls[i + 1:stop], chr(10)) || case when stop < n then chr(10) else '' end as text from c where lens[i + 1] <= 1500
  union all
  select rel_path, i + 1, i + 1, substr(ls[i + 1] || case when i + 1 < n then chr(10) else '' end, k * 1300 + 1, 1500)
  from (select *, unnest(range(0, cast(ceil((lens[i + 1] - 1500) / 1300.0) as bigint) + 1)) as k from c where lens[i + 1] > 1500))
select distinct 'chunk_' || substr(sha256(concat_ws(':', rel_path, s, t, text)), 1, 16) as id, rel_path, cast(s as int) as start_line, cast(t as int) as end_line, cast(length(text) as int) as n_chars from t"""
_KIND = " ".join(
    f"when list_contains(w, '{w}')" + {"module": " or starts_with(node, 'mod_')", "variable": " or list_contains(w, 'lexical') or list_contains(w, 'binding') or node in ('pair', 'attribute')"}.get(w, "") + f" then '{w}'" for w in code.KIND_WORDS
)
_PLAIN = "node"
for _s in code.KIND_SUFFIXES:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_s}$', '')"
_NODES = ", ".join(f"('{n}')" for n in NODES)
SQL["symbol_kinds"] = f"select node, case {_KIND} else coalesce(nullif(trim(replace({_PLAIN}, '_', ' ')), ''), 'definition') end as kind from (select node, regexp_split_to_array(node, '[_-]') as w from (values {_NODES}) t(node))"
SQL["hybrid_aux_demote"] = f"""with {_C}, {_bm25_sql("c", "b")}, h as (select id, round(1.0::double / (60 + rank), 9) as s from (select id, row_number() over (order by score desc, id) as rank from b) where rank <= 40),
a as (select h.id, s, substr(md5(c.rel_path), 1, 1) in ('0', '1', '2', '3', '4') or lower(regexp_extract(c.rel_path, '[^/]*$')) in ({_AUX}) as aux from h join c on c.id = h.id)
select id, row_number() over (order by aux, s desc, id) as rank from a order by rank limit 20"""
_LATEST_RUN = "select root, run_id, status from (select *, row_number() over (partition by root order by started_at desc, run_id desc) as r from (select distinct root, run_id, status, started_at from sync_runs)) where r = 1"
SQL["latest_run"] = _LATEST_RUN

# The same over all pairs of consecutive ended runs, by the later one.
_H = """ok as (select run_id, root, row_number() over (partition by root order by started_at, run_id) as k
  from (select distinct run_id, root, started_at from sync_runs where status = 'indexed')),
prs as (select b.root, b.run_id, a.run_id as before from ok b join ok a on a.root = b.root and a.k = b.k - 1),
m as (select s.run_id as at, s.root, regexp_replace(s.rel_path, '^(\\./)+', '') as rel_path, max(lower(s.hash)) as hash, max(s.chunk_count) as chunk_count,
  max(s.size) as size, max(s.mtime_ns) as mtime_ns from manifest_snapshots s join ok o on o.run_id = s.run_id and o.root = s.root group by 1, 2, 3),
new as (select p.run_id, m.* from prs p join m on m.root = p.root and m.at = p.run_id),
old as (select p.run_id, m.* from prs p join m on m.root = p.root and m.at = p.before),
d as (select coalesce(n.root, o.root) as root, coalesce(n.run_id, o.run_id) as run_id, coalesce(n.rel_path, o.rel_path) as rel_path,
  case when n.root is null then 'Deleted' when n.hash is null then null when o.root is null then 'Added'
       when n.size = o.size and n.mtime_ns = o.mtime_ns then null when n.hash = o.hash then null else 'Modified' end as change_type
  from new n full join old o on n.root = o.root and n.run_id = o.run_id and n.rel_path = o.rel_path),
ch as (select * from d where change_type is not null)"""
_ON = "{0}.root = {1}.root and {0}.run_id = {1}.run_id and {0}.rel_path = {1}.rel_path"
_NO, _CO, _CN = _ON.format("n", "o"), _ON.format("ch", "o"), _ON.format("ch", "n")
_SUMS = f"""e as (select root, run_id, sum(chunk_count) as c from old group by 1, 2), r as (select ch.root, ch.run_id, sum(o.chunk_count) as c from ch join old o on {_CO} where change_type <> 'Added' group by 1, 2),
a as (select ch.root, ch.run_id, sum(n.chunk_count) as c from ch join new n on {_CN} where change_type <> 'Deleted' group by 1, 2),
t as (select prs.root, prs.run_id, coalesce(e.c, 0) as e, coalesce(r.c, 0) as r, coalesce(a.c, 0) as a from prs left join e using (root, run_id) left join r using (root, run_id) left join a using (root, run_id))"""
SQL |= {
    "manifest_diff_history": f"with {_H} select root, run_id, rel_path, change_type from ch",
    "manifest_diff_by_hash_history": f"with {_H} select coalesce(n.root, o.root) as root, coalesce(n.run_id, o.run_id) as run_id, coalesce(n.rel_path, o.rel_path) as rel_path, case when n.root is null then 'Deleted' when o.hash is null then 'Added' else 'Modified' end as change_type from new n full join old o on {_NO} where case when n.root is null then o.hash is not null when n.hash is null then false else o.hash is null or n.hash <> o.hash end",
    "change_counts_history": f"with {_H} select prs.root, prs.run_id, count(*) filter (change_type = 'Added') as added, count(*) filter (change_type = 'Modified') as modified, count(*) filter (change_type = 'Deleted') as deleted from prs left join ch on ch.root = prs.root and ch.run_id = prs.run_id group by 1, 2",
    "files_to_process_history": f"with {_H} select n.root, n.run_id, n.rel_path, n.hash, n.size from new n join ch on {_CN} where change_type <> 'Deleted'",
    "removed_chunks_history": f"with {_H}, {_SUMS} select root, run_id, cast(r as bigint) as removed_chunks from t",
    "progress_manifest_history": f"with {_H} select n.root, n.run_id, n.rel_path, n.hash, n.chunk_count from new n left join ch on {_CN} where ch.root is null",
    "new_total_history": f"with {_H}, {_SUMS} select root, run_id, cast(case when e - r + a < 0 then a else e - r + a end as bigint) as total from t",
    "needs_hash_history": f"with {_H} select n.root, n.run_id, n.rel_path from new n left join old o on {_NO} where o.size is null or n.size <> o.size or n.mtime_ns <> o.mtime_ns",
    "stale_results_history": f"with {_H} select o.root, o.run_id, o.rel_path, n.root is null as stale from old o left join new n on {_NO} and n.size = o.size and n.mtime_ns = o.mtime_ns",
}
