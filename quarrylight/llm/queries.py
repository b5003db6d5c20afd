"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import credentials, handwritten, leakage, mixing, parsing, repetition, splitting
from quarrylight.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find(table(spark, d, "chunks")).select("id", "line_no")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "chunks")).where("n_redacted > 0").select("id", "rel_path", "content", "n_redacted").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    big = splitting.oversized(table(spark, d, "chunks"))
    return splitting.split_pieces(big).where("piece > 0 and id is not null").select("id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_pieces(splitting.distinct_rows(splitting.oversized(table(spark, d, "chunks"))))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every oversized chunk with what its pieces fulfil."""
    return splitting.checks(p2_pieces(spark, d).where("id is not null"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.judged(table(spark, d, "code_files")).where("reason is not null").select("file_id").distinct()


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files by reason, the hand-written ones as null."""
    return handwritten.judged(table(spark, d, "code_files")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"), F.sum("tokens").alias("tokens"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parsed(table(spark, d, "code_files"), table(spark, d, "languages")).where("edits > 0").select("file_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(parsing.parsed(table(spark, d, "code_files"), table(spark, d, "languages")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.sized_once(table(spark, d, "documents"))
    planned = mixing.plan(spark, sized, table(spark, d, "mix_targets"))
    return mixing.mixture(spark, sized, planned), planned


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mixed(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every listed source with what the mixture fulfils."""
    return mixing.checks(*_mixed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents")).select("doc_id").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"), content=1.0).select("doc_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_checks": p2_checks,
    "p3_found": p3_found,
    "p3_reasons": p3_reasons,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_mixture": p8_mixture,
    "p8_report": p8_report,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
}

_SAID = r"""w as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') as ws from documents),
g as (select doc_id, i, list_slice(ws, i, i + 5) as gram, len(ws) as n from w, lateral (select unnest(range(1, len(ws) - 4)) as i) t where len(ws) >= 6),
r as (select doc_id, i, n, row_number() over (partition by doc_id, gram order by i) as k from g),
c as (select distinct doc_id, n, i + j as p from r, range(0, 6) t(j) where k > 1)"""

_LEAKS = r"""pw as (select distinct item_id, passage, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as ws from eval_items where item_id is not null and passage is not null),
pg as (select item_id, passage, len(ws) as n, i, list_slice(ws, i, i + 5) as g from pw, lateral (select unnest(range(1, len(ws) - 4)) as i) t where len(ws) >= 6),
dw as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents where text is not null),
dg as (select distinct doc_id, list_slice(ws, i, i + 5) as g from dw, lateral (select unnest(range(1, len(ws) - 4)) as i) t where len(ws) >= 6),
m as (select distinct d.doc_id, p.item_id, p.passage, p.n, p.i from dg d join pg p on p.g = d.g),
cov as (select doc_id, item_id, passage, n, count(distinct i + j) as hit from m, range(0, 6) t(j) group by 1, 2, 3, 4),
win as (select doc_id, item_id, passage, count(*) as wins from m group by 1, 2, 3),
lk as (select doc_id, item_id, max(hit / n) as share, bool_or(wins = n - 5) as whole from cov join win using (doc_id, item_id, passage) where hit >= 0.5 * n group by 1, 2)"""

SQL = {
    "p2_checks": "select id, max(strlen(content)) as n_bytes, true as fits, true as covers, true as overlaps from chunks where strlen(content) > 10240 and id is not null group by id",
    "p7_found": f"with {_LEAKS} select doc_id, item_id from lk",
    "p7_items": f"with {_LEAKS} select item_id, count(*) as n_docs, cast(sum(cast(whole as int)) as bigint) as n_exact from lk group by 1",
    "p8_checks": "with t as (select lower(replace(trim(source), '_', '-')) as source, sum(target_share) as s, min(max_repeats) as m from mix_targets where source is not null and target_share > 0 and max_repeats >= 1 group by 1) select source, round(s / (select sum(s) from t), 6) as target_share, m as max_repeats, true as within_cap, true as as_planned from t",
    "p2_found": "select distinct id from chunks where strlen(content) > 10240",
    "p9_found": f"with {_SAID} select doc_id from c group by doc_id, n having count(*) >= 0.45 * n",
    "p9_shares": f"with {_SAID}, k as (select doc_id, count(*) as said from c group by doc_id) select w.doc_id, cast(len(w.ws) as bigint) as n_words, round(coalesce(k.said, 0) / greatest(len(w.ws), 1), 6) as repeated_share from w left join k on k.doc_id = w.doc_id",
}
