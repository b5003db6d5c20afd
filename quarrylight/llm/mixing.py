"""Mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. Of a total of T tokens a source gets its share; a source that cannot fill it within
``max_repeats`` passes is clamped at its maximum and its excess goes to the others in proportion to their targets, until all
that are left can. Each document is then taken a whole number of times and, for the fractional rest, once more if it lies in
the leading part of its source in a seeded order.

The leading part is found in two steps, so no source is ever ordered in one task: token sums of 1024 hash bins a source, then a
running sum inside the one bin in which the part ends.

Defined results
* spellings of a source that differ in letter case, ``_`` for ``-`` or blanks around are one source;
* documents of a null or unlisted source, null and empty texts are not used; a listed source without documents gets nothing;
* targets are divided by their sum; null, zero and negative targets and caps below one take no part;
* identical doc_ids are documents of their own; ties of the seeded order go by doc_id;
* empty tables give an empty multiset and report; extra columns are ignored;
* no document is used more than ``max_repeats`` times, and of a fraction the share is met up to one document.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarrylight.session import join_small, map_batches, materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BINS = 1024
SEED = 17


def clean_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), "_", "-"))


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens`` of all documents that can be used."""

    name = os.path.basename(tokenizer)
    sc = documents.sparkSession.sparkContext
    if tokenizer not in getattr(sc, "_quarrylight_files", ()):
        sc.addFile(tokenizer)  # workers need not have it
        sc._quarrylight_files = {*getattr(sc, "_quarrylight_files", ()), tokenizer}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(SparkFiles.get(name))
        tok.encode_special_tokens = True
        for b in batches:
            sizes = []
            for at in range(0, len(b), 256):
                sizes += [len(e) for e in tok.encode_batch_fast(list(b["text"].iloc[at : at + 256]), add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "tokens": sizes})

    rows = documents.select("doc_id", clean_source(F.col("source")).alias("source"), "text").where("doc_id is not null and source is not null and text <> ''")
    return map_batches(rows, count, "doc_id long, source string, tokens long")


def fill(available: dict[str, float], share: dict[str, float], cap: dict[str, int], total: float) -> dict[str, float]:
    """Tokens each source gives to a mixture of ``total`` tokens, by capped water-filling."""
    live = {s for s in share if available.get(s, 0) > 0 and share[s] > 0 and cap[s] >= 1}
    got = dict.fromkeys(share, 0.0)
    rest = total
    while live and rest > 1e-9:
        weight = sum(share[s] for s in live)
        full = {s for s in live if available[s] * cap[s] <= rest * share[s] / weight}
        if not full:
            for s in live:
                got[s] = rest * share[s] / weight
            break
        for s in full:
            got[s] = float(available[s] * cap[s])
            rest -= got[s]
        live -= full
    return got


PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("available", T.LongType()), T.StructField("planned", T.DoubleType())])


def plan(spark: SparkSession, sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """``source, target_share, max_repeats, available, planned``: one row a listed source.

    Only the listed sources' sums reach the driver; ``total`` is all usable tokens if it is None.
    """
    listed = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats >= 1")
    listed = listed.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = listed.join(sums, "source", "left").orderBy("source").collect()
    weight = sum(r.target_share for r in rows)
    share = {r.source: r.target_share / weight for r in rows}
    cap = {r.source: int(r.max_repeats) for r in rows}
    have = {r.source: int(r.available or 0) for r in rows}
    got = fill(have, share, cap, float(sum(have.values())) if total is None else total)
    return spark.createDataFrame([(s, share[s], cap[s], have[s], got[s]) for s in share], PLAN)


def mixture(spark: SparkSession, sized: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, tokens, repeats`` of the documents that are taken at least once."""
    chosen = planned.where("planned > 0 and available > 0")
    chosen = chosen.select("source", "max_repeats", F.floor(F.col("planned") / F.col("available")).cast("int").alias("_whole"), (F.col("planned") % F.col("available")).alias("_part"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    docs = sized.withColumn("_h", order).withColumn("_bin", F.pmod(F.shiftrightunsigned("_h", 20), F.lit(BINS)).cast("int"))
    # One row a source and bin: at most 1024 times the number of listed sources, which the plan has seen on the driver.
    bins = join_small(docs.groupBy("source", "_bin").agg(F.sum("tokens").alias("_in_bin")), chosen, ["source"], spread=F.col("_bin"))
    before = F.sum("_in_bin").over(W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1))
    state = bins.withColumn("_before", F.coalesce(before, F.lit(0))).select(
        "source", "_bin", "_whole", "max_repeats", F.when(F.col("_before") + F.col("_in_bin") <= F.col("_part"), 1).when(F.col("_before") >= F.col("_part"), 0).otherwise(2).alias("_side"), (F.col("_part") - F.col("_before")).alias("_left")
    )
    tagged = join_small(docs, materialise(state, "mixture-bins"), ["source", "_bin"], spread=F.col("doc_id"), rows=64 * BINS)
    sure = tagged.where("_side < 2").withColumn("repeats", F.col("_whole") + F.col("_side"))
    # The one open bin of a source: a running sum decides.
    run = F.sum("tokens").over(W.partitionBy("source").orderBy("_h", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    open_ = tagged.where("_side = 2").withColumn("_run", run).withColumn("repeats", F.col("_whole") + (F.col("_run") <= F.col("_left")).cast("int"))
    out = sure.select("doc_id", "source", "tokens", "repeats", "max_repeats").unionByName(open_.select("doc_id", "source", "tokens", "repeats", "max_repeats"))
    return out.withColumn("repeats", F.least("repeats", "max_repeats")).where("repeats > 0").drop("max_repeats")


def report(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, used_tokens, available, max_repeats, most_repeats`` of every listed source."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    all_ = F.sum("used_tokens").over(W.partitionBy(F.lit(1)))  # one row a listed source
    out = planned.join(used, "source", "left").fillna(0, ["used_tokens", "most_repeats"])
    return out.withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.nullif(all_, F.lit(0)), F.lit(0.0))).select(
        "source", "target_share", "actual_share", "used_tokens", "available", "max_repeats", "most_repeats"
    )


def sized_once(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Token sizes written once, since plan and mixture both read them."""
    return materialise(token_sizes(documents, tokenizer), "token-sizes")


def checks(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, within_cap, as_planned`` of every listed source: is no document used too often, and are
    the tokens used those planned, up to the largest of its documents?"""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.max("repeats").alias("most"), F.max("tokens").alias("largest"))
    out = planned.join(used, "source", "left").fillna(0, ["used", "most", "largest"])
    return out.select(
        "source", F.round("target_share", 6).alias("target_share"), "max_repeats", (F.col("most") <= F.col("max_repeats")).alias("within_cap"),
        ((F.col("used") <= F.col("planned") + 1e-6) & (F.col("used") > F.col("planned") - F.greatest("largest", F.lit(1)) - 1e-6)).alias("as_planned"),
    )
