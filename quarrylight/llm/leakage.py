"""Evaluation texts leaking into training text, by a distributed positional inverted index.

The index holds the postings of all words of all documents. It is made of segments, each of the documents of one batch: of every
word of a segment a row with its places, delta-coded over the segment, and one row that says where its documents begin. It is
written once and serves any number of test sets; nothing of it depends on them.

A test set is looked up by its words. The lists of a segment are joined at the places that follow one another into runs of three
words, and every six-word window of a passage starts from the run with the rarest word of the whole corpus: where that stands, the
window's other runs have to stand at their offsets. What is left are exact occurrences of six passage words in order, and their
union is the leaked part of the passage. How far apart they lie tells an exact copy from passages taken in pieces.

Defined results
* a word is a maximal run of letters and digits in any case; all else separates;
* passages shorter than six words, null or empty passages and null or empty texts match nothing;
* documents with the same text give one row each; repeated items of one id count as one passage each, the greatest share wins;
* passages are looked up in blocks of about ``block`` characters, so no broadcast grows with the test set; a block reads the lists
  of its own words, not the documents;
* null ids are no match; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import map_batches, materialise, ship

RUN = 6
TERM = 3
SHARE = 0.5
BLOCK = 1_000_000  # passage characters of one broadcast
#: Documents of one segment; its texts are those of one batch, so its size is bounded like that of a batch.
SEGMENT = 2_000
WORD = re.compile(r"[^\W_]+")
#: Word number of the row that says where the documents of a segment begin; no hash of a word, for these are not negative.
DOCS = -1
WIDTHS = (np.uint8, np.uint16, np.uint32)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Hashes(dict):
    """Hash of a word, filled as words come, bounded."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode("utf-8", "replace")) >> 1
        if len(self) < 500_000:
            self[word] = value
        return value


def packed(places: np.ndarray) -> bytes:
    """Ascending places as gaps, in the narrowest of three widths."""
    gaps = np.diff(places, prepend=0)
    k = 0 if (top := int(gaps.max())) < 1 << 8 else 1 if top < 1 << 16 else 2
    return bytes([k]) + gaps.astype(WIDTHS[k]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, dtype=WIDTHS[raw[0]], offset=1).astype(np.int64))


INDEX = "segment long, word long, n long, places binary, docs array<long>"
COLUMNS = [c.split()[0] for c in INDEX.split(", ")]


def index(documents: DataFrame) -> DataFrame:
    """``segment, word, n, places, docs``: all postings of all documents, written to the shared folder."""

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, task, k = Hashes(), TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, len(b), SEGMENT):
                part = b.iloc[at : at + SEGMENT]
                texts = [WORD.findall(t.lower()) for t in part["text"]]
                size = np.array([len(ws) for ws in texts])
                start = np.cumsum(np.r_[1, size[:-1] + 1])  # a place between documents is nobody's
                word = np.fromiter((hashes[w] for ws in texts for w in ws), dtype=np.int64, count=int(size.sum()))
                place = np.arange(len(word)) + np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size)
                order = np.argsort(word, kind="stable")  # places of a word stay in order
                first = np.flatnonzero(np.r_[True, np.diff(word[order]) != 0]) if len(word) else np.zeros(0, dtype=np.int64)
                segment, k = task << 32 | k, k + 1
                yield pd.DataFrame([(segment, DOCS, len(part), packed(start), part["doc_id"].to_numpy())], columns=COLUMNS)
                ends = np.r_[first[1:], len(word)]
                yield pd.DataFrame({"segment": segment, "word": word[order][first], "n": ends - first, "places": [packed(place[order[i:j]]) for i, j in zip(first, ends, strict=True)], "docs": None})

    rows = documents.select("doc_id", "text").where("doc_id is not null and text <> ''")
    return materialise(map_batches(rows, invert, INDEX), "postings")


class Windows:
    """The six-word windows of a block's passages, by their run of three words with the rarest word."""

    def __init__(self, items: list[tuple[int, np.ndarray]], counts: dict[int, int]):
        """``items``: id and hashes of the words of each passage; ``counts``: how often each word stands in the corpus."""
        self.word = np.array(sorted({w for _, ws in items for w in ws.tolist() if counts.get(w)}), dtype=np.int64)
        often = np.array([counts[w] for w in self.word.tolist()] or [0], dtype=np.int64)
        self.base = len(self.word) + 1
        steps = RUN - TERM + 1
        item, size, win, runs, rare = [], [], [], [], []
        for i, ws in items:
            num = self.number(ws)
            key = self.keys(num)
            known = np.where(num > 0, often[num - 1], 0)
            least = np.min([known[j : len(known) - TERM + 1 + j] for j in range(TERM)], axis=0)
            k = len(ws) - RUN + 1
            item.append(np.full(k, i, dtype=np.int64))
            size.append(np.full(k, len(ws)))
            win.append(np.arange(k))
            runs.append(np.stack([key[j : j + k] for j in range(steps)], axis=1))
            rare.append(np.stack([least[j : j + k] for j in range(steps)], axis=1))
        run, few = np.concatenate(runs), np.concatenate(rare)
        live = (few > 0).all(axis=1)  # a window one of whose words is nowhere has no match
        run, rarest = run[live], few[live].argmin(axis=1)
        self.run = np.unique(run)
        anchor = np.searchsorted(self.run, run[np.arange(len(run)), rarest])
        order = np.argsort(anchor, kind="stable")
        self.runs, self.rarest = np.searchsorted(self.run, run)[order].astype(np.int32), rarest[order]
        self.item, self.size, self.win = (np.concatenate(x)[live][order] for x in (item, size, win))
        self.start = np.searchsorted(anchor[order], np.arange(len(self.run) + 1))

    def number(self, ws: np.ndarray) -> np.ndarray:
        """Numbers of words, from 1; 0 for those that stand in no document or passage."""
        at = np.searchsorted(self.word, ws).clip(0, max(0, len(self.word) - 1))
        return np.where(self.word[at] == ws, at + 1, 0) if len(self.word) else np.zeros(len(ws), dtype=np.int64)

    def keys(self, num: np.ndarray) -> np.ndarray:
        """A number for each run of three words, negative if one of them has none."""
        a, b, c = (num[j : len(num) - TERM + 1 + j].astype(np.int64) for j in range(TERM))
        return np.where((a > 0) & (b > 0) & (c > 0), (a * self.base + b) * self.base + c, -1)

    def standing(self, lists: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places at which runs of the passages stand, ascending, and their numbers: lists joined at places in a row."""
        where = np.concatenate(list(lists.values()))
        num = np.repeat(self.number(np.fromiter(lists, dtype=np.int64, count=len(lists))), [len(x) for x in lists.values()])
        order = np.argsort(where)
        where, num = where[order], num[order]
        if len(where) < TERM:
            return where[:0], num[:0]
        key = np.where(where[TERM - 1 :] - where[: len(where) - TERM + 1] == TERM - 1, self.keys(num), -1)
        at = np.searchsorted(self.run, key).clip(0, max(0, len(self.run) - 1))
        ok = np.flatnonzero((key >= 0) & (self.run[at] == key)) if len(self.run) else np.zeros(0, dtype=np.int64)
        return where[ok], at[ok]

    def intersect(self, where: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places at which windows begin, and these windows."""
        n = self.start[run + 1] - self.start[run]
        hit = np.repeat(np.arange(len(run)), n)
        w = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[run], n)
        for j in range(RUN - TERM + 1):
            target = where[hit] - self.rarest[w] + j
            at = np.searchsorted(where, target).clip(0, max(0, len(where) - 1))
            same = (where[at] == target) & (run[at] == self.runs[w, j])
            hit, w = hit[same], w[same]
        return where[hit] - self.rarest[w], w


MATCHES = "doc_id long, item_id long, n_words int, win int, place long"


def block_matches(postings: DataFrame, items: list[tuple[int, list[str]]]) -> DataFrame:
    """``doc_id, item_id, n_words, wins, span``: the passage windows found in each document, and the words between first and last."""
    spark = postings.sparkSession
    hashes = Hashes()
    hashed = [(i, np.array([hashes[w] for w in ws], dtype=np.int64)) for i, ws in items]
    asked = spark.createDataFrame(pd.DataFrame({"word": sorted({w for _, ws in hashed for w in ws.tolist()})}))  # at most a block of characters
    of = postings.join(F.broadcast(asked), "word", "left_semi")
    counts = {r.word: r.n for r in of.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # one row a word of the block
    shared = spark.sparkContext.broadcast(Windows(hashed, counts))
    ship(spark)

    def match(b: pd.DataFrame) -> pd.DataFrame:
        w = shared.value
        docs = b[b["word"] == DOCS].iloc[0]
        lists = {k: unpacked(p) for k, p in zip(b["word"], b["places"], strict=True) if k != DOCS}
        where, run = w.standing(lists) if lists else (np.zeros(0, dtype=np.int64),) * 2
        place, k = w.intersect(where, run)
        doc = np.asarray(docs["docs"])[np.searchsorted(unpacked(docs["places"]), place, side="right") - 1]
        return pd.DataFrame({"doc_id": doc, "item_id": w.item[k], "n_words": w.size[k], "win": w.win[k], "place": place})

    # The lists of a segment come together; they are those of one batch of documents, so no group is large.
    found = of.unionByName(postings.where(F.col("word") == DOCS)).groupBy("segment").applyInPandas(match, MATCHES)
    span = (F.max("place") - F.min("place") + RUN).alias("span")
    return found.groupBy("doc_id", "item_id", "n_words").agg(F.collect_set("win").alias("wins"), span)


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, block: int = BLOCK, postings: DataFrame | None = None) -> DataFrame:
    """``doc_id, item_id, share, longest, span, kind`` for each document that holds at least ``share`` of an item's passage.

    ``longest`` is the longest unbroken run in words, ``span`` the words of the document from the first to the last place of the
    passage; ``kind`` is exact if the whole passage stands in one run, proximity if its parts lie within twice its length, else
    scattered. ``postings``: an ``index`` of the documents, made if None.
    """
    spark = documents.sparkSession
    tests = items.select("item_id", "passage").where("item_id is not null and passage is not null").distinct()
    blocks = max(1, -(-(tests.agg(F.sum(F.length("passage"))).first()[0] or 0) // block))
    tagged = tests.withColumn("_b", F.pmod(F.xxhash64("item_id", "passage"), F.lit(blocks)))
    out = None
    for k in range(blocks):
        split = [(r.item_id, words(r.passage)) for r in tagged.where(F.col("_b") == k).toLocalIterator()]
        split = [(i, ws) for i, ws in sorted(split) if len(ws) >= RUN]
        if split:
            postings = index(documents) if postings is None else postings
            found = block_matches(postings, split)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, n_words int, wins array<int>, span long")
    # Windows and so passage positions are bounded by the passage; runs of consecutive windows are joined.
    covered = F.expr(f"size(array_distinct(flatten(transform(wins, w -> sequence(w, w + {RUN - 1})))))")
    longest = F.expr(
        f"""aggregate(array_sort(wins), named_struct('last', -2, 'run', 0, 'best', 0),
        (a, w) -> named_struct('last', w, 'run', if(w = a.last + 1, a.run + 1, {RUN}), 'best', greatest(a.best, if(w = a.last + 1, a.run + 1, {RUN}))), a -> a.best)"""
    )
    scored = out.select("doc_id", "item_id", (covered / F.col("n_words")).alias("share"), longest.alias("longest"), "n_words", "span")
    best = scored.where(F.col("share") >= share).groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "longest", "n_words", "span")).alias("_b"))
    kind = F.when(F.col("_b.longest") == F.col("_b.n_words"), "exact").when(F.col("_b.span") <= 2 * F.col("_b.n_words"), "proximity").otherwise("scattered")
    return best.select("doc_id", "item_id", "_b.share", "_b.longest", "_b.span", kind.alias("kind"))


def leaked_items(found: DataFrame) -> DataFrame:
    """``item_id, n_docs, n_exact``: which test items leaked, and into how many documents."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("kind") == "exact").cast("long")).alias("n_exact"))
