"""Repetition inside a single document.

Each text is cut into lines (of at most ``WIDTH`` words); a linear-chain conditional random field labels each line as content or
boilerplate by Viterbi decoding, and the share of words on content lines decides on the document: those of which the field leaves
more than ``content`` are kept. Of the others the exact share follows as a check: the words that lie in runs of six or more that
occurred earlier in the same text.

The field sees of a line how much of it lies in runs of two and of three words said before, whether it was there as a whole, its
length and its place; it sees no runs of six. It is trained on the lines of a sample of documents bounded by ``sample`` (those of
the smallest hash of their text); what a line is labelled with there is weak: boilerplate if a quarter or more of its words lie in
runs of six already said.

Defined results
* a word is a maximal run of letters in any case; digits, punctuation and line breaks separate words only;
* runs may overlap, themselves too: ``a a a a a a a`` repeats six words at its second;
* null and empty texts, and texts of fewer than seven words, have a share of 0;
* documents with the same text give one row each, as do rows with the same id; null ids stay null;
* an empty table gives no rows and trains on nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import map_batches

RUN = 6
SHARE = 0.45
WIDTH = 12
SAMPLE = 2_000
#: Documents of which the field leaves at most this as content may be too repetitive.
CONTENT = 0.7
#: Share of a line's words in runs of six already said from which it is weakly labelled boilerplate.
WEAK = 0.25
WORD = re.compile(r"[^\W\d_]+")
#: Feature classes of a line: share of its words said before in runs of three, in runs of two, seen as a whole, length, place.
SHAPES = (8, 4, 2, 3, 3)


class Batch:
    """The words of many texts in one array, with the ends of texts and lines."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        parts, ends, lines = [], [], []
        total = 0
        for text in texts:
            ws: list[str] = []
            for line in text.lower().split("\n"):
                got = WORD.findall(line)
                if got:
                    cut = range(total + len(ws) + WIDTH, total + len(ws) + len(got), WIDTH)
                    ws += got
                    lines.extend(cut)
                    lines.append(total + len(ws))
            for w in ws:
                if w not in number:
                    number[w] = len(number) + 1
            parts.append(np.fromiter(map(number.__getitem__, ws), dtype=np.uint64, count=len(ws)))
            total += len(ws)
            ends.append(total)
        self.n_docs = len(texts)
        self.word = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.end = np.array(ends, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, self.end]))
        self.line_end = np.array(lines, dtype=np.int64)

    def said(self, run: int) -> np.ndarray:
        """Per word: does it lie in a run of ``run`` words that began earlier in the same text?"""
        n = len(self.word)
        out = np.zeros(n, dtype=bool)
        if n < run:
            return out
        m = n - run + 1
        key = self.doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(run):
            key = (key ^ self.word[j : j + m]) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(29)
        whole = np.flatnonzero(self.doc[:m] == self.doc[run - 1 :])
        order = np.argsort(key[whole], kind="stable")  # equal keys stay in text order
        sk = key[whole][order]
        again = whole[order[1:][sk[1:] == sk[:-1]]]
        mark = np.zeros(n + 1, dtype=np.int32)
        np.add.at(mark, again, 1)
        np.add.at(mark, again + run, -1)
        return np.cumsum(mark[:-1]) > 0

    def only(self, keep: np.ndarray) -> Batch:
        """The texts marked in ``keep``."""
        out = Batch([])
        n = np.diff(np.r_[0, self.end])
        out.n_docs, out.end, out.word = int(keep.sum()), np.cumsum(n[keep]), self.word[keep[self.doc]]
        out.doc = np.repeat(np.arange(out.n_docs), n[keep])
        return out

    def shares(self) -> np.ndarray:
        """Exact share of words already said, of each text."""
        said = np.bincount(self.doc[self.said(RUN)], minlength=self.n_docs)
        return said / np.maximum(1, np.diff(np.r_[0, self.end]))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each line: its text, its number of words and its feature class."""
        start, size = self._starts()
        doc = self.doc[start] if len(start) else np.zeros(0, dtype=np.int64)
        three, two = self._mean(self.said(3)), self._mean(self.said(2))
        key = np.zeros(len(start), dtype=np.uint64)
        if len(start):
            mixed = (self.word * np.uint64(0x9E3779B97F4A7C15)) ^ ((np.arange(len(self.word)) - np.repeat(start, size)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            key = np.add.reduceat(mixed, start) ^ (doc.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        order = np.argsort(key, kind="stable")
        whole = np.zeros(len(start), dtype=np.int64)
        whole[order[1:][key[order][1:] == key[order][:-1]]] = 1
        place = np.zeros(len(start), dtype=np.int64)
        if len(start):
            first = np.r_[True, doc[1:] != doc[:-1]]
            place = np.where(first, 0, np.where(np.r_[first[1:], True], 2, 1))
        f = (np.ceil(three * 6).astype(int) + (three >= 1), np.ceil(two * 3).astype(int), whole, np.digitize(size, [4, 10]), place)
        code = np.zeros(len(start), dtype=np.int64)
        for values, shape in zip(f, SHAPES, strict=True):
            code = code * shape + np.minimum(values, shape - 1)
        return doc, size, code

    def weak(self) -> np.ndarray:
        """Weak labels of the lines: is a quarter or more of their words already said?"""
        return self._mean(self.said(RUN)) >= WEAK

    def _starts(self) -> tuple[np.ndarray, np.ndarray]:
        start = np.r_[0, self.line_end[:-1]] if len(self.line_end) else np.zeros(0, dtype=np.int64)
        return start, self.line_end - start

    def _mean(self, x: np.ndarray) -> np.ndarray:
        start, size = self._starts()
        return np.add.reduceat(x.astype(float), start) / size if len(start) else np.zeros(0)


def _columns(code: np.ndarray) -> np.ndarray:
    """One-hot features of line classes, with a constant."""
    out, at = np.zeros((len(code), sum(SHAPES) + 1)), sum(SHAPES)
    out[:, at] = 1
    rest = code.copy()
    for shape in reversed(SHAPES):
        at -= shape
        out[np.arange(len(code)), at + rest % shape] = 1
        rest //= shape
    return out


class Field:
    """Linear-chain conditional random field with the labels content (0) and boilerplate (1)."""

    def __init__(self) -> None:
        self.w = np.zeros(sum(SHAPES) + 1)  # score of boilerplate against content
        self.w[0], self.w[1 : SHAPES[0]] = -2.0, 2.0
        self.t = np.zeros((2, 2))

    def emission(self, code: np.ndarray) -> np.ndarray:
        return _columns(code) @ self.w

    def fit(self, doc: np.ndarray, code: np.ndarray, y: np.ndarray, steps: int = 60, rate: float = 0.5, l2: float = 1e-3) -> Field:
        """Gradient ascent on the conditional likelihood; forward and backward run over all texts at once."""
        if not len(code):
            return self
        x, y = _columns(code), y.astype(int)
        at, n = _places(doc)
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[pair], y[pair + 1]), 1)
        steps_at = [np.flatnonzero(at == k) for k in range(n)]
        last = np.r_[doc[1:] != doc[:-1], True]
        for _ in range(steps):
            e = np.c_[np.zeros(len(code)), x @ self.w]
            f, b = e.copy(), np.zeros_like(e)
            for k in range(1, n):
                i = steps_at[k]
                f[i] += np.logaddexp(f[i - 1, :1] + self.t[0], f[i - 1, 1:] + self.t[1])
            for k in range(n - 2, -1, -1):
                i = steps_at[k][~last[steps_at[k]]]
                g = e[i + 1] + b[i + 1]
                b[i] = np.logaddexp(g[:, :1] + self.t[:, 0], g[:, 1:] + self.t[:, 1])
            m = f + b
            p = 1 / (1 + np.exp(np.clip(m[:, 0] - m[:, 1], -30, 30)))
            z = np.logaddexp(m[:, 0], m[:, 1])
            joint = f[pair][:, :, None] + self.t[None] + (e + b)[pair + 1][:, None, :] - z[pair][:, None, None]
            self.w += rate * (x.T @ (y - p) / len(y) * 4 - l2 * self.w)
            self.t += rate * ((seen - np.exp(joint).sum(axis=0)) / max(1, len(pair)) - l2 * self.t)
        return self

    def decode(self, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines; the steps run over all texts of the batch at once."""
        if not len(code):
            return np.zeros(0, dtype=int)
        at, n = _places(doc)
        e = np.c_[np.zeros(len(code)), self.emission(code)]
        best, back = e.copy(), np.zeros((len(code), 2), dtype=np.int8)
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(n + 1))
        for k in range(1, n):
            i = order[cuts[k] : cuts[k + 1]]
            a, b = best[i - 1, :1] + self.t[0], best[i - 1, 1:] + self.t[1]
            back[i] = b > a
            best[i] += np.maximum(a, b)
        y = (best[:, 1] > best[:, 0]).astype(int)
        last = np.r_[doc[1:] != doc[:-1], True]
        for k in range(n - 2, -1, -1):
            i = order[cuts[k] : cuts[k + 1]]
            i = i[~last[i]]
            y[i] = back[i + 1, y[i + 1]]
        return y


def _places(doc: np.ndarray) -> tuple[np.ndarray, int]:
    """Place of each line in its text, and one more than the greatest."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    at = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    return at, int(at.max()) + 1


def train(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """The field from at most ``sample`` documents, of which line classes and weak labels reach the driver, no texts."""
    rows = documents.select("text").where("text <> ''").withColumn("_h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    # Hashes are even over 0..2^63, so a little more than the sample lies below this and no task returns more than its part of it.
    below = min(1.0, (1.2 * sample + 200) / max(1, documents.count())) * (2**63 - 1)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            batch = Batch(list(b["text"]))
            doc, _, code = batch.lines()
            y = batch.weak()
            cut = np.searchsorted(doc, np.arange(len(b) + 1))
            yield pd.DataFrame({"h": b["_h"], "code": [code[i:j].astype(np.int16).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], "y": [y[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]})

    few = map_batches(rows.where(F.col("_h") <= F.lit(min(int(below), 2**63 - 1))), label, "h long, code binary, y binary").orderBy("h", "code").limit(sample).collect()
    codes = [np.frombuffer(r.code, dtype=np.int16) for r in few]
    if not codes:
        return Field()
    doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    return Field().fit(doc, np.concatenate(codes).astype(np.int64), np.concatenate([np.frombuffer(r.y, dtype=bool) for r in few]))


def repetition(documents: DataFrame, field: Field | None = None, sample: int = SAMPLE, content: float = CONTENT) -> DataFrame:
    """``doc_id, n_words, content_share, checked, repeated_share`` of every document.

    ``content_share`` is what the field labels as content; ``repeated_share`` is exact, and null where that is over ``content``.
    """
    model = documents.sparkSession.sparkContext.broadcast(field or train(documents, sample))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            batch = Batch(texts)
            doc, size, code = batch.lines()
            y = model.value.decode(doc, code)
            n = np.diff(np.r_[0, batch.end])
            kept = np.bincount(doc, weights=size * (y == 0), minlength=len(texts))
            content_share = np.where(n > 0, kept / np.maximum(1, n), 1.0)
            checked = content_share <= content
            exact = np.full(len(texts), np.nan)
            exact[checked] = batch.only(checked).shares()
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "n_words": n, "content_share": content_share, "checked": checked, "repeated_share": exact})

    rows = documents.select("doc_id", "text")
    out = map_batches(rows, measure, "doc_id long, n_words long, content_share double, checked boolean, repeated_share double")
    return out.withColumn("repeated_share", F.when(F.col("checked"), F.col("repeated_share")))


def repetitive(documents: DataFrame, share: float = SHARE, **options) -> DataFrame:
    """``repetition`` of the documents that the field leaves too little of and of which at least ``share`` is already said."""
    return repetition(documents, **options).where(F.col("checked") & (F.col("repeated_share") >= share))
