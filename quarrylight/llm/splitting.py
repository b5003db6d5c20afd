"""Splitting oversized items at natural boundaries by pointer doubling.

Every boundary of a text points to its farthest legal successor: the last boundary whose piece, begun ``overlap`` characters
before, still fits the limit. Squaring the successor table marks all greedy cuts in log2(n) vector steps instead of a walk.

Boundaries are line ends; where two of them lie too far apart, blanks within the line; where these do, places between
characters. A piece is cut inside a line only if no line end lies within reach, and inside a word only if no blank does.

Defined results
* items up to the limit give one piece, themselves; a null content gives none;
* an empty content gives one empty piece;
* a null ``start_line`` counts as 1; ``end_line`` is counted from the content, so a null one does no harm;
* identical repeated rows give their pieces once; ids that are null stay null;
* characters are never cut, so pieces decode by themselves; CRLF stays together;
* an empty table gives no piece; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylight.session import map_batches

LIMIT = 10_240
OVERLAP = 200

PIECES = "id string, file_id long, rel_path string, ext string, piece int, content string, start_line int, end_line int, metadata string, first_byte long, end_byte long"


def _fill(bounds: np.ndarray, more: np.ndarray, gap: int) -> np.ndarray:
    """``bounds`` with those of ``more`` that lie in spaces wider than ``gap``."""
    wide = np.flatnonzero(np.diff(bounds) > gap)
    if not len(wide) or not len(more):
        return bounds
    at = np.searchsorted(bounds, more, side="left") - 1
    inside = np.isin(at, wide) & (more != bounds[np.minimum(at + 1, len(bounds) - 1)])
    return np.union1d(bounds, more[inside])


def boundaries(raw: np.ndarray, gap: int) -> np.ndarray:
    """Byte offsets at which ``raw`` may be cut, the start and the end among them, none more than ``gap`` from the next."""
    n = len(raw)
    ends = np.union1d(np.flatnonzero(raw == 10) + 1, [0, n])
    ends = _fill(ends, np.flatnonzero((raw == 32) | (raw == 9)) + 1, gap)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)  # of characters
    starts = starts[(starts == 0) | (raw[starts] != 10) | (raw[np.maximum(starts - 1, 0)] != 13)]
    step = max(1, gap // 8)
    return _fill(ends, starts[np.unique(np.searchsorted(starts, np.arange(0, n, step)).clip(0, len(starts) - 1))], gap)


def begins(raw: np.ndarray, bounds: np.ndarray, overlap: int) -> np.ndarray:
    """Where a piece that continues at each boundary begins: ``overlap`` characters before, or at a line start near that."""
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    nth = np.searchsorted(chars, bounds)
    near, far = chars[np.maximum(nth - overlap * 4 // 5, 0).clip(0, len(chars) - 1)], chars[np.maximum(nth - overlap * 6 // 5, 0)]
    exact = chars[np.maximum(nth - overlap, 0)]
    back = (exact > 0) & (raw[exact] == 10) & (raw[np.maximum(exact - 1, 0)] == 13)
    exact = exact - back
    lines = np.r_[0, np.flatnonzero(raw == 10) + 1]
    line = lines[np.searchsorted(lines, near, side="right") - 1]
    out = np.where((line >= far) & (line <= near) & (line < bounds), line, exact)
    out[bounds == 0] = 0
    return out


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Byte spans of the pieces of ``text``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(raw)
    if n <= limit:
        return [(0, n)]
    bounds = boundaries(raw, max(8, (limit - overlap * 5) // 4))
    start = begins(raw, bounds, overlap) if overlap else bounds.copy()
    k = len(bounds)
    succ = np.searchsorted(bounds, start + limit, side="right") - 1
    succ = np.where(np.arange(k) == k - 1, k - 1, np.minimum(succ, k - 1))
    if (succ[:-1] <= np.arange(k - 1)).any():
        raise ValueError("a boundary has no legal successor")
    marked = np.zeros(k, dtype=bool)
    marked[0] = True
    for _ in range(max(1, int(k - 1).bit_length())):
        marked[succ[marked]] = True  # all cuts up to 2^i steps from the start
        succ = succ[succ]
    cuts = np.flatnonzero(marked)
    return [(int(start[a]), int(bounds[b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    return chunks.where(F.octet_length("content") > limit)


def split_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each row of ``chunks``; ``piece`` counts from 0 within the row, bytes are those of its content."""
    if overlap < 0 or limit < 5 * overlap + 64:
        raise ValueError("the limit has to be at least 5 times the overlap, whose characters take up to 4 bytes, plus 64 bytes")
    wanted = ["id", "file_id", "rel_path", "ext", "start_line", "content", "metadata"]

    def cut_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                raw = r.content.encode("utf-8", "surrogatepass")
                first = 1 if pd.isna(r.start_line) else int(r.start_line)
                for i, (s, e) in enumerate(cut(r.content, limit, overlap)):
                    line = first + raw.count(b"\n", 0, s)
                    last = line + raw.count(b"\n", s, max(s, e - 1))
                    out.append((r.id, None if pd.isna(r.file_id) else int(r.file_id), r.rel_path, r.ext, i, raw[s:e].decode("utf-8", "surrogatepass"), line, last, r.metadata, s, e))
            got = pd.DataFrame(out, columns=["id", "file_id", "rel_path", "ext", "piece", "content", "start_line", "end_line", "metadata", "first_byte", "end_byte"])
            got["file_id"] = got["file_id"].astype("Int64")
            yield got

    rows = chunks.select(*wanted).where("content is not null")
    return map_batches(rows, cut_all, PIECES)


def distinct_rows(chunks: DataFrame) -> DataFrame:
    """Identical repeated rows once; rows are compared by id and a hash, so the texts stay where they are read from."""
    key = F.sha2(F.to_json(F.struct("id", "rel_path", "start_line", "content")), 256)  # which leaves out nulls with their names
    return chunks.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")


def checks(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id, n_bytes, fits, covers, overlaps`` of each item that was cut: is no piece over the limit, do they cover the item, and
    does each begin with about ``overlap`` characters of the one before?"""
    w = W.partitionBy("id").orderBy("piece")
    rows = pieces
    before = F.lag("content").over(w)
    shared = F.lag("end_byte").over(w) - F.col("first_byte")
    # the overlap in characters: those of the piece's first ``shared`` bytes
    said = F.length(F.decode(F.substring(F.encode("content", "UTF-8"), F.lit(1), shared.cast("int")), "UTF-8"))
    rows = rows.select(
        "id", "end_byte", (F.octet_length("content") <= limit).alias("fits"),
        F.when(F.col("piece") == 0, F.col("first_byte") == 0).otherwise((shared >= 0) & (F.col("end_byte") > F.lag("end_byte").over(w))).alias("covers"),
        F.when(F.col("piece") == 0, True).otherwise(said.between(overlap * 4 // 5, overlap * 6 // 5) & before.endswith(F.decode(F.substring(F.encode("content", "UTF-8"), F.lit(1), shared.cast("int")), "UTF-8"))).alias("overlaps"),
    )
    return rows.groupBy("id").agg(F.max("end_byte").alias("n_bytes"), F.bool_and("fits").alias("fits"), F.bool_and("covers").alias("covers"), F.bool_and("overlaps").alias("overlaps"))
