"""Oversized texts cut into pieces at natural boundaries, with an overlap.

Boundaries are found where the lexical cohesion is least: the text's units (between two
possible cuts) become rows of hashed word counts, blocks of units slide over them as
differences of prefix sums, the cosine between the block before and the block behind a cut
makes a curve, and a cut's depth is how far its valley lies under the hills around it.  In
each size window the deepest valley wins among the ends of paragraphs and sentences; only
where there is none a line end is taken, then a blank.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units in a sliding block, hashed word dimensions, units per slab of the curve.
BLOCK, DIMENSIONS, SLAB = 6, 128, 1 << 14
#: Demands of one text that are served together.
GROUP = 256
#: A window reaches from this share of the budget up to the budget.
FILLED = 0.5

PARAGRAPH, SENTENCE, LINE, BLANK, HARD = 5, 4, 3, 2, 1
_CUT = re.compile(r"\n[^\S\n]*\n\s*|(?<=[.!?…])[\"'”’»)\]]*\s+|[。！？।؟][”’」』）]*\s*|\n|\s+")
_WORD = re.compile(r"\w+")


class _Dimensions(dict):
    """Words to their hashed dimensions, remembered within a worker."""

    def __missing__(self, word: str) -> int:
        value = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % DIMENSIONS
        return value


_DIMENSION_OF = _Dimensions()


def possible_cuts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, kinds) of the natural boundaries inside a text; a cut falls behind its blanks."""
    at, kind = [], []
    for m in _CUT.finditer(text):
        if m.end() in (0, len(text)) or m.start() == 0:
            continue
        found = m[0]
        breaks = found.count("\n")
        if breaks >= 2:
            k = PARAGRAPH
        elif not found.isspace() or text[m.start() - 1] in ".!?…":
            k = SENTENCE
        else:
            k = LINE if breaks else BLANK
        at.append(m.end())
        kind.append(k)
    return np.array(at, np.int64), np.array(kind, np.int8)


def valley_depths(text: str, cuts: np.ndarray) -> np.ndarray:
    """Depth of the cohesion valley at each cut (units are what lies between the cuts)."""
    if not len(cuts):
        return np.zeros(0)
    bounds = np.concatenate([[0], cuts, [len(text)]])
    similar = np.zeros(len(cuts))
    known = _DIMENSION_OF
    if len(known) > 200_000:
        known.clear()
    for begin in range(0, len(cuts), SLAB):
        end = min(begin + SLAB, len(cuts))
        first, last = max(0, begin - BLOCK), min(len(bounds) - 1, end + 1 + BLOCK)
        base, wide = bounds[first], last - first + 1
        found = [(m.start(), known[m[0]]) for m in _WORD.finditer(text, int(base), int(bounds[last])) if m.end() - m.start() > 2 or not m[0].isascii()]
        at, dimension = np.array(found, np.int64).reshape(-1, 2).T
        rows = np.searchsorted(bounds, at, "right") - first
        counts = np.bincount(rows * DIMENSIONS + dimension, minlength=wide * DIMENSIONS)[: wide * DIMENSIONS].reshape(wide, DIMENSIONS).astype(np.float32)
        total = np.cumsum(counts, axis=0)
        here = np.arange(begin + 1, end + 1) - first
        left = total[here] - total[np.maximum(here - BLOCK, 0)]
        right = total[np.minimum(here + BLOCK, len(total) - 1)] - total[here]
        norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        similar[begin:end] = np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-9), 0)
    reach = 2 * BLOCK
    padded = np.pad(similar, reach, mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, reach + 1)
    hill_left, hill_right = windows[: len(similar)].max(axis=1), windows[reach:reach + len(similar)].max(axis=1)
    return hill_left + hill_right - 2 * similar


class Cutter:
    """A text's cuts and their depths, used for any number of budgets."""

    def __init__(self, text: str):
        self.text = text
        cuts, kinds = possible_cuts(text)
        # The curve runs over sentences; within a sentence words and lines have no topic.
        topical = kinds >= SENTENCE
        depth = np.zeros(len(cuts))
        depth[topical] = valley_depths(text, cuts[topical])
        self.cuts, self.kinds, self.depth = cuts, kinds, depth

    def pieces(self, budget: int | None, overlap: int | None) -> list[tuple[int, int]]:
        """(begin, end) of the pieces: each at most ``budget`` long, each beginning
        ``overlap`` characters before the end of the one before."""
        size = len(self.text)
        if budget is None or budget < 1 or size <= budget:
            return [(0, size)]
        shared = min(max(overlap or 0, 0), budget - 1)
        out, begin = [], 0
        while size - begin > budget:
            least = begin + shared + 1
            low = max(least, begin + int(budget * FILLED))
            high = begin + budget
            cut = self._best(low, high) or self._best(least, low - 1) or high
            out.append((begin, cut))
            begin = cut - shared
        out.append((begin, size))
        return out

    def _best(self, low: int, high: int) -> int | None:
        i, j = np.searchsorted(self.cuts, [low, high + 1])
        if i >= j:
            return None
        kinds = self.kinds[i:j]
        # Of equal depth the better kind holds, then the longer piece.
        best = np.lexsort((self.cuts[i:j], kinds, self.depth[i:j], np.minimum(kinds, SENTENCE)))[-1]
        return int(self.cuts[i + best])


def cut_texts(texts: DataFrame, demands: DataFrame, key: str, text: str, demand: str, budget: str, overlap: str) -> DataFrame:
    """Pieces of each demand's text: ``demand, piece_no, pieces, piece_begin, piece_end, piece``.

    ``texts`` has one row per ``key``; ``demands`` says for each ``demand`` id which key's
    text is cut to which ``budget`` with which ``overlap``.  A text within the budget is one
    piece, an empty text one empty piece; a null or missing text has no rows.  A null budget
    or one under 1 asks for no cutting; a null or negative overlap is 0, one as large as the
    budget is made one less.  A piece is longer than its budget in no case.
    """
    held = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null and _text is not null")
    # The demands of a text travel as arrays of about GROUP, so a text moves and is measured
    # once for so many of them, and no task holds all demands of a text asked for a million
    # times.
    wanted = demands.select(F.col(key).alias("_key"), F.struct(F.col(demand).cast("bigint").alias("d"), F.col(budget).cast("bigint").alias("b"), F.col(overlap).cast("bigint").alias("o")).alias("_a"), F.xxhash64(demand).alias("_hash")).where("_key is not null")
    groups = wanted.groupBy("_key").agg(F.ceil(F.count("*") / GROUP).alias("_groups"))
    salted = wanted.join(groups, "_key").withColumn("_salt", F.pmod("_hash", "_groups"))
    asked = salted.groupBy("_key", "_salt").agg(F.collect_list("_a").alias("_asked")).drop("_salt")
    joined = held.join(asked, "_key").select("_text", "_asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, wanted in zip(batch.column(0), batch.column(1)):
                cutter = Cutter(whole.as_py())
                for one in wanted.as_py():
                    spans = cutter.pieces(one["b"], one["o"])
                    for begin in range(0, len(spans), 4096):
                        part = spans[begin:begin + 4096]
                        n = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([one["d"]] * n, pa.int64()), pa.array(range(begin, begin + n), pa.int32()), pa.array([len(spans)] * n, pa.int32()),
                                pa.array([s[0] for s in part], pa.int32()), pa.array([s[1] for s in part], pa.int32()), pa.array([cutter.text[a:b] for a, b in part], pa.string()),
                            ],
                            names=["demand", "piece_no", "pieces", "piece_begin", "piece_end", "piece"],
                        )

    return joined.mapInArrow(run, "demand bigint, piece_no int, pieces int, piece_begin int, piece_end int, piece string").withColumnRenamed("demand", demand)
