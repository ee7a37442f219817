"""Evaluation texts inside training text, also in part and slightly changed.

The items are cut into windows of units (words, or ideographs and digits): windows as long
as the least passage that counts, and item-sized ones.  Each window has a 64-bit SimHash,
indexed in as many blocks as the radius has bits and one more, so that any fingerprint within
the radius agrees in at least one block.  Every window of every document is looked up in that
multi-index; fingerprints within the radius are candidates, and the texts decide: a passage
is leaked if its units are equal, and an item-sized window is similar if the weighted
shingles of the two are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units of the least passage that counts as leaked.
WORDS, IDEOGRAPHS = 12, 20
#: Bits that fingerprints of passages, and of item-sized windows, may differ in.  A word more or
#: less among 48 turns 3.6 bits of 64 on the average, and more than seven in three cases of 100.
RADIUS, WIDE_RADIUS = 3, 7
#: Lengths of item-sized windows; an item goes by the largest it can fill.
SIZES = (12, 24, 48, 96, 192, 384)
#: Words of a shingle, and the weighted similarity from which windows count as similar.
SHINGLE, SIMILAR = 5, 0.8
#: Windows of items that one pass over the corpus looks for; more items get further passes.
SLICE_WINDOWS = 1 << 20
SLAB_UNITS = 1 << 16

_TAG = re.compile(r"<[^<>]*>|\[[^\[\]]*\]")
_WORD = re.compile(r"[^\W_]+")
_IDEOGRAPH = re.compile(r"[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]|\d")


def words_of(text: str) -> list[str]:
    return _WORD.findall((_TAG.sub(" ", text) if "<" in text or "[" in text else text).lower())


def ideographs_of(text: str) -> list[str]:
    return _IDEOGRAPH.findall(_TAG.sub(" ", text) if "<" in text or "[" in text else text)


class Hasher(dict):
    """Units to 64-bit hashes, remembered within a worker."""

    def __init__(self, memory: int = 500_000):
        super().__init__()
        self.memory = memory

    def __missing__(self, unit: str) -> int:
        value = self[unit] = xxhash.xxh64_intdigest(unit)
        return value

    def __call__(self, units: list[str]) -> np.ndarray:
        if len(self) > self.memory:
            self.clear()
        return np.fromiter(map(self.__getitem__, units), np.uint64, len(units))


def fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of each window of ``width`` units (by running sums of the bits' votes)."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Sums may run over; their differences, which are at most the width, come out right.
    total = np.zeros((len(hashes) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=total[1:])
    votes = total[width:] - total[:-width]
    return np.packbits(votes > width // 2, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


class Windows:
    """The multi-index over the items' windows of one kind of unit and one width."""

    def __init__(self, items: list[tuple[int, list[str]]], width: int, hasher: Hasher, radius: int = RADIUS, step: int = 1):
        self.width, self.radius = width, radius
        self.units: list[str] = []
        starts, owners, prints = [], [], []
        for item, units in items:
            last = len(units) - width
            if last < 0:
                continue
            at = np.unique(np.append(np.arange(0, last + 1, step), last))
            starts.append(len(self.units) + at)
            owners.append(np.full(len(at), item, np.int64))
            prints.append(fingerprints(hasher(units), width)[at])
            self.units += units
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.owner, self.print = join(starts, np.int64), join(owners, np.int64), join(prints, np.uint64)
        # Of radius + 1 blocks one holds no changed bit.
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            mask = (1 << int(high - low)) - 1
            value = (self.print >> np.uint64(low)) & np.uint64(mask)
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.uint64(low), np.uint64(mask), order, np.searchsorted(value[order], np.arange(mask + 2, dtype=np.uint64))))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all pairs within the radius."""
        found = []
        for low, mask, order, table in self.blocks:
            value = ((prints >> low) & mask).astype(np.int64)
            first, many = table[value], table[value + 1] - table[value]
            source = np.repeat(np.arange(len(prints)), many)
            place = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many)
            mate = order[np.repeat(first, many) + place]
            near = np.bitwise_count(prints[source] ^ self.print[mate]) <= self.radius
            found.append(source[near] * len(self.print) + mate[near])
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return both // max(len(self.print), 1), both % max(len(self.print), 1)

    def item_units(self, window: int) -> list[str]:
        at = int(self.start[window])
        return self.units[at:at + self.width]


def shingles(units: list[str]) -> Counter:
    return Counter(" ".join(units[k:k + SHINGLE]) for k in range(len(units) - SHINGLE + 1))


def weighted_similarity(a: Counter, b: Counter, weight) -> float:
    """Weight of the shingles that both have, over that of the heavier one."""
    total = lambda c: sum(n * weight(s) for s, n in c.items())
    heavier = max(total(a), total(b))
    return total(a & b) / heavier if heavier else 0.0


Item = tuple[int, str, bool]


def _slices(items: DataFrame, item_key: str, item_text: str, item_lang: str) -> list[list[Item]]:
    held = items.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t"), F.col(item_lang).alias("l")).where("i is not null and t is not null").dropDuplicates(["i"]).orderBy("i")
    slices: list[list[Item]] = [[]]
    room = SLICE_WINDOWS
    for row in held.toLocalIterator():
        if room < len(row.t) and slices[-1]:
            slices.append([])
            room = SLICE_WINDOWS
        slices[-1].append((row.i, row.t, (row.l or "").lower().startswith("zh")))
        room -= len(row.t)
    return slices


def _searched(docs: DataFrame, doc_key: str, doc_text: str, slices: list[list[Item]], search, schema: str) -> DataFrame:
    """``search`` of each slice over all documents: one pass for a slice."""
    narrow = docs.select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    context = docs.sparkSession.sparkContext
    result = None
    for part in slices:
        found = narrow.mapInArrow(search(context.broadcast(part)), schema)  # as large as a slice
        result = found if result is None else result.unionByName(found)
    return result


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", item_lang: str = "lang", words: int = WORDS, ideographs: int = IDEOGRAPHS) -> DataFrame:
    """Documents with a passage of an item: ``doc_id, item_id``, each pair once.

    A passage is ``words`` consecutive words of the item, or for an item whose language is
    Chinese ``ideographs`` consecutive ideographs and digits; tags are blanks, punctuation
    and case count for nothing, whole texts are searched.  A passage that several items
    share counts for each; equal items all count.  Null or empty texts and items shorter
    than a passage have no rows.

    The items (a benchmark, far smaller than a corpus) are read on the driver in slices of
    bounded size.  A slice is one pass over the corpus: 120 items are a tenth of a slice, and
    any number of items is searched with bounded memory.
    """

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            kinds = []
            for units_of, width, chinese in ((words_of, words, False), (ideographs_of, ideographs, True)):
                kinds.append((units_of, [Windows([(i, units_of(t)) for i, t, zh in shared.value if zh == chinese], width, hasher)]))
            for keys, found in _hits(batches, kinds, hasher):
                pairs = {(doc, int(index.owner[mate])) for doc, index, mate, units in found if units == index.item_units(mate)}
                if pairs:
                    docs_, items_ = zip(*pairs)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in docs_], pa.int64()), pa.array(items_, pa.int64())], names=["doc_id", "item_id"])

        return run

    slices = _slices(items, item_key, item_text, item_lang)
    return _searched(docs, doc_key, doc_text, slices, search, "doc_id bigint, item_id bigint").dropDuplicates(["doc_id", "item_id"])


def find_similar(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", item_lang: str = "lang", least: float = SIMILAR) -> DataFrame:
    """Documents with an item-sized window that is like one of an item, changed words and all:
    ``doc_id, item_id, similarity``, the greatest of each pair.

    Windows are as long as the largest of SIZES that the item fills, and an eighth of that
    apart in the item.  The similarity is that of their weighted shingles of five units; a
    shingle weighs the more the fewer items have it.  Items shorter than the least size have
    no rows; nulls, case, tags and punctuation are as in find_leaks().
    """

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            kinds, spread, known = [], Counter(), 0
            for units_of, chinese in ((words_of, False), (ideographs_of, True)):
                sized: dict[int, list] = {}
                for i, t, zh in shared.value:
                    if zh == chinese:
                        units = units_of(t)
                        known += 1
                        spread.update(set(shingles(units)))
                        size = max((s for s in SIZES if s <= len(units)), default=None)
                        if size:
                            sized.setdefault(size, []).append((i, units))
                kinds.append((units_of, [Windows(own, size, hasher, WIDE_RADIUS, size // 8) for size, own in sorted(sized.items())]))
            weight = lambda s: 1 + math.log((1 + known) / (1 + spread[s]))
            for keys, found in _hits(batches, kinds, hasher):
                best: dict[tuple[int, int], float] = {}
                for doc, index, mate, units in found:
                    share = weighted_similarity(shingles(units), shingles(index.item_units(mate)), weight)
                    pair = doc, int(index.owner[mate])
                    if share >= least and share > best.get(pair, 0):
                        best[pair] = share
                if best:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d, _ in best], pa.int64()), pa.array([i for _, i in best], pa.int64()), pa.array(best.values(), pa.float64())], names=["doc_id", "item_id", "similarity"])

        return run

    slices = _slices(items, item_key, item_text, item_lang)
    found = _searched(docs, doc_key, doc_text, slices, search, "doc_id bigint, item_id bigint, similarity double")
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def _hits(batches: Iterator[pa.RecordBatch], kinds: list, hasher: Hasher) -> Iterator[tuple[list, Iterator]]:
    """Per batch its keys and the candidates: (document, index, item window, units)."""
    for batch in batches:
        yield batch.column(0).to_pylist(), _candidates(batch.column(1).to_pylist(), kinds, hasher)


def _candidates(texts: list[str], kinds: list, hasher: Hasher) -> Iterator[tuple[int, Windows, int, list[str]]]:
    for units_of, indexes in kinds:
        indexes = [index for index in indexes if len(index.print)]
        begin = 0
        while begin < len(texts) and indexes:
            units, ends, end = [], [], begin
            while end < len(texts) and len(units) < SLAB_UNITS:
                units += units_of(texts[end])
                ends.append(len(units))
                end += 1
            hashes, edges = hasher(units), np.array(ends)
            for index in indexes:
                width = index.width
                for at in range(0, max(len(hashes) - width + 1, 0), SLAB_UNITS):
                    window, mate = index.candidates(fingerprints(hashes[at:at + SLAB_UNITS + width - 1], width))
                    window = window + at
                    doc = np.searchsorted(edges, window, "right")
                    inside = window + width <= edges[np.minimum(doc, len(edges) - 1)]  # none across two documents
                    for w, m, d in zip(window[inside].tolist(), mate[inside].tolist(), doc[inside].tolist()):
                        yield begin + d, index, m, units[w:w + width]
            begin = end
