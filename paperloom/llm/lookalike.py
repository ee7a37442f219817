"""One form for text that looks the same and is stored with different characters.

Works on whole Arrow batches: the characters of all rows become one numpy array of code
points, a lookup table gives each its replacement (a gather), replacements of several
characters are laid out by expansion offsets, combining marks are put in canonical order
by one stable sort and composed pair by pair with sorted lookups.  No string is touched
row by row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpointed

# Cyrillic and Greek letters drawn like Latin ones, and those Latin ones.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХҺԚԜаеіјорсухѕһԁԛԝӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυϲϳ" "Ғӓӧ",
    "ABESIJKMHOPCTYXhQWaeijopcyxshdqwl" "ABEZHIKMNOPTYXaivopucj" "Fäö",
))
# Characters drawn as a hyphen (dashes are longer and stay).
HYPHENS = "‐‑－﹣⁃˗"
# Compatibility kinds whose two forms are drawn alike.
ALIKE_KINDS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
LIGATURES = range(0xFB00, 0xFB50)
# Invisible characters outside the format category.
INVISIBLE = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
SLAB_BYTES = 16 << 20
TOP = 0x110000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """(count, offset, flat replacements, combining class, pair keys, pair results)."""
    count = np.ones(TOP, np.uint8)
    offset = np.arange(TOP, dtype=np.int32)
    classes = np.zeros(TOP, np.uint8)
    pairs: dict[int, int] = {}
    special: dict[int, list[int]] = {}

    def expanded(char: str) -> str:
        """Full decomposition by canonical steps and those kinds that are drawn alike."""
        if char in LOOKALIKES:
            return expanded(LOOKALIKES[char])
        parts = unicodedata.decomposition(char).split()
        if not parts:
            return char
        if parts[0][0] == "<":
            if not (parts[0] in ALIKE_KINDS or parts[0] == "<compat>" and ord(char) in LIGATURES):
                return char
            parts = parts[1:]
        return "".join(expanded(chr(int(p, 16))) for p in parts)

    for code in (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)):
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Cn" and code not in INVISIBLE:
            continue
        ccc = unicodedata.combining(char)
        if ccc:
            classes[code] = ccc
        if category == "Cf" and code not in (0x0600, 0x0601, 0x0602, 0x0603, 0x06DD, 0x070F) or code in INVISIBLE:
            special[code] = []
        elif category == "Zs":
            special[code] = [0x20]
        elif char in HYPHENS:
            special[code] = [0x2D]
        elif 0xAC00 <= code < 0xD7A4:
            special[code] = [ord(x) for x in unicodedata.normalize("NFD", char)]
        else:
            whole = expanded(char)
            whole = "".join(" " if unicodedata.category(x) == "Zs" else "-" if x in HYPHENS else x for x in whole)
            if whole != char:
                special[code] = [ord(x) for x in unicodedata.normalize("NFD", whole)]
        canonical = unicodedata.decomposition(char)
        if canonical and canonical[0] != "<" and unicodedata.normalize("NFC", char) == char:
            both = unicodedata.normalize("NFD", char)
            if len(both) >= 2:
                head = unicodedata.normalize("NFC", both[:-1])
                if len(head) == 1:
                    pairs[ord(head) << 21 | ord(both[-1])] = code
    for s_index in range(19 * 21):
        lead, vowel = divmod(s_index, 21)
        lv = 0xAC00 + s_index * 28
        pairs[(0x1100 + lead) << 21 | (0x1161 + vowel)] = lv
        for t in range(1, 28):
            pairs[lv << 21 | (0x11A7 + t)] = lv + t
    flat: list[int] = []
    for code, into in special.items():
        count[code] = len(into)
        offset[code] = TOP + len(flat)
        flat.extend(into)
    replacement = np.concatenate([np.arange(TOP, dtype=np.int32), np.array(flat, np.int32)])
    keys = np.array(sorted(pairs), np.int64)
    return count, offset, replacement, classes, keys, np.array([pairs[int(k)] for k in keys], np.int32)


def same_form(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of many rows in one form; ``row`` names each one's row."""
    count, offset, replacement, classes, keys, results = _tables()
    many = count[codes].astype(np.int64)
    begin = np.cumsum(many) - many
    source = np.repeat(np.arange(len(codes)), many)
    out = replacement[offset[codes][source] + (np.arange(len(source)) - begin[source])]
    row = row[source]
    # Marks in canonical order: a stable sort within each run behind a starter.
    ccc = classes[out]
    if ccc.any():
        run = np.cumsum(ccc == 0)
        order = np.lexsort((ccc, run, row))
        out, row, ccc = out[order], row[order], ccc[order]
    # Compose: each round joins, in every row at once, the first mark that still can join.
    while len(out) > 1:
        key = out[:-1].astype(np.int64) << 21 | out[1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        joins = (keys[at] == key) & (row[:-1] == row[1:]) & (ccc[:-1] == 0)
        # A mark joins over others only if none of its own class stands between.
        blocked = _over_marks(out, row, ccc, keys)
        if not joins.any() and blocked is None:
            break
        keep = np.ones(len(out), bool)
        if joins.any():
            where = np.flatnonzero(joins)
            where = where[np.concatenate([[True], np.diff(where) > 1])]
            out = out.copy()
            out[where] = results[at[where]]
            keep[where + 1] = False
        else:
            starter, mark, code = blocked
            out = out.copy()
            out[starter] = code
            keep[mark] = False
        out, row, ccc = out[keep], row[keep], ccc[keep]
        ccc = classes[out]
    return out, row


def _over_marks(out, row, ccc, keys):
    """Starters with a mark that composes across other marks: (starters, marks, codes)."""
    late = np.flatnonzero((ccc > 0) & np.concatenate([[False], (ccc[:-1] > 0) & (ccc[:-1] < ccc[1:])]))
    if not len(late):
        return None
    _, _, _, _, _, results = _tables()
    start = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(ccc)), -1))[late]
    fine = (start >= 0) & (row[np.maximum(start, 0)] == row[late])
    late, start = late[fine], start[fine]
    key = out[start].astype(np.int64) << 21 | out[late]
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = keys[at] == key
    if not hit.any():
        return None
    starts, first = np.unique(start[hit], return_index=True)
    return starts, late[hit][first], results[at[hit][first]]


def canonical_array(texts: pa.Array) -> pa.Array:
    """The one form of each text of an Arrow string array; null stays null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    row = np.searchsorted(bounds, leads, "right") - 1
    out, row = same_form(codes, row)
    text = out.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000)
    sizes = np.bincount(row, weights=width, minlength=n).astype(np.int64)
    made = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)])), pa.py_buffer(text)])
    if texts.null_count:
        made = pa.compute.if_else(pa.compute.is_valid(texts), made, pa.scalar(None, pa.large_string()))
    return made.cast(pa.string())


def _slabs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded size; one very long text is a part of its own."""
    rows = max(1, int(batch.num_rows * SLAB_BYTES / max(batch.nbytes, 1)))
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def add_canonical(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add to ``df``, for each ``source: target`` of ``columns``, the one form of the text.

    Alike are: full-width and ordinary forms, all single blanks, all hyphens (dashes and
    minus stay apart), Latin ligatures and their letters, composed and combining accents,
    Cyrillic and Greek letters drawn like Latin ones; invisible characters vanish.  Case,
    accents, digits for letters, superscripts and the number of blanks stay as they are.
    Null gives null, empty gives empty, rows are neither lost nor joined.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    kept = df.drop(*[t for t in columns.values()])
    schema = StructType([*kept.schema.fields, *[StructField(t, StringType()) for t in columns.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slabs(whole):
                arrays = list(batch.columns)
                names = list(batch.schema.names)
                for source, target in columns.items():
                    arrays.append(canonical_array(batch.column(batch.schema.names.index(source))))
                    names.append(target)
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kept.mapInArrow(run, schema)


def lookalike_pairs(df: DataFrame, key: str, scope: str, text: str) -> DataFrame:
    """Pairs of rows of one ``scope`` whose texts look the same and are stored differently.

    Columns ``scope, id_a, id_b`` with id_a < id_b.  Rows are first brought together as
    distinct stored texts of one form; a class of copies meets another class once, and
    only classes with a partner are expanded into the pairs that are the result.  Rows
    with a null key, scope or text have no pairs.
    """
    formed = add_canonical(
        df.select(F.col(key).alias("id"), F.col(scope).alias("scope"), F.col(text).alias("stored")).where("id is not null and scope is not null and stored is not null"),
        {"stored": "form"},
    )
    # From here on 128-bit digests stand for the texts.  The forms are made once.
    digest = lambda c: F.unhex(F.md5(c)).alias(c)
    formed = checkpointed(formed.select("id", "scope", digest("form"), digest("stored")))
    classes = formed.groupBy("scope", "form", "stored").agg(F.count("*").alias("_n"))
    several = classes.groupBy("scope", "form").agg(F.count("*").alias("_kinds")).where("_kinds > 1").drop("_kinds")
    kinds = classes.join(several, ["scope", "form"], "left_semi").drop("_n")
    left = kinds.withColumnRenamed("stored", "stored_a")
    right = kinds.withColumnRenamed("stored", "stored_b")
    met = left.join(right, ["scope", "form"]).where("stored_a < stored_b").drop("form")
    members = formed.select("scope", "stored", "id")
    both = met.join(members.withColumnsRenamed({"stored": "stored_a", "id": "a"}), ["scope", "stored_a"])
    both = both.join(members.withColumnsRenamed({"stored": "stored_b", "id": "b"}), ["scope", "stored_b"])
    return both.select("scope", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
