"""Partial records of a document's chunks merged into one, deterministically."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property
from operator import is_

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.numbers import MINUSES
from paperloom.functions.text import trimmed
from paperloom.operators.json_text import alike, canonical, compact, number_text, read_record

_SIGNS = frozenset("-" + MINUSES)
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


def search_form(text: str) -> str:
    """The search form of ``functions.text.for_search``, for values inside one document."""
    if not text.isascii():
        bare = "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f")
        text = unicodedata.normalize("NFC", bare)
    return _OTHER.sub(" ", text.lower()).strip()


def _signed_within(text: str, number: str) -> bool:
    """Does the text hold the number, one without a sign behind no minus?"""
    at = text.find(number)
    if number.startswith("-"):
        return at >= 0
    while at > 0 and text[at - 1] in _SIGNS:
        at = text.find(number, at + 1)
    return at >= 0


class Document:
    """A document's text; its search form and the text without commas are made once, where a
    value is not in it verbatim."""

    def __init__(self, text: str):
        self.raw = text

    @cached_property
    def normal(self) -> str:
        return search_form(self.raw)

    @cached_property
    def plain(self) -> str:
        return self.raw.replace(",", "")

    def rank(self, value) -> int:
        """How well a scalar is grounded: 2 verbatim, 1 normalised, 0 not."""
        if isinstance(value, bool) or value is None or not self.raw:
            return 0
        if isinstance(value, str):
            if value and value in self.raw:
                return 2
            form = search_form(value)
            return 1 if form and form in self.normal else 0
        text = number_text(value)
        if not ("." in text or "," in text or sum(map(str.isdigit, text)) >= 3):
            return 0
        if _signed_within(self.raw, text):
            return 2
        forms = dict.fromkeys([text, f"{value:.2f}", f"{value:.0f}" if value == int(value) else f"{value:.1f}"])
        if any(_signed_within(self.raw, f) for f in forms):
            return 2
        return 1 if any(_signed_within(self.plain, f) for f in forms) else 0

    def holds_entry(self, entry) -> bool:
        """Has an array entry a string leaf that is in the document, or half its tokens?"""
        leaves = _filled(entry)
        if not leaves:
            return True
        for leaf in leaves:
            if leaf in self.raw:
                return True
            form = search_form(leaf)
            if form and form in self.normal:
                return True
            tokens = [t for t in form.split() if len(t) >= 3]
            if tokens and sum(t in self.normal for t in tokens) * 2 >= len(tokens):
                return True
        return False


def _filled(value) -> list[str]:
    """The strings in a value that are not blank."""
    if type(value) is str:
        return [value] if value.strip() else []
    if type(value) is not dict and not isinstance(value, list):
        return []
    out: list[str] = []
    for v in value.values() if type(value) is dict else value:
        if type(v) is str:
            if v.strip():
                out.append(v)
        elif type(v) is dict or isinstance(v, list):
            out += _filled(v)
    return out


class Entries(list):
    """Of structurally equal entries the first, and the forms of all, made once."""

    def __init__(self, entries: list):
        super().__init__()
        self.forms: set = set()
        self.join(entries)

    def join(self, entries: list) -> None:
        for entry in entries:
            form = canonical(entry)
            if form not in self.forms:
                self.forms.add(form)
                self.append(entry)


def merge_partials(partials: list[str | None], text: str) -> tuple[str, list[tuple[str, list[str]]]]:
    """(merged record, conflicts as (path, values)) of partial records in chunk order.

    Null yields to a value, objects merge key by key, arrays are joined without repeats, of
    two scalars the better grounded holds, of equally grounded ones the first, with a
    conflict.  Entries of arrays that the document does not speak of are dropped.
    """
    document = Document(text)
    conflicts: dict[str, list] = {}

    def clash(path: str, a, b) -> None:
        held = conflicts.setdefault(path, [list(a) if isinstance(a, Entries) else a])
        if not any(alike(b, x) for x in held):
            held.append(b)

    def into(left: dict, right: dict, path: str) -> dict:
        for key, new in right.items():
            here = f"{path}.{key}" if path else key
            old = left.get(key)
            if old is None:
                left[key] = Entries(new) if isinstance(new, list) else new
            elif new is None or alike(old, new):
                continue
            elif isinstance(old, dict) and isinstance(new, dict):
                left[key] = into(old, new, here)
            elif isinstance(old, list) and isinstance(new, list):
                if not isinstance(old, Entries):
                    old = left[key] = Entries(old)
                old.join(new)
            elif isinstance(old, (dict, list)) or isinstance(new, (dict, list)):
                clash(here, old, new)
            else:
                mine, theirs = document.rank(old), document.rank(new)
                if theirs > mine:
                    left[key] = new
                    conflicts.pop(here, None)
                elif theirs == mine:
                    clash(here, old, new)
        return left

    def pruned(value):
        """The value itself where no array is in it."""
        if type(value) is dict:
            made = None
            for k, v in value.items():
                if type(v) is dict or isinstance(v, list):
                    below = pruned(v)
                    if below is not v:
                        made = dict(value) if made is None else made
                        made[k] = below
            return value if made is None else made
        if isinstance(value, list):
            held = [v for v in value if document.holds_entry(v)]
            made = [pruned(v) for v in held]
            unchanged = isinstance(value, Entries) and all(map(is_, made, held))
            return made if unchanged else list(Entries(made))
        return value

    merged: dict = {}
    for partial in partials:
        found = read_record(partial)
        if found is not None:
            merged = into(merged, found, "")
    if text:
        merged = pruned(merged)
    return compact(merged), sorted((path, [compact(v) for v in values]) for path, values in conflicts.items() if len(values) > 1)


def merge_documents(partials: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, merged, conflicts``: partials (``key, chunk, json``) of each document folded in
    chunk order against its text.  Documents are the unit of work: one document's partials
    are one fold, and documents are spread by their key."""
    kind = dict(docs.dtypes)[key]
    folded = partials.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "json"))), lambda p: p["json"]).alias("_p"))
    joined = folded.join(docs.select(key, F.col("text").alias("_t")), key, "left").select(F.col(key).alias("_k"), "_p", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, partials, texts = batch.columns
            at, jsons = partials.offsets.to_pylist(), partials.values.to_numpy(zero_copy_only=False).tolist()
            records, paths, values, path_at, value_at = [], [], [], [0], [0]
            for i, text in enumerate(texts.to_numpy(zero_copy_only=False).tolist()):
                merged, conflicts = merge_partials(jsons[at[i]:at[i + 1]], text or "")
                records.append(merged)
                for path, rivals in conflicts:
                    paths.append(path)
                    values += rivals
                    value_at.append(len(values))
                path_at.append(len(paths))
            rivals = pa.ListArray.from_arrays(pa.array(value_at, pa.int32()), pa.array(values, pa.string()))
            clashes = pa.StructArray.from_arrays([pa.array(paths, pa.string()), rivals], names=["path", "values"])
            yield pa.RecordBatch.from_arrays([keys, pa.array(records, pa.string()), pa.ListArray.from_arrays(pa.array(path_at, pa.int32()), clashes)], names=[key, "merged", "conflicts"])

    return joined.mapInArrow(run, f"`{key}` {kind}, merged string, conflicts array<struct<path string, values array<string>>>")


def merge_scalars(partials: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """The typed fold of scalars, without Python: per key and column the best ranked value
    (``columns`` maps a column to its rank expression), the first of equal ranks, and whether
    others of that rank differ: ``key, <column>, <column>_conflict``."""
    out = []
    for name, rank in columns.items():
        best = F.max_by(F.struct(rank.alias("r"), F.col(name).alias("v")), F.struct(rank, -F.col(order)))
        out.append(best.alias(f"_{name}"))
        ranked = F.collect_set(F.when(F.col(name).isNotNull(), F.struct(rank.alias("r"), F.col(name).cast("string").alias("v"))))
        out.append(ranked.alias(f"_{name}_all"))
    filled = partials
    folded = filled.groupBy(key).agg(*out)
    selected = [F.col(key)]
    for name in columns:
        selected.append(F.col(f"_{name}.v").alias(name))
        rivals = F.filter(f"_{name}_all", lambda x: x["r"] == F.col(f"_{name}.r"))
        selected.append((F.size(rivals) > 1).alias(f"{name}_conflict"))
    return folded.select(*selected)


def merge_arrays(partials: DataFrame, key: str, order: str, entry: list[str]) -> DataFrame:
    """Entries of all partials in order, the first of equal ones (strings trimmed):
    ``key, position, <entry columns>``."""
    from pyspark.sql.window import Window

    types = dict(partials.dtypes)
    same = [trimmed(F.col(c)) if types[c] == "string" else F.col(c) for c in entry]
    first = partials.withColumn("_rank", F.row_number().over(Window.partitionBy(key, *same).orderBy(order))).where("_rank = 1")
    return first.withColumn("position", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("int")).select(key, "position", *entry)
