"""Evidence for extracted leaves: is a value in its document, and where."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.numbers import distinctive_number, holds_number, numeric_skeleton, search_candidates
from paperloom.functions.text import for_search, let, token_coverage, trimmed
from paperloom.operators.json_text import loads, number_text
from paperloom.plans.schema import Schema


def source_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The document with its search form and numeric skeleton, computed once for all leaves."""
    return docs.withColumn("normal_text", for_search(F.col(text))).withColumn("skeleton", numeric_skeleton(F.col(text)))


def ground_string(value: Column, raw: Column, normal: Column) -> Column:
    found = F.when(F.contains(raw, value), "verbatim").when((for_search(value) != "") & F.contains(normal, for_search(value)), "normalized").otherwise("absent")
    return F.when(F.coalesce(value, F.lit("")) == "", "absent").otherwise(found)


def ground_date(value: Column, raw: Column, normal: Column) -> Column:
    """Dates are rewritten by models, so one that is not found is reformatted, never absent."""
    prefix = F.substring(value, 1, 10)
    return F.when(F.contains(raw, value) | ((F.length(value) >= 10) & F.contains(prefix, F.lit("-")) & F.contains(raw, prefix)), "verbatim").when((for_search(value) != "") & F.contains(normal, for_search(value)), "normalized").otherwise("reformatted")


def ground_number(value: Column, raw: Column, skeleton: Column) -> Column:
    """A number in one of its written forms, then by skeletons; never absent."""

    def found(candidates: Column) -> Column:
        verbatim = F.exists(candidates, lambda c: holds_number(raw, c))
        normalized = F.exists(candidates, lambda c: holds_number(skeleton, numeric_skeleton(c)))
        return F.when(verbatim, "verbatim").when(normalized, "normalized").otherwise("reformatted")

    return F.when(value.isNull(), "reformatted").otherwise(let(search_candidates(value), found))


def ground_leaf(kind: Column, text: Column, number: Column, raw: Column, normal: Column, skeleton: Column) -> Column:
    """Grounding of a leaf by its kind; booleans, nulls and missing ones are reformatted."""
    return (
        F.when(text.isNull(), "reformatted")
        .when(kind == "string", ground_string(text, raw, normal))
        .when(kind == "number", ground_number(number, raw, skeleton))
        .when(kind == "date", ground_date(text, raw, normal))
        .otherwise("reformatted")
    )


def merge_rank(kind: Column, text: Column, grounding: Column) -> Column:
    """2 verbatim, 1 normalized, 0 else; a number counts only if it is distinctive."""
    rank = F.when(grounding == "verbatim", 2).when(grounding == "normalized", 1).otherwise(0)
    return F.when(kind == "string", rank).when((kind == "number") & distinctive_number(text), rank).otherwise(0)


def leaf_rows(records: DataFrame, key: str, paths: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per schema path in property order: ``key, path, kind, text, number``; missing
    and null leaves too."""
    rows = F.array(*[F.struct(F.lit(i).alias("ix"), F.lit(path).alias("path"), F.lit(kind).alias("kind"), value.cast("string").alias("text"), (value if kind == "number" else F.lit(None)).cast("decimal(38,18)").alias("number")) for i, (path, kind, value) in enumerate(paths)])
    return records.select(key, F.explode(rows).alias("_r")).select(key, "_r.*")


def absent_paths(grounded: DataFrame, key: str) -> DataFrame:
    return grounded.where("grounding = 'absent'").select(key, "path")


def entry_is_grounded(strings: Column, raw: Column, normal: Column) -> Column:
    """Has an array entry a string that is in the document, or half its tokens?  An entry
    without filled strings is kept."""
    filled = F.filter(strings, lambda s: trimmed(s) != "")
    return (F.size(filled) == 0) | F.exists(filled, lambda s: F.contains(raw, s) | ((for_search(s) != "") & F.contains(normal, for_search(s))) | token_coverage(s, normal))


#: Lengths of text that runs of blocks are looked at in, by the value's own length.
REACHES = (120, 1200)


def provenance(values: DataFrame, blocks: DataFrame, key: str = "doc_id", cells: DataFrame | None = None) -> DataFrame:
    """Where a value stands: ``key, path, step, page, x, y, w, h``.

    ``values`` has ``key, path, text`` and, where some are numbers, ``number`` (null for the
    others): a number is sought in each form in which it can be written, then by its digits
    alone ("$12.50" for 12.5).

    The ladder: a table cell that equals it, a cell that contains it, the smallest block
    that contains it, the shortest run of blocks of one page, the shortest run across pages
    (its first page is reported).  Values that are found nowhere have no row.  A run is
    looked for in at most max(4 n, n + 80) characters for a value of n.
    """
    number = F.col("number").cast("decimal(38,18)") if "number" in values.columns else F.lit(None).cast("decimal(38,18)")
    forms = F.when(number.isNull(), F.array(F.col("text"))).otherwise(search_candidates(number))
    v = values.select(key, "path", number.isNotNull().alias("numeric"), F.posexplode(forms).alias("form", "value")).where("value <> ''")
    v = v.withColumn("norm", for_search(F.col("value"))).withColumn("digits", F.when(F.col("numeric"), numeric_skeleton(F.col("value"))))
    placed = blocks.where("page is not null and x is not null").select(key, "ord", "page", "x", "y", "w", "h", F.col("text").alias("block"))
    box = F.struct("page", "x", "y", "w", "h")
    found = []
    if cells is not None:
        c = _searchable(cells.select(key, F.col("text").alias("cell"), box.alias("b"), F.array(*[F.col(k).cast("double") for k in ("page", "table_ix", "row", "col")]).alias("tie")), "cell")
        met = v.join(c, key).withColumn("rank", _match(F.col("cell"), F.col("cell_norm"), F.col("cell_digits"))).where("rank is not null")
        found.append(met.select(key, "path", F.struct("rank", F.when(F.col("cell") == F.col("value"), 0).otherwise(1).alias("step"), "tie", "b").alias("hit")))
    single = v.join(_searchable(placed, "block"), key).withColumn("rank", _match(F.col("block"), F.col("block_norm"), F.col("block_digits"))).where("rank is not null")
    found.append(single.select(key, "path", F.struct("rank", F.lit(2).alias("step"), F.array(F.col("w") * F.col("h"), F.col("page").cast("double"), F.col("ord").cast("double")).alias("tie"), box.alias("b")).alias("hit")))
    n = F.length("value")
    v = v.withColumn("cap", F.greatest(4 * n, n + 80)).withColumn("reach", F.coalesce(*[F.when(F.col("cap") <= r, r) for r in REACHES], F.lit(0)))
    found += [_runs(v.where(F.col("reach") == reach), placed, key, reach) for reach in (*REACHES, 0)]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy(key, "path").agg(F.min("hit").alias("hit")).select(key, "path", F.col("hit.step").alias("step"), "hit.b.*")


def _searchable(df: DataFrame, text: str) -> DataFrame:
    """The text's search form and digits, made once for all values."""
    return df.withColumn(f"{text}_norm", for_search(F.col(text))).withColumn(f"{text}_digits", numeric_skeleton(F.col(text)))


def _match(text: Column, norm: Column, digits: Column) -> Column:
    """How well a text holds a value (less is better), or null."""
    value = F.col("value")
    words = F.when(F.contains(text, value) | ((F.col("norm") != "") & F.contains(norm, F.col("norm"))), 0)
    # A written form goes before digits alone, an earlier form before a later one.
    figures = F.when(holds_number(text, value), F.col("form")).when(holds_number(digits, F.col("digits")), 100 + F.col("form"))
    return F.when(F.col("numeric"), figures).otherwise(words)


def _runs(v: DataFrame, placed: DataFrame, key: str, reach: int) -> DataFrame:
    """Runs of two and more blocks that hold a value, within one page (step 3) or across.

    The blocks behind each one, as far as the reach goes, are joined once; the values are
    sought in these texts, and only where one is found the run is cut to its shortest.
    """
    wanted = placed.join(v.select(key).distinct(), key, "left_semi")
    order = Window.partitionBy(key).orderBy("page", "ord", "y", "x", "block")
    laid = wanted.withColumn("at", F.coalesce(F.sum(F.length("block") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = Window.partitionBy(key).orderBy("at")
    ahead = ahead.rangeBetween(0, reach + 1) if reach else ahead.rangeBetween(0, Window.unboundedFollowing)
    starts = laid.withColumn("run", F.collect_list(F.struct("page", "ord", "x", "y", "w", "h", "block", "at")).over(ahead)).where(F.size("run") > 1)
    starts = _searchable(starts.select(key, F.col("page").alias("low"), F.col("at").alias("begin"), "run", F.array_join(F.transform("run", lambda b: b["block"]), " ").alias("whole")), "whole")
    met = v.join(starts, key).where(_match(F.col("whole"), F.col("whole_norm"), F.col("whole_digits")).isNotNull())
    near = F.filter(F.sequence(F.lit(2), F.size("run")), lambda j: F.element_at("run", j)["at"] - F.col("begin") <= F.col("cap") + 1)
    texts = F.transform(near, lambda j: F.struct(j.alias("j"), F.array_join(F.transform(F.slice("run", 1, j), lambda b: b["block"]), " ").alias("t")))
    tried = F.transform(texts, lambda x: F.struct(_match(x["t"], for_search(x["t"]), numeric_skeleton(x["t"])).alias("rank"), F.when(F.element_at("run", x["j"])["page"] == F.col("low"), 3).otherwise(4).alias("step"), x["j"].alias("j")))
    best = F.array_min(F.filter(tried, lambda t: t["rank"].isNotNull()))
    cut = met.withColumn("best", best).where("best is not null")
    part = F.filter(F.slice("run", 1, F.col("best.j")), lambda b: b["page"] == F.col("low"))
    edge = lambda pick, of: pick(F.transform(part, of))
    left, top = edge(F.array_min, lambda b: b["x"]), edge(F.array_min, lambda b: b["y"])
    union = F.struct(F.col("low").alias("page"), left.alias("x"), top.alias("y"), (edge(F.array_max, lambda b: b["x"] + b["w"]) - left).alias("w"), (edge(F.array_max, lambda b: b["y"] + b["h"]) - top).alias("h"))
    tie = F.array(F.col("best.j").cast("double"), F.col("low").cast("double"), F.col("begin").cast("double"))
    return cut.select(key, "path", F.struct(F.col("best.rank").alias("rank"), F.col("best.step").alias("step"), tie.alias("tie"), union.alias("b")).alias("hit"))


def json_leaves(records: DataFrame, key: str, json: str, schema: Schema) -> DataFrame:
    """The scalars of any nested JSON record with their paths (``a.b[0].c``): ``key, ix, path,
    kind, text, number``.

    The walk follows the schema in property order.  A missing or null property has a row of
    kind 'null', an element that is null only where scalars are listed; values of another
    shape than their schema's have none below them.  Numbers come exact, in ``text`` too.
    Null and broken JSON has no rows.
    """
    kinds = {"number": "number", "integer": "number", "boolean": "boolean", "null": "null"}

    def walk(value, node: Schema, path: str, out: list) -> None:
        if node.kind == "object":
            if isinstance(value, dict):
                for name, below in node.properties.items():
                    child = f"{path}.{name}" if path else name
                    if value.get(name) is None:
                        out.append((child, "null", None, None))
                    else:
                        walk(value[name], below, child, out)
        elif node.kind == "array":
            for i, element in enumerate(value if isinstance(value, list) else ()):
                walk(element, node.items or Schema.string(), f"{path}[{i}]", out)
        elif value is None or isinstance(value, (dict, list)):
            out.append((path, "null", None, None))
        elif isinstance(value, bool):
            out.append((path, "boolean", "true" if value else "false", None))
        elif isinstance(value, str):
            kind = "date" if node.format in ("date", "date-time") else kinds.get(node.kind, "string")
            out.append((path, kind, value, None))
        else:
            text = number_text(value)
            out.append((path, "number" if node.kind in ("number", "integer") else "null", text, text))

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for ident, text in zip(batch.column(0), batch.column(1).to_pylist()):
                try:
                    found: list = []
                    if text is not None:
                        walk(loads(text), schema, "", found)
                except (ValueError, RecursionError):
                    continue
                ids += [ident.as_py()] * len(found)
                rows += [(i, *r) for i, r in enumerate(found)]
            columns = list(zip(*rows)) if rows else [()] * 5
            types = (pa.int32(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[key, "ix", "path", "kind", "text", "number"])

    kind = dict(records.dtypes)[key]
    made = records.select(key, json).mapInArrow(run, f"`{key}` {kind}, ix int, path string, kind string, text string, number string")
    return made.withColumn("number", F.col("number").try_cast("decimal(38,18)"))


def agreement_at(boxes: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The weakest agreement among the blocks a box meets on its page: ``key, path, matching,
    observing`` (by share, then by count)."""
    b = blocks.select(key, "page", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("w").alias("bw"), F.col("h").alias("bh"), "matching", "observing")
    met = boxes.join(b, [key, "page"]).where("x < bx + bw and bx < x + w and y < by + bh and by < y + h")
    weakest = F.min_by(F.struct("matching", "observing"), F.struct(F.col("matching") / F.greatest("observing", F.lit(1)), "matching"))
    return met.groupBy(key, "path").agg(weakest.alias("_w")).select(key, "path", "_w.*")
