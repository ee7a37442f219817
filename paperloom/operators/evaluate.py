"""Corpus evaluation: field scores, accuracy, comparisons, surveys and named assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.dates import date_in_text
from paperloom.functions.numbers import amount_in_text, close_to
from paperloom.functions.text import for_scoring, same_or_within, scoring_contains
from paperloom.operators.layout import line_item_shaped


def invariant_state(items: Column, total: Column, tax: Column) -> Column:
    """'skipped', 'ok' or 'violated': the line totals and the tax (none is 0) make the total,
    within 0.01.  Skipped without items, total, or with a line that has none."""
    known = F.coalesce(F.size(items) > 0, F.lit(False)) & total.isNotNull() & F.coalesce(F.forall(items, lambda i: i.isNotNull()), F.lit(False))
    money = "decimal(38,4)"
    summed = F.aggregate(items, F.lit(0).cast(money), lambda a, i: (a + i.cast(money)).cast(money))
    return F.when(~known, "skipped").when(close_to(summed + F.coalesce(tax, F.lit(0)).cast(money), total), "ok").otherwise("violated")


def issues(checks: list[tuple[str, str, Column, Column]]) -> Column:
    """Issues of user predicates (path, expected, found, holds): ``array<struct<path, expected,
    found>>``; a null predicate does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(expected).alias("expected"), found.cast("string").alias("found"))) for path, expected, found, holds in checks]))


def pairing_guard(text: Column, number: Column, seller: Column, total: Column) -> Column:
    """Does a document show its truth's token: the number, else seller or total?"""
    return F.when(F.coalesce(for_scoring(number), F.lit("")) != "", scoring_contains(text, number)).otherwise(F.coalesce(scoring_contains(text, seller), F.lit(False)) | F.coalesce(amount_in_text(text, total), F.lit(False)))


def header_scores(joined: DataFrame, key: str, fields: list[tuple[str, str, str, str]], text: str = "text") -> DataFrame:
    """One row per document and header field with a truth: ``key, field, truth, predicted,
    correct, present, hard_failure``.

    ``fields``: (name, kind, truth column, predicted column); kinds text, party, amount
    (within 0.02), date (same day).  A document without prediction is a hard failure and all
    its fields are wrong.  ``present`` says whether the truth stands in the text.
    """
    body = F.col(text)
    rows = []
    for name, kind, truth, predicted in fields:
        t, p = F.col(truth), F.col(predicted)
        if kind == "amount":
            correct, present = close_to(t, p, "0.02"), amount_in_text(body, t)
        elif kind == "date":
            correct, present = F.to_date(t) == F.to_date(p), date_in_text(body, t)
        elif kind == "party":
            correct, present = same_or_within(t, p), scoring_contains(body, t)
        else:
            correct, present = for_scoring(t) == for_scoring(p), scoring_contains(body, t)
        row = F.struct(F.lit(name).alias("field"), t.cast("string").alias("truth"), p.cast("string").alias("predicted"), F.coalesce(correct, F.lit(False)).alias("correct"), F.coalesce(present, F.lit(False)).alias("present"))
        rows.append(F.when(t.isNotNull(), row))
    spread = joined.select(key, "hard_failure", F.explode(F.array_compact(F.array(*rows))).alias("_r"))
    return spread.select(key, "_r.*", "hard_failure").withColumn("correct", F.col("correct") & ~F.col("hard_failure"))


def _form_holds(a: Column, b: Column) -> Column:
    """same_or_within() of two scoring forms."""
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a))


def match_lines(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """For each truth line the first predicted one whose description equals, holds or is held
    by it: ``key, line_ix, match_ix`` (null: none).  Both have ``key, line_ix, description``."""
    # Forms are made once a line, before lines meet.
    t = truth.select(key, "line_ix", for_scoring(F.col("description")).alias("form"))
    p = predicted.select(key, F.col("line_ix").alias("p_ix"), for_scoring(F.col("description")).alias("p_form"))
    best = t.join(p, key).where(_form_holds(F.col("form"), F.col("p_form"))).groupBy(key, "line_ix").agg(F.min("p_ix").alias("match_ix"))
    return truth.select(key, "line_ix").join(best, [key, "line_ix"], "left")


def lost_lines(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Truth lines that no predicted one of the document holds."""
    p = predicted.select(F.col(key).alias("_k"), for_scoring(F.col("description")).alias("_p"))
    t = truth.withColumn("_t", for_scoring(F.col("description")))
    return t.join(p, (F.col(key) == F.col("_k")) & _form_holds(F.col("_t"), F.col("_p")), "left_anti").drop("_t")


def duplicate_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines whose description was there before, per document: ``key, duplicates``."""
    return lines.groupBy(key).agg((F.count("*") - F.count_distinct(for_scoring(F.coalesce("description", F.lit(""))))).alias("duplicates"))


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits, of), F.lit(0.0))


def accuracy(scores: DataFrame, by_field: bool = True) -> DataFrame:
    """Accuracy over all fields (``field`` null) and, in the same pass, per field:
    historical (successful documents), of values present in the text, and with the fields of
    failed documents as misses."""
    ok = ~F.col("hard_failure")
    measures = [
        F.count_if(ok & F.col("correct")).alias("correct"), F.count_if(ok).alias("total"),
        F.count_if(ok & F.col("present") & F.col("correct")).alias("present_correct"), F.count_if(ok & F.col("present")).alias("present_total"),
        F.count_if(ok & F.col("correct")).alias("inclusive_correct"), F.count("*").alias("inclusive_total"),
    ]
    if by_field:
        summed = scores.groupingSets([["field"], []], "field").agg(*measures)
    else:
        summed = scores.agg(*measures)
    return summed.withColumns({"accuracy": _share(F.col("correct"), F.col("total")), "present_accuracy": _share(F.col("present_correct"), F.col("present_total")), "inclusive_accuracy": _share(F.col("inclusive_correct"), F.col("inclusive_total"))})


def failure_share(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.count_if("hard_failure").alias("failures"), _share(F.count_if("hard_failure"), F.count("*")).alias("failure_share"))


def compare_arms(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two arms' scores side by side, a missing one as incorrect: ``key, field, a_correct,
    b_correct``."""
    left = a.select(key, "field", F.col("correct").alias("a_correct"))
    right = b.select(key, "field", F.col("correct").alias("b_correct"))
    return left.join(right, [key, "field"], "full_outer").withColumns({"a_correct": F.coalesce("a_correct", F.lit(False)), "b_correct": F.coalesce("b_correct", F.lit(False))})


def arm_deltas(compared: DataFrame) -> DataFrame:
    """Percentage points from arm a to b, overall (``field`` null) and per field."""
    n = F.count("*")
    return compared.groupingSets([["field"], []], "field").agg(
        n.alias("total"), F.count_if("a_correct").alias("a"), F.count_if("b_correct").alias("b"), (100.0 * (F.count_if("b_correct") - F.count_if("a_correct")) / n).alias("delta_pp"),
    )


def grounding_histogram(leaves: DataFrame, key: str) -> DataFrame:
    """Leaves by grounding per record, how many have provenance, how many grounded ones have
    none, and up to six of those paths."""
    grounded = F.col("grounding").isin("verbatim", "normalized")
    bare = grounded & ~F.col("has_provenance")
    sample = F.transform(F.slice(F.sort_array(F.collect_list(F.when(bare, F.struct("ix", "path")))), 1, 6), lambda s: s["path"])
    kinds = ("verbatim", "normalized", "reformatted", "absent")
    return leaves.groupBy(key).agg(*[F.count_if(F.col("grounding") == k).alias(k) for k in kinds], F.count_if("has_provenance").alias("with_provenance"), F.count_if(bare).alias("grounded_without"), sample.alias("sample_paths"))


def survey(documents: DataFrame) -> DataFrame:
    """Counts, shares and means of inspected documents; the share's denominator is at least 1.
    Needs ``status, used_ocr, shaped, tables, blocks, characters``."""
    ok = F.col("status") == "ok"
    n = F.greatest(F.count_if(ok), F.lit(1))
    mean = lambda c: F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0)).alias(f"mean_{c}")
    return documents.agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"), F.count_if(ok & F.col("used_ocr")).alias("ocr"), F.count_if(ok & F.col("shaped")).alias("shaped"), (F.count_if(ok & F.col("shaped")) / n).alias("shaped_share"), mean("tables"), mean("blocks"), mean("characters"))


def merge_report(arms: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """The chunk-merge comparison in one row per arm: field accuracy by role with its rollup,
    line counts over documents where both arms succeeded, conflicts, failures, provenance.

    ``fields``: ``arm, key, field, correct``; ``arms``: ``arm, key, failed, lines, true_lines,
    conflicts, leaves, placed, triggered, recovered``.
    """
    role = F.when(F.col("field").startswith("lineItems") & F.col("field").endswith("description"), "description").when(F.col("field").startswith("lineItems"), "amount").otherwise("header")
    roles = fields.withColumn("role", role).groupBy("arm").agg(*[(F.count_if((F.col("role") == r) & F.col("correct"))).alias(f"{r}_correct") for r in ("header", "description", "amount")], *[F.count_if(F.col("role") == r).alias(f"{r}_total") for r in ("header", "description", "amount")], F.count_if("correct").alias("all_correct"), F.count("*").alias("all_total"))
    ok_docs = arms.where("not failed").groupBy(key).agg(F.count_distinct("arm").alias("_n")).where("_n >= 2").select(key, F.lit(True).alias("_both"))
    joined = arms.join(ok_docs, key, "left").withColumn("_both", F.coalesce("_both", F.lit(False)))
    totals = joined.groupBy("arm").agg(
        F.count("*").alias("documents"), F.count_if("failed").alias("failures"), F.count_if(F.col("_both") & (F.col("lines") == F.col("true_lines"))).alias("exact_line_counts"), F.count_if("_both").alias("both_ok"),
        F.coalesce(F.avg(F.when(~F.col("failed"), F.col("conflicts"))), F.lit(0.0)).alias("mean_conflicts"), _share(F.sum("placed"), F.sum("leaves")).alias("provenance_rate"),
        F.count_if("triggered").alias("triggered"), F.count_if(F.col("triggered") & F.col("recovered")).alias("recovered"), F.count_if(F.col("triggered") & ~F.col("recovered")).alias("unrecovered"),
    )
    return totals.join(roles, "arm", "left")


def anchor_result(kind: Column, values: Column, value: Column, count: Column, text: Column, cells: Column, rows: Column, columns: Column, fill: Column) -> Column:
    """'passed' or 'failed' of one check on one document; 'skipped' where it is not there."""
    holds = F.when(kind == "textContains", scoring_contains(text, value))
    holds = holds.when(kind == "sellerEquals", scoring_contains(text, value))
    holds = holds.when(kind == "tableContainsCells", F.forall(values, lambda v: F.exists(cells, lambda c: scoring_contains(c, v))))
    holds = holds.when(kind == "exactTables", F.size(rows) == count).when(kind == "minTables", F.size(rows) >= count)
    holds = holds.when(kind == "lineItemShaped", F.exists(F.arrays_zip(rows.alias("r"), columns.alias("c"), fill.alias("f")), lambda t: line_item_shaped(t["r"], t["c"], t["f"])))
    return F.when(text.isNull(), "skipped").when(F.coalesce(holds, F.lit(False)), "passed").otherwise("failed")


def union_files(a: DataFrame, b: DataFrame, path: str = "path") -> DataFrame:
    """The paths of two lists of files, each once, in order of the path.  A null is no path."""
    return a.select(path).union(b.select(path)).where(F.col(path).isNotNull()).distinct().orderBy(path)


def resolve_files(tokens: DataFrame, files: DataFrame, token: str = "token", path: str = "path") -> DataFrame:
    """The first file, by path, whose path holds the token (case aside): ``token, path``.

    A token meets the paths that hold its first three letters (or all of a shorter one), so no
    token is compared with every file.  An empty or null token finds nothing.
    """
    low = F.lower(F.col(path))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))
    held = files.where(F.col(path).isNotNull() & (F.col(path) != "")).select(path, F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("_gram"))
    asked = tokens.where(F.col(token) != "").select(token, F.lower(F.col(token)).alias("_token"), F.substring(F.lower(F.col(token)), 1, 3).alias("_gram"))
    met = asked.join(held, "_gram").where(F.contains(F.lower(F.col(path)), F.col("_token")))
    return met.groupBy(token).agg(F.min(path).alias(path))
