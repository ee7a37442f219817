"""Queries of corpus evaluation: joins of truth and prediction, accuracy, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import for_scoring
from paperloom.operators import evaluate
from paperloom.queries.rendered import SQL_DOCUMENTS, SQL_LINES, documents, lines
from paperloom.tables import delivered_once, table

FIELDS = [("invoiceNumber", "text", "number", "p_number"), ("sellerName", "party", "seller", "p_seller"), ("issueDate", "date", "issued", "p_issued"), ("grandTotal", "amount", "total", "p_total")]


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.header_scores(documents(spark, sf_dir), "doc_id", FIELDS)


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("doc_id", "field", "correct", "present", "hard_failure")


def accuracy_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_scores(spark, sf_dir))


def accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy(_scores(spark, sf_dir), by_field=False)


def failure_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failure_share(documents(spark, sf_dir))


def pairing_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", evaluate.pairing_guard(F.col("text"), F.col("p_number"), F.col("p_seller"), F.col("p_total")).alias("paired"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines a model gives: some dropped, the descriptions of others cut."""
    shown = F.when(F.col("line_ix") % 3 == 0, F.substring_index("description", " ", 2)).otherwise(F.upper("description"))
    return lines(spark, sf_dir).where("not dropped").withColumn("description", shown)


def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.match_lines(lines(spark, sf_dir), _predicted(spark, sf_dir), "doc_id")


def lost_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.lost_lines(lines(spark, sf_dir), _predicted(spark, sf_dir), "doc_id").select("doc_id", "line_ix")


def extra_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _predicted(spark, sf_dir).withColumn("description", F.when(F.col("quantity") % 10 == 0, F.lit("an invented thing")).otherwise(F.col("description")))
    return evaluate.lost_lines(other, lines(spark, sf_dir), "doc_id").select("doc_id", "line_ix")


def dup_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.duplicate_lines(lines(spark, sf_dir), "doc_id")


def invariant_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lines(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("amount")).alias("_a"), F.sum("amount").alias("total"))
    items = F.when(F.col("doc_id") % 6 == 0, F.array_append(F.transform("_a", lambda x: x["amount"]), F.lit(None).cast("decimal(18,2)"))).otherwise(F.transform("_a", lambda x: x["amount"]))
    total = F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 7 == 0, F.col("total") + 1).when(F.col("doc_id") % 8 == 0, F.col("total") + F.lit("0.01").cast("decimal(18,2)")).otherwise(F.col("total"))
    return per.select("doc_id", evaluate.invariant_state(items, total, F.lit(None).cast("decimal(18,2)")).alias("state"))


def invariant_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invariant_tristate(spark, sf_dir).agg(F.count_if(F.col("state") != "skipped").alias("checks"), F.count_if(F.col("state") == "violated").alias("violations"), F.count_if(F.col("state") == "skipped").alias("skips"))


def invariant_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    found = evaluate.issues([("total", "the sum of the lines", F.col("p_total"), F.abs(F.col("p_total") - F.col("total")) <= 0.01), ("number", "a number", F.col("p_number"), F.col("p_number").isNotNull())])
    return d.select("doc_id", F.array_join(F.transform(found, lambda i: i["path"]), ",").alias("paths"), F.size(found).alias("issues"))


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = _scores(spark, sf_dir)
    b = a.where((F.col("doc_id") % 3 != 0) | (F.col("field") != "issueDate")).withColumn("correct", F.when(F.col("doc_id") % 2 == 0, F.lit(True)).otherwise(F.col("correct")))
    return a.select("doc_id", "field", "correct"), b.select("doc_id", "field", "correct")


def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.arm_deltas(evaluate.compare_arms(*_arms(spark, sf_dir), "doc_id"))


def ab_changed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.compare_arms(*_arms(spark, sf_dir), "doc_id").where("a_correct <> b_correct")


def key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _arms(spark, sf_dir)
    return a.select("field").union(b.select("field")).distinct().orderBy("field")


def survey_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text", "used_ocr_fallback", "page_count")
    n = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id").groupBy("inspection_id").agg(F.count("*").alias("blocks"))
    docs = i.join(n, "inspection_id", "left").select(F.when(F.coalesce("full_text", F.lit("")) == "", "error").otherwise("ok").alias("status"), F.coalesce("used_ocr_fallback", F.lit(False)).alias("used_ocr"), (F.coalesce("page_count", F.lit(0)) > 3).alias("shaped"), F.coalesce("page_count", F.lit(0)).alias("tables"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.length(F.coalesce("full_text", F.lit(""))).alias("characters"))
    made = evaluate.survey(docs)
    return made.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = delivered_once(table(spark, sf_dir, "chunk_merge_arms"), "arm_id", "inspection_id", "arm_name", "chunks_used", "attempts", "extraction_error")
    one = arms.groupBy("inspection_id", "arm_name").agg(F.max("chunks_used").alias("chunks_used"), F.max("attempts").alias("attempts"), F.max(F.col("extraction_error").isNotNull()).alias("failed"))
    made = one.select(F.col("arm_name").alias("arm"), "inspection_id", "failed", F.coalesce("chunks_used", F.lit(0)).alias("lines"), F.coalesce("attempts", F.lit(0)).alias("true_lines"), F.coalesce("chunks_used", F.lit(0)).alias("conflicts"), F.lit(4).alias("leaves"), F.least(F.coalesce("attempts", F.lit(0)), F.lit(4)).alias("placed"), (F.coalesce("attempts", F.lit(0)) > 1).alias("triggered"), (~F.col("failed")).alias("recovered"))
    names = F.array(*[F.lit(x) for x in ("invoiceNumber", "grandTotal", "lineItems[0].description", "lineItems[0].lineTotal")])
    fields = made.select("arm", "inspection_id", "lines", F.posexplode(names).alias("_i", "field")).select("arm", "inspection_id", "field", ((F.col("lines") + F.col("_i")) % 3 != 0).alias("correct"))
    out = evaluate.merge_report(made, fields, "inspection_id")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def anchor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text", "page_count")
    kinds = F.array(*[F.lit(k) for k in ("textContains", "sellerEquals", "minTables", "tableContainsCells", "lineItemShaped")])
    spread = i.select("inspection_id", "full_text", "page_count", F.explode(kinds).alias("kind"))
    n = F.coalesce("page_count", F.lit(0))
    sizes = F.array_repeat(F.coalesce("page_count", F.lit(0)), 2)
    result = evaluate.anchor_result(F.col("kind"), F.array(F.lit("invoice")), F.lit("agreement"), F.lit(2), F.col("full_text"), F.array(F.lit("Invoice no")), sizes, F.array_repeat(F.lit(4), 2), F.array_repeat(F.when(n % 2 == 0, 0.9).otherwise(0.5), 2))
    return spread.select("inspection_id", "kind", result.alias("status"))


def anchor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "source_description").select(F.col("source_description").alias("path")).where("path is not null")
    tokens = spark.createDataFrame([(t,) for t in ("scan", "PDF", "a", "nowhere")], "token string")
    return evaluate.resolve_files(tokens, files)


def collected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two lists of files, scanned ones and ones with blocks, as a whole."""
    i = table(spark, sf_dir, "inspections").withColumnRenamed("source_description", "path")
    return evaluate.union_files(i.where("used_ocr_fallback"), i.join(table(spark, sf_dir, "blocks"), "inspection_id", "left_semi"))


def file_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve of a report, as its SQL has it: of the scanned files and the others."""
    i = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "source_description", "used_ocr_fallback").withColumnRenamed("source_description", "path")
    scanned = F.coalesce("used_ocr_fallback", F.lit(False))
    return evaluate.union_files(i.where(scanned), i.where(~scanned)).limit(12)


QUERIES = {f.__name__: f for f in (field_scores, accuracy_by_field, accuracy_overall, failure_share, pairing_guard, match_lines, lost_items, extra_items, dup_items, invariant_tristate, invariant_counters, invariant_issues, ab_compare, ab_changed_docs, key_union, survey_summary, merge_report, anchor_checks, anchor_files, collected_files, file_union)}

_FORM = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"
_AMOUNT = """len(list_filter([regexp_replace(regexp_replace(total::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), replace(regexp_replace(regexp_replace(total::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '.', ','), total::varchar, replace(total::varchar, '.', ','), format('{:,.2f}', total::double), translate(format('{:,.2f}', total::double), ',.', '.,')], lambda c: contains(text, c))) > 0"""
_P_AMOUNT = _AMOUNT.replace("total", "p_total")
_SCORES = f"""{SQL_DOCUMENTS}, f as (select *, {_FORM.format('text')} as nt, {_FORM.format('number')} as nn, {_FORM.format('p_number')} as pn, {_FORM.format('seller')} as ns, {_FORM.format('p_seller')} as ps from docs),
scores as (
    select doc_id, 'invoiceNumber' as field, coalesce(nn = pn, false) and not hard_failure as correct, contains(nt, nn) as present, hard_failure from f
    union all select doc_id, 'sellerName', coalesce(ns = ps or contains(ns, ps) or contains(ps, ns), false) and not hard_failure, contains(nt, ns), hard_failure from f
    union all select doc_id, 'issueDate', coalesce(issued = p_issued, false) and not hard_failure, contains(text, issued::varchar) or contains(text, strftime(issued, '%Y%m%d')) or contains(text, strftime(issued, '%d.%m.%Y')), hard_failure from f
    union all select doc_id, 'grandTotal', coalesce(abs(total - p_total) <= 0.02, false) and not hard_failure, {_AMOUNT}, hard_failure from f)"""
_ACCURACY = """count(*) filter (not hard_failure and correct) as correct, count(*) filter (not hard_failure) as total, count(*) filter (not hard_failure and present and correct) as present_correct, count(*) filter (not hard_failure and present) as present_total,
    count(*) filter (not hard_failure and correct) as inclusive_correct, count(*) as inclusive_total, coalesce(count(*) filter (not hard_failure and correct) / nullif(count(*) filter (not hard_failure), 0), 0) as accuracy,
    coalesce(count(*) filter (not hard_failure and present and correct) / nullif(count(*) filter (not hard_failure and present), 0), 0) as present_accuracy, coalesce(count(*) filter (not hard_failure and correct) / nullif(count(*), 0), 0) as inclusive_accuracy"""
_PREDICTED = f"{SQL_LINES}, predicted as (select doc_id, line_ix, case when line_ix % 3 = 0 then split_part(description, ' ', 1) || ' ' || split_part(description, ' ', 2) else upper(description) end as description, quantity from lines where not dropped)"
_MEET = "(lower(a.description) = lower(b.description) or contains(lower(a.description), lower(b.description)) or contains(lower(b.description), lower(a.description)))"
_STATE = f"""{SQL_LINES}, per as (select doc_id, sum(amount) as s from lines group by 1),
    st as (select doc_id, case when doc_id % 6 = 0 or doc_id % 5 = 0 then 'skipped' when doc_id % 7 = 0 then 'violated' else 'ok' end as state from per)"""
_ARMS = f"{_SCORES}, a as (select doc_id, field, correct from scores), b as (select doc_id, field, case when doc_id % 2 = 0 then true else correct end as correct from scores where doc_id % 3 <> 0 or field <> 'issueDate'), both_arms as (select doc_id, field, coalesce(a.correct, false) as a_correct, coalesce(b.correct, false) as b_correct from a full join b using (doc_id, field))"

SQL = {
    "field_scores": f"with {_SCORES} select * from scores",
    "accuracy_by_field": f"with {_SCORES} select field, {_ACCURACY} from scores group by grouping sets ((field), ())",
    "accuracy_overall": f"with {_SCORES} select {_ACCURACY} from scores",
    "failure_share": f"with {SQL_DOCUMENTS} select count(*) as documents, count(*) filter (hard_failure) as failures, count(*) filter (hard_failure) / count(*) as failure_share from docs",
    "pairing_guard": f"with {SQL_DOCUMENTS}, f as (select *, {_FORM.format('text')} as nt from docs) select doc_id, case when p_number is not null then contains(nt, lower(p_number)) else contains(nt, {_FORM.format('p_seller')}) or {_P_AMOUNT} end as paired from f",
    "match_lines": f"with {_PREDICTED} select a.doc_id, a.line_ix, min(b.line_ix) as match_ix from lines a left join predicted b on a.doc_id = b.doc_id and {_MEET} group by all",
    "lost_items": f"with {_PREDICTED} select doc_id, line_ix from lines a where not exists (from predicted b where a.doc_id = b.doc_id and {_MEET})",
    "extra_items": f"with {_PREDICTED}, o as (select doc_id, line_ix, case when quantity % 10 = 0 then 'an invented thing' else description end as description from predicted) select doc_id, line_ix from o a where not exists (from lines b where a.doc_id = b.doc_id and {_MEET})",
    "dup_items": f"with {SQL_LINES} select doc_id, count(*) - count(distinct lower(description)) as duplicates from lines group by 1",
    "invariant_tristate": f"with {_STATE} select * from st",
    "invariant_counters": f"with {_STATE} select count(*) filter (state <> 'skipped') as checks, count(*) filter (state = 'violated') as violations, count(*) filter (state = 'skipped') as skips from st",
    "invariant_issues": f"with {SQL_DOCUMENTS} select doc_id, concat_ws(',', case when abs(p_total - total) > 0.01 then 'total' end, case when p_number is null then 'number' end) as paths, (abs(p_total - total) > 0.01)::int + (p_number is null)::int as issues from docs",
    "ab_compare": f"with {_ARMS} select field, count(*) as total, count(*) filter (a_correct) as a, count(*) filter (b_correct) as b, 100.0 * (count(*) filter (b_correct) - count(*) filter (a_correct)) / count(*) as delta_pp from both_arms group by grouping sets ((field), ())",
    "ab_changed_docs": f"with {_ARMS} select * from both_arms where a_correct <> b_correct",
    "key_union": "select unnest(['invoiceNumber', 'sellerName', 'issueDate', 'grandTotal']) as field",
    "survey_summary": """with i as (select inspection_id, any_value(full_text) as t, any_value(used_ocr_fallback) as o, any_value(page_count) as p from inspections where inspection_id is not null group by 1), n as (select inspection_id, count(distinct block_id) as b from blocks group by 1),
        d as (select coalesce(t, '') <> '' as ok, coalesce(o, false) as o, coalesce(p, 0) as p, coalesce(b, 0) as b, length(coalesce(t, '')) as c from i left join n using (inspection_id))
        select count(*) filter (ok) as ok, count(*) filter (not ok) as errors, count(*) filter (ok and o) as ocr, count(*) filter (ok and p > 3) as shaped, round(count(*) filter (ok and p > 3) / greatest(count(*) filter (ok), 1), 4) as shaped_share,
            round(coalesce(avg(p) filter (ok), 0), 4) as mean_tables, round(coalesce(avg(b) filter (ok), 0), 4) as mean_blocks, round(coalesce(avg(c) filter (ok), 0), 4) as mean_characters from d""",
    "merge_report": """with x as (select arm_id, any_value(inspection_id) as i, any_value(arm_name) as arm, any_value(chunks_used) as c, any_value(attempts) as t, any_value(extraction_error) as e from chunk_merge_arms where arm_id is not null group by 1),
        o as (select i, arm, coalesce(max(c), 0) as lines, coalesce(max(t), 0) as t, bool_or(e is not null) as failed from x group by all),
        k as (select i from o where not failed group by 1 having count(distinct arm) >= 2),
        a as (select o.*, k.i is not null as paired from o left join k on o.i = k.i),
        m as (select arm, count(*) as documents, count(*) filter (failed) as failures, count(*) filter (paired and lines = t) as exact_line_counts, count(*) filter (paired) as both_ok, coalesce(avg(lines) filter (not failed), 0) as mean_conflicts, sum(least(t, 4)) / (4 * count(*)) as provenance_rate,
            count(*) filter (t > 1) as triggered, count(*) filter (t > 1 and not failed) as recovered, count(*) filter (t > 1 and failed) as unrecovered from a group by 1),
        f as (select arm, unnest([0, 1, 2, 3]) as ix, lines from o), g as (select arm, case when ix < 2 then 'header' when ix = 2 then 'description' else 'amount' end as role, (lines + ix) % 3 <> 0 as ok from f),
        r as (select arm, count(*) filter (role = 'header' and ok) as header_correct, count(*) filter (role = 'description' and ok) as description_correct, count(*) filter (role = 'amount' and ok) as amount_correct,
            count(*) filter (role = 'header') as header_total, count(*) filter (role = 'description') as description_total, count(*) filter (role = 'amount') as amount_total, count(*) filter (ok) as all_correct, count(*) as all_total from g group by 1)
        select m.* replace (round(mean_conflicts, 6) as mean_conflicts, round(provenance_rate, 6) as provenance_rate), r.* exclude (arm) from m left join r on m.arm is not distinct from r.arm""",
    "anchor_checks": """with i as (select inspection_id, any_value(full_text) as t, coalesce(any_value(page_count), 0) as p from inspections where inspection_id is not null group by 1), k as (select *, unnest(['textContains', 'sellerEquals', 'minTables', 'tableContainsCells', 'lineItemShaped']) as kind from i)
        select inspection_id, kind, case when t is null then 'skipped' when case kind when 'textContains' then contains(lower(t), 'agreement') when 'sellerEquals' then contains(lower(t), 'agreement') when 'minTables' then true when 'tableContainsCells' then true else p >= 3 and p % 2 = 0 end then 'passed' else 'failed' end as status from k""",
    "anchor_files": """with f as (select distinct source_description as path from inspections where source_description is not null), t as (select unnest(['scan', 'PDF', 'a', 'nowhere']) as token)
        select token, min(path) as path from t join f on contains(lower(path), lower(token)) group by 1""",
    "collected_files": """select source_description as path from inspections where source_description is not null and used_ocr_fallback
        union select source_description from inspections where source_description is not null and inspection_id in (select inspection_id from blocks) order by 1""",
    "file_union": "select distinct source_description as path from inspections where source_description is not null order by 1 limit 12",
}
