"""Queries of grounding, merging, JSON and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.dates import date_in_text, moment_text
from paperloom.functions.numbers import DECIMAL, amount_in_text
from paperloom.functions.text import for_search, token_coverage
from paperloom.operators import chunk, grounding, json_text, merge
from paperloom.plans.schema import INVOICE, RECEIPT
from paperloom.queries.rendered import SQL_DOCUMENTS, SQL_LINES, documents, lines
from paperloom.tables import delivered_once, table


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.source_index(documents(spark, sf_dir))


def ground_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _indexed(spark, sf_dir)
    g = lambda c: grounding.ground_string(F.col(c), F.col("text"), F.col("normal_text"))
    return d.select("doc_id", g("seller").alias("seller"), g("p_number").alias("number"), g("p_seller").alias("p_seller"))


def ground_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _indexed(spark, sf_dir)
    g = lambda c: grounding.ground_number(c.cast(DECIMAL), F.col("text"), F.col("skeleton"))
    return d.select("doc_id", g(F.col("total")).alias("total"), g(F.col("p_total")).alias("p_total"))


def ground_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _indexed(spark, sf_dir)
    value = moment_text(F.col("issued").cast("timestamp"))
    return d.select("doc_id", grounding.ground_date(value, F.col("text"), F.col("normal_text")).alias("issued"), date_in_text(F.col("text"), F.col("issued")).alias("shown"), amount_in_text(F.col("text"), F.col("p_total")).alias("amount_shown"))


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _indexed(spark, sf_dir)
    paths = [("number", "string", F.col("p_number")), ("seller", "string", F.col("p_seller")), ("issued", "date", moment_text(F.col("p_issued").cast("timestamp"))), ("total", "number", F.col("p_total")), ("paid", "boolean", F.lit(True))]
    rows = grounding.leaf_rows(d, "doc_id", paths).join(d.select("doc_id", F.col("text").alias("raw"), "normal_text", "skeleton"), "doc_id")
    return rows.withColumn("grounding", grounding.ground_leaf(F.col("kind"), F.col("text"), F.col("number"), F.col("raw"), F.col("normal_text"), F.col("skeleton")))


def leaf_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    return leaves.select("doc_id", "ix", "path", "grounding", grounding.merge_rank(F.col("kind"), F.col("text"), F.col("grounding")).alias("rank"))


def absent_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.absent_paths(_leaves(spark, sf_dir), "doc_id")


def grounding_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators.evaluate import grounding_histogram as histogram

    made = histogram(_leaves(spark, sf_dir).withColumn("has_provenance", F.col("ix") % 2 == 0), "doc_id")
    return made.withColumn("sample_paths", F.array_join("sample_paths", ","))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item texts against the organisations' names as documents of one line."""
    p = table(spark, sf_dir, "part").withColumn("normal", for_search(F.concat_ws(" ", "p_type", "p_name")))
    value = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, F.lit("unheard words here")).otherwise(F.lit("xy")))
    return p.select("p_partkey", token_coverage(value, F.col("normal")).alias("covered"), grounding.entry_is_grounded(F.array(value), F.col("p_name"), F.col("normal")).alias("kept"))


def provenance_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document numbers of identity cards located on the scanned pages."""
    blocks = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id", "ord", "page_index", "text", "x", "y", "w", "h", "matching", "observing").withColumnRenamed("page_index", "page")
    known = delivered_once(table(spark, sf_dir, "identity_documents"), "identity_id", "inspection_id", "document_number", "full_name").where("inspection_id is not null")
    values = known.select("inspection_id", F.explode(F.array(F.struct(F.lit("documentNumber").alias("path"), F.col("document_number").alias("text")), F.struct(F.lit("fullName").alias("path"), F.col("full_name").alias("text")))).alias("_v")).select("inspection_id", "_v.*").distinct()
    found = grounding.provenance(values, blocks, "inspection_id")
    return found.join(grounding.agreement_at(found, blocks, "inspection_id"), ["inspection_id", "path"], "left")


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines in three chunks by line position, with a rival total in each."""
    l = lines(spark, sf_dir).withColumn("chunk", (F.col("line_ix") % 3).cast("int"))
    return l.groupBy("doc_id", "chunk").agg(F.sum("amount").cast("decimal(18,2)").alias("total"), F.min("description").alias("seller"), F.sort_array(F.collect_list(F.struct("line_ix", "description", "amount"))).alias("items"))


def merge_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _partials(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    shown = lambda c: F.when(F.contains(F.col("text"), F.col(c).cast("string")), 2).otherwise(0)
    return merge.merge_scalars(p, "doc_id", "chunk", {"total": shown("total"), "seller": shown("seller")})


def merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = lines(spark, sf_dir).select("doc_id", "line_ix", "description", "quantity")
    again = doubled.withColumn("line_ix", F.col("line_ix") + 1000).withColumn("description", F.concat(F.lit(" "), F.col("description"), F.lit(" ")))
    return merge.merge_arrays(doubled.unionByName(again), "doc_id", "line_ix", ["description", "quantity"])


def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _partials(spark, sf_dir).where("doc_id is not null")  # which no document has; so both sides share one shuffle of the lines
    as_json = F.to_json(F.struct("total", F.struct(F.col("seller").alias("name")).alias("seller"), F.transform("items", lambda i: F.struct(i["description"].alias("description"), i["amount"].alias("amount"))).alias("lineItems")))
    merged = merge.merge_documents(p.select("doc_id", "chunk", as_json.alias("json")), documents(spark, sf_dir), "doc_id")
    return merged.select("doc_id", "merged", F.size("conflicts").alias("conflicts"))


def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs of both record types: the found object, the typed record, its errors."""
    raw = delivered_once(table(spark, sf_dir, "raw_results"), "record_id", "schema_name", "payload").withColumn("json", json_text.found_object(F.col("payload")))
    value = F.get_json_object("json", "$.value")
    invoice, receipt = json_text.decoded(value, INVOICE), json_text.decoded(value, RECEIPT)
    is_invoice = F.col("schema_name") == "Invoice"
    return raw.select(
        "record_id", "schema_name", F.col("json").isNotNull().alias("found"), F.when(is_invoice, invoice["vendor"]).otherwise(receipt["merchant"]).alias("party"), F.when(is_invoice, invoice["total"]).otherwise(receipt["total"]).cast("decimal(18,2)").alias("total"),
        F.when(is_invoice, F.size(json_text.decode_errors(value, INVOICE))).otherwise(F.size(json_text.decode_errors(value, RECEIPT))).alias("errors"),
    )


def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", json_text.variant_at(F.col("props"), "k", "int").alias("k"), json_text.variant_at(F.col("props"), "none").alias("absent"), json_text.compact_json(F.col("props")).alias("compact"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id", "ord", "page_index", "text")
    named = blocks.select(F.col("inspection_id").alias("doc_id"), "ord", F.col("page_index").alias("page"), "text")
    return chunk.document_text(named).select("doc_id", F.length("full_text").alias("characters"), F.md5("full_text").alias("digest"))


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text").where("full_text is not null")
    pages = docs.select("inspection_id", F.split("full_text", "\n\n").alias("pages"))
    made = chunk.chunk_documents(pages, "inspection_id", "pages", F.lit(2000))
    return made.groupBy("inspection_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("characters"))


def chunk_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return docs.select("doc_id", chunk.resolved_budget("automatic", F.col("n")).alias("automatic"), chunk.resolved_budget("fixed", F.col("n"), 400).alias("fixed"), chunk.resolved_budget("none", F.col("n")).alias("none"))


def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    chunks = d.select("doc_id", F.lit(0).alias("chunk_ix"), F.col("text").alias("chunk")).unionByName(d.select("doc_id", F.lit(1).alias("chunk_ix"), F.substring("text", 1, 40).alias("chunk")))
    tables = lines(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("description").alias("cells")).withColumn("table_ix", F.lit(0))
    return chunk.tables_in_chunks(chunks, tables)


def scanned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id", "page_index", "text", "x", "y", "w", "h").withColumnRenamed("page_index", "page")
    return chunk.positioned(chunk.filled_blocks(blocks)).groupBy("inspection_id").agg(F.count("*").alias("blocks"), F.count_distinct("page").alias("pages"))


QUERIES = {f.__name__: f for f in (ground_strings, ground_numbers, ground_dates, leaf_grounding, absent_fields, grounding_histogram, coverage, provenance_blocks, merge_scalars, merge_arrays, merge_documents, payload_decode, json_members, document_pages, chunk_stats, chunk_budgets, chunk_tables, scanned_blocks)}

_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
_INDEXED = SQL_DOCUMENTS + f", indexed as (select *, {_NORM.format('text')} as norm from docs)"


_PLAIN = "regexp_replace(regexp_replace({0}::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def _string_sql(column: str) -> str:
    return f"case when coalesce({column}, '') = '' then 'absent' when contains(text, {column}) then 'verbatim' when contains(norm, {_NORM.format(column)}) then 'normalized' else 'absent' end"


def _number_sql(column: str) -> str:
    compact = f"regexp_replace(regexp_replace({column}::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    forms = f"case when round({column}, 0) = {column} then [{compact}, {column}::decimal(18,0)::varchar, {column}::varchar] else [{compact}, {column}::varchar, {column}::decimal(18,1)::varchar] end"
    return f"case when len(list_filter({forms}, lambda c: regexp_matches(text, '(^|[^-−﹣－])' || replace(c, '.', '\\.')))) > 0 then 'verbatim' else 'reformatted' end"


def _amount_sql(column: str) -> str:
    compact = f"regexp_replace(regexp_replace({column}::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
    return f"len(list_filter([{compact}, replace({compact}, '.', ','), {column}::varchar, replace({column}::varchar, '.', ','), format('{{:,.2f}}', {column}::double), translate(format('{{:,.2f}}', {column}::double), ',.', '.,')], lambda c: contains(text, c))) > 0"


_LEAVES = f"""{_INDEXED},
leaves as (
    select doc_id, 0 as ix, 'number' as path, case when p_number is null then 'reformatted' else {_string_sql('p_number')} end as grounding, 'string' as kind, p_number as t from indexed
    union all select doc_id, 1, 'seller', {_string_sql('p_seller')}, 'string', p_seller from indexed
    union all select doc_id, 2, 'issued', case when contains(text, p_issued::varchar) then 'verbatim' when contains(norm, {_NORM.format('p_issued::varchar')}) then 'normalized' else 'reformatted' end, 'date', p_issued::varchar from indexed
    union all select doc_id, 3, 'total', {_number_sql('p_total')}, 'number', p_total::varchar from indexed
    union all select doc_id, 4, 'paid', 'reformatted', 'boolean', 'true' from indexed)"""

SQL = {
    "ground_strings": f"with {_INDEXED} select doc_id, {_string_sql('seller')} as seller, {_string_sql('p_number')} as number, {_string_sql('p_seller')} as p_seller from indexed",
    "ground_numbers": f"with {_INDEXED} select doc_id, {_number_sql('total')} as total, {_number_sql('p_total')} as p_total from indexed",
    "ground_dates": f"with {_INDEXED} select doc_id, case when contains(text, issued::varchar) then 'verbatim' when contains(norm, {_NORM.format('issued::varchar')}) then 'normalized' else 'reformatted' end as issued, contains(text, issued::varchar) or contains(text, strftime(issued, '%Y%m%d')) or contains(text, strftime(issued, '%d.%m.%Y')) as shown, {_amount_sql('p_total')} as amount_shown from indexed",
    "leaf_grounding": f"with {_LEAVES} select doc_id, ix, path, grounding, case when kind in ('string', 'number') then case grounding when 'verbatim' then 2 when 'normalized' then 1 else 0 end else 0 end as rank from leaves",
    "absent_fields": f"with {_LEAVES} select doc_id, path from leaves where grounding = 'absent'",
    "grounding_histogram": f"""with {_LEAVES} select doc_id, count(*) filter (grounding = 'verbatim') as verbatim, count(*) filter (grounding = 'normalized') as normalized, count(*) filter (grounding = 'reformatted') as reformatted, count(*) filter (grounding = 'absent') as absent,
        count(*) filter (ix % 2 = 0) as with_provenance, count(*) filter (grounding in ('verbatim', 'normalized') and ix % 2 = 1) as grounded_without, coalesce(string_agg(path, ',' order by ix) filter (grounding in ('verbatim', 'normalized') and ix % 2 = 1), '') as sample_paths from leaves group by 1""",
    "coverage": f"""with p as (select *, {_NORM.format("p_type || ' ' || p_name")} as norm, p_name || ' ' || case when p_size % 2 = 0 then 'unheard words here' else 'xy' end as v from part),
        t as (select *, list_filter(string_split({_NORM.format('v')}, ' '), lambda x: length(x) >= 3) as tokens from p),
        c as (select *, len(tokens) > 0 and len(list_filter(tokens, lambda x: contains(norm, x))) * 2 >= len(tokens) as covered from t)
        select p_partkey, covered, contains(p_name, v) or contains(norm, {_NORM.format('v')}) or covered as kept from c""",
    "provenance_blocks": f"""
        with b as (select block_id, any_value(inspection_id) as doc, any_value(ord) as ord, any_value(page_index) as page, any_value(text) as text, any_value(x) as x, any_value(y) as y, any_value(w) as w, any_value(h) as h, any_value(matching) as matching, any_value(observing) as observing from blocks where block_id is not null group by 1),
        p as (select *, {_NORM.format('text')} as norm, row_number() over o as i, coalesce(sum(length(text) + 1) over (o rows between unbounded preceding and 1 preceding), 0) as pos from b where page is not null and x is not null window o as (partition by doc order by page, ord, y, x, text)),
        k as (select identity_id, any_value(inspection_id) as doc, any_value(document_number) as number, any_value(full_name) as name from identity_documents where identity_id is not null group by 1),
        v as (select *, {_NORM.format('value')} as vnorm, greatest(4 * length(value), length(value) + 80) as cap from (select doc, 'documentNumber' as path, number as value from k union select doc, 'fullName', name from k) where doc is not null and value <> ''),
        one as (select doc, path, 2 as step, [w * h, page, ord]::double[] as tie, page, x, y, w, h from v join p using (doc) where contains(text, value) or vnorm <> '' and contains(norm, vnorm)),
        texts as (select doc, list(text order by i) as l from p group by 1),
        spans as (select v.doc, v.path, a.i, z.i as j, a.pos, a.page, z.page as last from v join p a on a.doc = v.doc join p z on z.doc = v.doc and z.i > a.i and z.pos - a.pos <= v.cap + 1 join texts t on t.doc = v.doc
            where contains(array_to_string(l[a.i:z.i], ' '), value) or vnorm <> '' and contains({_NORM.format("array_to_string(l[a.i:z.i], ' ')")}, vnorm)),
        runs as (select doc, path, unnest(case when page = last then [3, 4] else [4] end) as step, i, j, page, pos from spans),
        offs as (select r.*, r.pos - case when step = 3 then (select min(f.pos) from p f where f.doc = r.doc and f.page = r.page) else 0 end as own_at from runs r),
        boxed as (select r.doc, r.path, r.step, [r.j - r.i + 1, r.page, r.own_at]::double[] as tie, r.page, min(q.x) as x, min(q.y) as y, max(q.x + q.w) - min(q.x) as w, max(q.y + q.h) - min(q.y) as h from offs r join p q on q.doc = r.doc and q.page = r.page and q.i between r.i and r.j group by r.doc, r.path, r.step, r.i, r.j, r.page, r.own_at),
        best as (select doc, path, arg_min({{'step': step, 'page': page, 'x': x, 'y': y, 'w': w, 'h': h}}, {{'step': step, 'tie': tie}}) as f from (from one union all from boxed) group by 1, 2),
        g as (select doc, path, arg_min({{'m': matching, 'o': observing}}, {{'s': matching / greatest(observing, 1), 'm': matching}}) as a from best join b using (doc) where b.page = f.page and f.x < b.x + b.w and b.x < f.x + f.w and f.y < b.y + b.h and b.y < f.y + f.h group by 1, 2)
        select doc as inspection_id, path, f.step as step, f.page as page, f.x as x, f.y as y, f.w as w, f.h as h, a.m as matching, a.o as observing from best left join g using (doc, path)""",
    "chunk_stats": r"""
        with recursive d as (select inspection_id as doc, list_filter(string_split(any_value(full_text), chr(10) || chr(10)), lambda x: x <> '') as pages from inspections where inspection_id is not null and full_text is not null group by 1),
        z as (select *, list_sum(list_transform(pages, lambda x: length(x))) as total from d where len(pages) > 0),
        step as (
            select doc, pages, 1 as i, 0 as start, 0 as size, 0 as n, []::bigint[] as made from z where total > 2000
            union all
            select doc, pages,
                case when i > len(pages) then i + 1 when l <= 2000 or start + 2000 >= l or cut >= l then i + 1 else i end,
                case when i > len(pages) or l <= 2000 or start + 2000 >= l or cut >= l then 0 else cut end,
                case when i > len(pages) or l > 2000 then 0 when size + l > 2000 then l else size + l end,
                case when i > len(pages) or l > 2000 then 0 when size + l > 2000 then 1 else n + 1 end,
                case when i > len(pages) then case when n > 0 then [size + n - 1] else [] end
                    when l > 2000 then list_concat(case when n > 0 then [size + n - 1] else [] end, [case when start + 2000 >= l then l - start else cut - start end])
                    when size + l > 2000 and n > 0 then [size + n - 1] else [] end
            from (
                select *, coalesce(length(pages[i]), 0) as l, start + 2000 as hard,
                    case when lb > 0 then start + 2000 - length(back) + lb when la > 0 then start + 2000 + la when sb > 0 then start + 2000 - length(back) + sb when sa > 0 then start + 2000 + sa else start + 2000 end as cut
                from (
                    select *, length(regexp_replace(back, '[^\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]*$', '')) as lb, length(regexp_extract(ahead, '^[^\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]*[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]')) as la,
                        length(regexp_replace(back, '[^\s\x0b\x1c-\x1f\x{85}\p{Z}]*$', '')) as sb, length(regexp_extract(ahead, '^[^\s\x0b\x1c-\x1f\x{85}\p{Z}]*[\s\x0b\x1c-\x1f\x{85}\p{Z}]')) as sa
                    from (select *, substr(pages[i], start + 2001 - WINDOW, WINDOW) as back, substr(pages[i], start + 2001, WINDOW) as ahead from step where i <= len(pages) + 1)
                )
            )
        ),
        chunks as (select doc, unnest(made) as n from step union all select doc, total + len(pages) - 1 from z where total <= 2000)
        select doc as inspection_id, count(*) as chunks, max(n)::int as longest, sum(n)::bigint as characters from chunks group by 1""".replace("WINDOW", str(chunk.SPLIT_WINDOW)).replace("\\\\", "\\"),
    "merge_documents": f"""with {SQL_DOCUMENTS}, l as (select *, line_ix % 3 as chunk from lines),
        p as (select doc_id, chunk, sum(amount)::decimal(18,2) as total, min(description) as seller from l group by all),
        r as (select p.*, case when {_number_sql('p.total')} = 'verbatim' and (length(regexp_replace(p.total::varchar, '[^0-9]', '', 'g')) >= 3) then 2 else 0 end as tr, row_number() over (partition by doc_id order by chunk) as k from p join docs using (doc_id)),
        b as (select doc_id, max(tr) as best, arg_min(total, (-tr, k)) as total, min(k) filter (true) as k0, arg_min(seller, k) as seller, arg_min(k, (-tr, k)) as won from r group by 1),
        c as (select doc_id, count(*) filter (r.tr = best and r.k > won and r.total <> b.total) > 0 as tc, count(*) filter (r.seller <> b.seller) > 0 as sc from r join b using (doc_id) group by 1),
        f as (select doc_id, description, amount, min((chunk, line_ix)) as first from l group by all),
        i as (select doc_id, string_agg('{{"amount":' || {_PLAIN.format('amount')} || ',"description":"' || description || '"}}', ',' order by first) as items from f group by 1)
        select doc_id, '{{"lineItems":[' || items || '],"seller":{{"name":"' || seller || '"}},"total":' || {_PLAIN.format('total')} || '}}' as merged, (tc::int + sc::int) as conflicts from b join c using (doc_id) join i using (doc_id)""",
    "merge_scalars": f"""with {SQL_DOCUMENTS}, p as (select doc_id, line_ix % 3 as chunk, sum(amount)::decimal(18,2) as total, min(description) as seller from lines group by all),
        r as (select p.*, case when contains(text, p.total::varchar) then 2 else 0 end as tr, case when contains(text, p.seller) then 2 else 0 end as sr from p join docs using (doc_id)),
        b as (select doc_id, max(tr) as mt, max(sr) as ms from r group by 1)
        select doc_id, arg_min(total, chunk) filter (tr = mt) as total, count(distinct total) filter (tr = mt) > 1 as total_conflict, arg_min(seller, chunk) filter (sr = ms) as seller, count(distinct seller) filter (sr = ms) > 1 as seller_conflict from r join b using (doc_id) group by 1""",
    "merge_arrays": f"""with {SQL_LINES}, f as (select doc_id, description, quantity, min(line_ix) as first from lines group by all)
        select doc_id, (row_number() over (partition by doc_id order by first) - 1)::int as position, description, quantity from f""",
    "json_members": "select event_id, (props->>'$.k')::int as k, null::varchar as absent, replace(replace(props, ': ', ':'), ', ', ',') as compact from events",
    "document_pages": """with b as (select block_id, any_value(inspection_id) as doc_id, any_value(ord) as ord, any_value(page_index) as page, regexp_replace(any_value(text), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as text from blocks where block_id is not null group by 1),
        p as (select doc_id, page, string_agg(text, chr(10) order by ord, text) as body from b where text <> '' group by all),
        h as (select doc_id, coalesce(page, -1) as page, case when page is null then body else '--- Page ' || (page + 1) || ' ---' || chr(10) || body end as body from p),
        d as (select doc_id, string_agg(body, chr(10) || chr(10) order by page) as full_text from h group by 1)
        select doc_id, length(full_text)::int as characters, md5(full_text) as digest from d""",
    "chunk_budgets": "select doc_id, case when length(coalesce(text, '')) > 12000 then 12000 else 0 end as automatic, 400 as fixed, 0 as none from documents",
    "chunk_tables": f"""with {SQL_DOCUMENTS}, c as (select doc_id, 0 as chunk_ix, text as chunk from docs union all select doc_id, 1, substr(text, 1, 40) from docs)
        select doc_id, chunk_ix, 0 as table_ix from c join lines using (doc_id) group by all having bool_and(contains(chunk, description))""",
    "scanned_blocks": """with b as (select block_id, any_value(inspection_id) as inspection_id, any_value(page_index) as page, any_value(text) as text, any_value(x) as x, any_value(y) as y, any_value(w) as w, any_value(h) as h from blocks where block_id is not null group by 1)
        select inspection_id, count(*) as blocks, count(distinct page) as pages from b where regexp_replace(text, '[\\s\\p{Z}]', '', 'g') <> '' and page is not null and x is not null and y is not null and w is not null and h is not null group by 1""",
}
