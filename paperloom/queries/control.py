"""Queries of the attempt loop, prompts, token streams and sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import extract
from paperloom.operators.evaluate import issues
from paperloom.operators.json_text import coerced
from paperloom.plans.schema import EVAL_INVOICE, INVOICE, Schema
from paperloom.queries.rendered import SQL_DOCUMENTS, documents
from paperloom.sources import files
from paperloom.streaming.pieces import updates_of_batch
from paperloom.tables import delivered_once, table

ORDER = Schema.record("Order", number=Schema.string("The number of the invoice"), total=Schema.number())


def _faulty(keys: pd.Series, prompts: pd.Series, attempt: int) -> pd.Series:
    """A model with faults by key: fenced, truncated, empty and wrong answers that later
    attempts mend."""
    out = []
    for key in keys:
        good = f'```json\n{{"number": "INV-{key}", "total": "{key}.50"}}\n```'
        wrong = f'{{"number": "INV-{key}", "total": -1}}'
        broken = '{"number": "INV'
        plan = {0: [good], 1: [broken, good], 2: [wrong, wrong, good], 3: [""], 4: [wrong], 5: [broken]}[key % 6]
        out.append(plan[min(attempt, len(plan) - 1)])
    return pd.Series(out, dtype="object")


def _invariants(json_column):
    total = F.get_json_object(json_column, "$.total").try_cast("decimal(18,2)")
    return issues([("total", "a total of nought or more", total, total >= 0)])


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 17 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Invoice "), F.col("o_orderkey").cast("string"))).alias("text"))
    return extract.attempt_loop(docs, "doc_id", ORDER, _faulty, _invariants)


def attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attempts(spark, sf_dir).select("doc_id", "attempt", "status")


def strict_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.outcome(_attempts(spark, sf_dir), "doc_id").select("doc_id", "status", "attempts")


def reported_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract.outcome(_attempts(spark, sf_dir), "doc_id", "report")
    return done.select("doc_id", "status", "attempts", F.coalesce(F.size("issues"), F.lit(0)).alias("issues"))


def _by_chunk(keys: pd.Series, prompts: pd.Series, attempt: int) -> pd.Series:
    """Each chunk gives the last amount it shows as the total."""
    import re

    return pd.Series(['{"number": "INV-%d", "total": "%s"}' % (k, (re.findall(r"\d+\.\d\d", p) or ["0"])[-1]) for k, p in zip(keys, prompts)], dtype="object")


def chunked_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices read in chunks of 120 characters; the better grounded total holds."""
    docs = documents(spark, sf_dir).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    done = extract.chunked_extraction(docs, "doc_id", ORDER, _by_chunk, F.lit(120))
    return done.select("doc_id", "attempt", "status", F.get_json_object("json", "$.number").alias("number"), "chunks_used")


def dynamic_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loose JSON brought to a schema at run time."""
    loose = Schema.record("Loose", key=Schema.integer(), total=Schema.number(), day=Schema.string(format="date"), open=Schema.boolean(), status=Schema.string(values=("o", "f", "p")), note=Schema.string())
    o = table(spark, sf_dir, "orders")
    made = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("key"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("total"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, "yes").otherwise("0").alias("open"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).alias("note"), F.lit("x").alias("dropped")))
    got = o.select("o_orderkey", coerced(made, loose).alias("j"))
    parts = {k: F.get_json_object("j", f"$.{k}").alias(k) for k in ("key", "day", "open", "status", "note", "dropped")}
    return got.select("o_orderkey", *parts.values(), F.get_json_object("j", "$.total").cast("decimal(18,2)").alias("total"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    made = extract.prompt(INVOICE, F.col("text"), locale=F.when(F.col("doc_id") % 2 == 0, F.lit("de_DE")), tables=F.when(F.col("doc_id") % 3 == 0, F.lit("| a |")), repair=F.when(F.col("doc_id") % 5 == 0, F.lit("field `total`: wrong")))
    return d.select("doc_id", (F.contains(made, F.lit("Tables:"))).alias("tables"), F.contains(made, F.lit("refused")).alias("repair"), F.contains(made, F.lit("locale de_DE")).alias("locale"), made.endswith("alone.").alias("closed"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' JSON in pieces of seven characters."""
    d = documents(spark, sf_dir).where("p_number is not null")
    whole = F.concat(F.lit('{"number":"'), F.col("p_number"), F.lit('","total":'), F.col("p_total").cast("string"), F.lit(',"seller":{"name":"'), F.col("seller"), F.lit('"}}'))
    cut = d.select("doc_id", whole.alias("t")).withColumn("n", F.ceil(F.length("t") / 7).cast("int"))
    spread = cut.select("doc_id", "t", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    return spread.select("doc_id", F.col("seq").cast("int").alias("seq"), F.substr("t", F.col("seq") * 7 + 1, F.lit(7)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("is_end"))


def partial_stream_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates_of_batch(_pieces(spark, sf_dir)).groupBy("doc_id").agg(F.count_if(F.col("kind") == "partial").alias("partials"), F.count_if(F.col("kind") == "final").alias("finals"))


def stream_final_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = updates_of_batch(_pieces(spark, sf_dir)).where("kind = 'final'")
    return final.select("doc_id", F.get_json_object("payload", "$.number").alias("number"), F.get_json_object("payload", "$.seller.name").alias("seller"))


def _xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cross-industry invoices, beside another attachment."""
    d = documents(spark, sf_dir)
    xml = F.concat(
        F.lit('<rsm:CrossIndustryInvoice xmlns:rsm="urn:a" xmlns:ram="urn:b" xmlns:udt="urn:c"><rsm:ExchangedDocument><ram:ID>'), F.col("number"), F.lit("</ram:ID><ram:IssueDateTime><udt:DateTimeString format=\"102\">"), F.date_format("issued", "yyyyMMdd"),
        F.lit("</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument><rsm:SupplyChainTradeTransaction><ram:IncludedSupplyChainTradeLineItem><ram:SpecifiedTradeProduct><ram:Name>All goods</ram:Name></ram:SpecifiedTradeProduct><ram:SpecifiedLineTradeDelivery><ram:BilledQuantity>2</ram:BilledQuantity></ram:SpecifiedLineTradeDelivery><ram:SpecifiedLineTradeSettlement><ram:SpecifiedTradeSettlementLineMonetarySummation><ram:LineTotalAmount>"),
        F.col("total").cast("string"), F.lit("</ram:LineTotalAmount></ram:SpecifiedTradeSettlementLineMonetarySummation></ram:SpecifiedLineTradeSettlement></ram:IncludedSupplyChainTradeLineItem><ram:ApplicableHeaderTradeAgreement><ram:SellerTradeParty><ram:Name>"), F.col("seller"),
        F.lit("</ram:Name></ram:SellerTradeParty></ram:ApplicableHeaderTradeAgreement><ram:ApplicableHeaderTradeSettlement><ram:InvoiceCurrencyCode>EUR</ram:InvoiceCurrencyCode><ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:TaxTotalAmount>0.00</ram:TaxTotalAmount><ram:GrandTotalAmount>"), F.col("total").cast("string"),
        F.lit("</ram:GrandTotalAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></ram:ApplicableHeaderTradeSettlement></rsm:SupplyChainTradeTransaction></rsm:CrossIndustryInvoice>"),
    )
    two = F.array(F.struct(F.lit("notes.xml").alias("name"), F.lit("<notes/>").alias("xml")), F.struct(F.when(F.col("doc_id") % 2 == 0, F.lit("Factur-X.xml")).otherwise(F.lit("data.xml")).alias("name"), xml.alias("xml")))
    return d.select("doc_id", F.explode(two).alias("_a")).select("doc_id", "_a.*")


def invoice_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = files.invoice_truth(files.chosen_attachment(_xml(spark, sf_dir), "doc_id"), "doc_id")
    return truth.select("doc_id", "invoice_number", "currency", "seller", F.to_date("issue_date").alias("issued"), F.col("grand_total").cast("decimal(18,2)").alias("grand_total"), F.col("tax_total").cast("decimal(18,2)").alias("tax_total"), F.size("lines").alias("lines"), F.element_at("lines", 1)["line_total"].cast("decimal(18,2)").alias("line_total"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "source_description", "full_text")
    made = i.select("inspection_id", F.coalesce("source_description", F.lit("none")).alias("path"), F.when(F.col("inspection_id") % 2 == 0, F.unhex(F.lit("255044462D312E37"))).otherwise(F.encode(F.coalesce("full_text", F.lit("")), "UTF-8")).alias("content"))
    read = files.ingest_files(made)
    return read.groupBy("kind", "status").agg(F.count("*").alias("n"))


def inspect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text").select(F.col("inspection_id").alias("doc_id"), F.col("full_text").alias("text"))
    blocks = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id", "page_index", "text", "x").select(F.col("inspection_id").alias("doc_id"), F.col("page_index").alias("page"), "text", "x")
    tables = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id", "page_index").select(F.col("inspection_id").alias("doc_id"), F.col("page_index").alias("page"), F.lit(0).alias("table_ix")).where("page is not null")
    return files.inspect(docs, blocks, tables)


def schema_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the record types, in property order, with whether a table would help."""
    rows = [(s.title, i, path, node.format or node.kind, s.has_collection()) for s in (INVOICE, EVAL_INVOICE, ORDER) for i, (path, node) in enumerate(s.leaves())]
    return spark.createDataFrame(rows, "record string, ix int, path string, kind string, collection boolean")


QUERIES = {f.__name__: f for f in (attempt_rows, strict_outcomes, reported_outcomes, chunked_outcomes, dynamic_coerce, prompts, partial_stream_batch, stream_final_parity, invoice_xml, file_kinds, inspect_documents, schema_leaves)}

_OUTCOME = """o as (select o_orderkey as doc_id, o_orderkey % 17 = 0 as blank, o_orderkey % 6 as k from orders)"""

SQL = {
    "attempt_rows": f"""with {_OUTCOME}, n as (select *, unnest(case when blank then ['emptyDocument'] when k = 0 then ['accepted'] when k = 1 then ['failed', 'accepted'] when k = 2 then ['rejected', 'rejected', 'accepted'] when k = 3 then ['emptyResponse'] when k = 4 then ['rejected', 'rejected', 'rejected'] else ['failed', 'failed', 'failed'] end) as status,
        generate_subscripts(case when blank or k in (0, 3) then [1] when k = 1 then [1, 2] else [1, 2, 3] end, 1) - 1 as attempt from o) select doc_id, attempt::int as attempt, status from n""",
    "strict_outcomes": f"with {_OUTCOME} select doc_id, case when blank then 'emptyDocument' when k < 3 then 'accepted' when k = 3 then 'emptyResponse' when k = 4 then 'rejected' else 'failed' end as status, case when blank or k in (0, 3) then 1 when k = 1 then 2 else 3 end as attempts from o",
    "reported_outcomes": f"with {_OUTCOME} select doc_id, case when blank then 'emptyDocument' when k < 3 then 'accepted' when k = 3 then 'emptyResponse' when k = 4 then 'rejected' else 'failed' end as status, case when blank or k in (0, 3) then 1 when k = 1 then 2 else 3 end as attempts, case when not blank and k = 4 then 1 else 0 end as issues from o",
    "dynamic_coerce": """select o_orderkey, o_orderkey::varchar as key, strftime(o_orderdate, '%Y-%m-%d') as day, case when o_orderkey % 2 = 0 then 'true' else 'false' end as open, lower(o_orderstatus) as status, (o_orderkey % 3)::varchar as note, null::varchar as dropped, o_totalprice::decimal(18,2) as total from orders""",
    "prompts": f"with {SQL_DOCUMENTS} select doc_id, doc_id % 3 = 0 as tables, doc_id % 5 = 0 as repair, doc_id % 2 = 0 as locale, true as closed from docs",
    "stream_final_parity": f"with {SQL_DOCUMENTS} select doc_id, p_number as number, seller from docs where p_number is not null",
    "partial_stream_batch": f"""with {SQL_DOCUMENTS}, t as (select doc_id, length('{{"number":"' || p_number || '"') as a, length('{{"number":"' || p_number || '","total":' || p_total || ',') as b, length('{{"number":"' || p_number || '","total":' || p_total || ',"seller":{{"name":"' || seller || '"}}}}') as n from docs where p_number is not null),
        e as (select *, least(unnest(range(7, n + 7, 7)), n) as l from t)
        select doc_id, count(distinct 1 + (l >= a)::int + (l >= b)::int + (l >= n - 1)::int) as partials, 1 as finals from e group by 1""",
    "file_kinds": """with i as (select inspection_id, coalesce(any_value(source_description), 'none') as path, coalesce(any_value(full_text), '') as t from inspections where inspection_id is not null group by 1),
        e as (select *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as ext, regexp_replace(t, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') as clean from i),
        k as (select *, case when inspection_id % 2 = 0 then 'pdf' when t like '%PDF%' and starts_with(t, '%PDF') then 'pdf' when ext = 'pdf' then 'pdf' when ext in ('png', 'jpg', 'jpeg', 'heic', 'heif', 'tif', 'tiff', 'gif', 'bmp', 'webp') then 'image' when ext in ('txt', 'md', 'csv', 'json', 'html', 'xml') then 'text' when clean <> '' and not regexp_matches(t, '[\\x00-\\x08]') then 'text' else 'unreadableSource' end as kind from e)
        select kind, case when kind = 'unreadableSource' then kind when kind = 'text' and clean = '' then 'emptyDocument' else 'ok' end as status, count(*) as n from k group by all""",
    "schema_leaves": "select * from (values "
    + ", ".join(
        f"('{record}', {i}, '{path}', '{kind}', {collection})"
        for record, collection, leaves in (
            ("Invoice", True, "vendor string, dueDate date-time, total number, lineItems[].description string, lineItems[].amount number, lineItems[].quantity integer"),
            ("EvalInvoice", True, "invoiceNumber string, currency string, sellerName string, issueDate date-time, grandTotal number, taxTotal number, lineItems[].description string, lineItems[].quantity number, lineItems[].lineTotal number"),
            ("Order", False, "number string, total number"),
        )
        for i, (path, kind) in enumerate(leaf.split() for leaf in leaves.split(", "))
    )
    + ") as t(record, ix, path, kind, collection)",
    "invoice_xml": f"with {SQL_DOCUMENTS} select doc_id, number as invoice_number, 'EUR' as currency, seller, issued, total as grand_total, 0::decimal(18,2) as tax_total, 1 as lines, total as line_total from docs",
    "inspect_documents": """with i as (select inspection_id as doc_id, any_value(full_text) as t from inspections where inspection_id is not null group by 1), b as (select block_id, any_value(inspection_id) as doc_id, any_value(page_index) as page, any_value(text) as text, any_value(x) as x from blocks where block_id is not null group by 1),
        c as (select doc_id, count(*) filter (trim(text) <> '') as blocks, count(*) filter (trim(text) <> '' and page is not null and x is not null) as positioned, count(distinct page) filter (trim(text) <> '') as pages, count(distinct page) as tables from b group by 1)
        select doc_id, length(regexp_replace(coalesce(t, ''), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'))::int as characters, coalesce(blocks, 0) as blocks, coalesce(positioned, 0) as positioned, coalesce(pages, 0) as pages, coalesce(tables, 0) as tables from i left join c using (doc_id)""",
}
