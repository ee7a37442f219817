"""Queries of tree walks, numeric places, locales, attachments, streams and late answers."""

from __future__ import annotations

import os
import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.dates import DAY_FIRST_ELSEWHERE, MONTH_FIRST_ELSEWHERE, MONTH_FIRST_ENGLISH, MONTH_FIRST_LANGUAGES, parse_moment
from paperloom.functions.text import LATIN_LANGUAGES, latin_only
from paperloom.operators import extract, grounding
from paperloom.plans.schema import EVAL_INVOICE, Schema
from paperloom.queries.rendered import SQL_DOCUMENTS, documents, lines
from paperloom.session import shared_folder
from paperloom.sources import files
from paperloom.streaming.pieces import record_updates, until_cancelled, updates_of_batch
from paperloom.tables import table


def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the orders' predictions as nested records."""
    item = F.struct(F.when(~F.col("dropped"), F.col("description")).alias("description"), F.col("quantity").alias("quantity"), F.col("amount").alias("lineTotal"))
    held = lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_ix", item.alias("item")))), lambda r: r["item"]).alias("lineItems"))
    d = documents(spark, sf_dir).join(held, "doc_id")
    record = F.to_json(F.struct(F.col("p_number").alias("invoiceNumber"), F.col("p_seller").alias("sellerName"), F.col("p_issued").cast("string").alias("issueDate"), F.col("p_total").alias("grandTotal"), "lineItems"))
    found = grounding.json_leaves(d.select("doc_id", record.alias("json")), "doc_id", "json", EVAL_INVOICE)
    return found.select("doc_id", "ix", "path", "kind", "text")


def numeric_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals located on a page that prints them with currency signs and grouping marks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    english = F.format_number("total", 2)
    texts = [F.concat(F.lit("Order "), F.col("doc_id").cast("string")), F.concat(F.lit("Net 0."), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Total $"), english)).otherwise(F.concat(F.lit("Sum "), F.col("total").cast("string"), F.lit(" EUR"))), F.lit("Thank you")]
    blocks = o.select("doc_id", F.posexplode(F.array(*texts)).alias("ord", "text")).select("doc_id", "ord", F.lit(0).alias("page"), "text", F.lit(0.1).alias("x"), (F.col("ord") * 0.25).alias("y"), F.lit(0.5).alias("w"), F.lit(0.02).alias("h"))
    values = o.select("doc_id", F.lit("grandTotal").alias("path"), F.col("total").cast("string").alias("text"), F.col("total").alias("number"))
    return grounding.provenance(values, blocks).select("doc_id", "path", "step", "page", "y")


TAGS = ("", "en", "en-US", "en_GB", "en-CA", "en_PH", "de", "de_DE", "fr-CA", "fr", "zh", "zh_Hant_TW", "zh-HK", "ja", "ko_KR", "hu", "lt", "sv_SE", "es_PR", "es", "tl", "lb_LU", "ru", "xx")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(*[F.lit(t) for t in TAGS])
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(tags, (F.col("p_partkey") % len(TAGS) + 1).cast("int")).alias("tag"))


def locale_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numeric date read by every order of day and month."""
    return _tagged(spark, sf_dir).select("p_partkey", "tag", F.to_date(parse_moment(F.lit("03/04/2020"), F.col("tag"))).alias("day"))


def latin_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tagged(spark, sf_dir)
    return t.select("p_partkey", latin_only(F.when(F.col("tag") == "", F.array().cast("array<string>")).otherwise(F.array(F.col("tag"), F.lit("nb-NO")))).alias("latin"))


def attachment_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-invoice among attachments whose names and contents say different things."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    file = lambda name, xml: F.struct(F.lit(name).alias("name"), F.lit(xml).alias("xml"))
    new, old = "<CrossIndustryInvoice>{}</CrossIndustryInvoice>", "<rsm:CrossIndustryDocument>{}</rsm:CrossIndustryDocument>"
    sets = [
        [file("factur-x.xml", "<notes/>"), file("ZUGFeRD.xml", old.format("z"))], [file("b.xml", new.format("b")), file("a.xml", new.format("a"))],
        [file("a.xml", new.format("a")), file("xrechnung.xml", new.format("x")), file("zugferd-invoice.xml", new.format("i"))], [file("data.txt", new.format("t")), file("order-x.xml", "<order/>")],
    ]
    chosen = F.element_at(F.array(*[F.array(*s) for s in sets]), (F.col("doc_id") % 4 + 1).cast("int"))
    return files.chosen_attachment(o.select("doc_id", F.explode(chosen).alias("_f")).select("doc_id", "_f.*"), "doc_id")


def _supplier_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers as JSON that arrives in pieces of nine characters."""
    s = table(spark, sf_dir, "supplier")
    whole = F.concat(F.lit('{"number":"'), F.col("s_suppkey").cast("string"), F.lit('","seller":{"name":"'), F.col("s_name"), F.lit('"}}'))
    cut = s.select(F.col("s_suppkey").cast("bigint").alias("doc_id"), whole.alias("t")).withColumn("n", F.ceil(F.length("t") / 9).cast("int"))
    spread = cut.select("doc_id", "t", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("seq"))
    return spread.select("doc_id", F.col("seq").cast("int").alias("seq"), F.substr("t", F.col("seq") * 9 + 1, F.lit(9)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("is_end"))


def cancelled_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third stream is cancelled at its third piece and has no final record."""
    pieces = _supplier_pieces(spark, sf_dir)
    cancels = pieces.where("doc_id % 3 = 0").select("doc_id", F.lit(2).alias("seq")).distinct()
    got = updates_of_batch(until_cancelled(pieces, cancels)).groupBy("doc_id").agg(F.count_if(F.col("kind") == "final").alias("finals"), F.max("seq").alias("last_seq"))
    return got


def streamed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces as a stream of files through the stateful operator, out of order."""
    folder = os.path.join(shared_folder(spark), f"pieces-{uuid.uuid4().hex}")
    pieces = _supplier_pieces(spark, sf_dir)
    pieces.repartition(3, F.xxhash64("doc_id", "seq")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    # State that waits for a timeout asks for batches without data for ever; the stream has the
    # settings of its start, so the session's are put back at once.
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        query = record_updates(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)
    query.awaitTermination()
    final = spark.read.parquet(f"{folder}/out").where("kind = 'final'")
    return final.select("doc_id", F.get_json_object("payload", "$.number").alias("number"), F.get_json_object("payload", "$.seller.name").alias("seller"))


def _slow(keys: pd.Series, prompts: pd.Series, attempt: int) -> pd.Series:
    """A model that hangs on every fifth document."""
    if any(k % 5 == 0 for k in keys):
        time.sleep(3)
    return pd.Series([f'{{"name": "n{k}"}}' for k in keys], dtype="object")


def late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), F.col("n_name").alias("text"))
    asked = extract.attempt_loop(docs, "doc_id", Schema.record("Nation", name=Schema.string()), _slow, max_retries=0, seconds=0.5)
    return asked.select("doc_id", "status", F.get_json_object("json", "$.name").alias("name"))


QUERIES = {f.__name__: f for f in (tree_leaves, numeric_places, locale_dates, latin_tags, attachment_choice, cancelled_streams, streamed_records, late_answers)}

_PLAIN = "regexp_replace(regexp_replace({0}::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_TAGGED = f"tagged as (select p_partkey, [{', '.join(repr(t) for t in TAGS)}][p_partkey % {len(TAGS)} + 1] as tag from part), split as (select *, string_split(lower(replace(tag, '-', '_')), '_') as p from tagged)"
_IN = lambda names: "(" + ", ".join(repr(n) for n in sorted(names)) + ")"
_SUPPLIERS = """s as (select s_suppkey as doc_id, s_name, '{"number":"' || s_suppkey || '","seller":{"name":"' || s_name || '"}}' as t from supplier)"""

SQL = {
    "tree_leaves": f"""with {SQL_DOCUMENTS}, head as (
            select doc_id, 0 as ix, 'invoiceNumber' as path, case when p_number is null then 'null' else 'string' end as kind, p_number as text from docs
            union all select doc_id, 1, 'currency', 'null', null from docs union all select doc_id, 2, 'sellerName', 'string', p_seller from docs
            union all select doc_id, 3, 'issueDate', 'date', p_issued::varchar from docs union all select doc_id, 4, 'grandTotal', 'number', {_PLAIN.format('p_total')} from docs union all select doc_id, 5, 'taxTotal', 'null', null from docs)
        select * from head union all
        select doc_id, (6 + 3 * line_ix)::int, 'lineItems[' || line_ix || '].description', case when dropped then 'null' else 'string' end, case when not dropped then description end from lines
        union all select doc_id, (7 + 3 * line_ix)::int, 'lineItems[' || line_ix || '].quantity', 'number', quantity::varchar from lines
        union all select doc_id, (8 + 3 * line_ix)::int, 'lineItems[' || line_ix || '].lineTotal', 'number', {_PLAIN.format('amount')} from lines""",
    "numeric_places": "select o_orderkey as doc_id, 'grandTotal' as path, 2 as step, 0 as page, 0.5::double as y from orders",
    "locale_dates": f"""with {_TAGGED}, r as (select *, p[1] as lang, coalesce(list_filter(p[2:], lambda x: regexp_full_match(x, '[a-z]{{2}}|[0-9]{{3}}'))[1], '') as region from split),
        f as (select *, case when lang = '' then true when lang = 'en' then region in {_IN({'', *MONTH_FIRST_ENGLISH})} when lang || '_' || region in {_IN(MONTH_FIRST_ELSEWHERE)} then true when lang || '_' || region in {_IN(DAY_FIRST_ELSEWHERE)} then false else lang in {_IN(MONTH_FIRST_LANGUAGES)} end as month_first from r)
        select p_partkey, tag, case when month_first then date '2020-03-04' else date '2020-04-03' end as day from f""",
    "latin_tags": f"with {_TAGGED} select p_partkey, tag <> '' and string_split(lower(replace(tag, '_', '-')), '-')[1] in {_IN(LATIN_LANGUAGES)} as latin from tagged",
    "attachment_choice": "select o_orderkey as doc_id, case o_orderkey % 4 when 0 then '<rsm:CrossIndustryDocument>z</rsm:CrossIndustryDocument>' when 1 then '<CrossIndustryInvoice>a</CrossIndustryInvoice>' else '<CrossIndustryInvoice>i</CrossIndustryInvoice>' end as xml from orders where o_orderkey % 4 <> 3",
    "cancelled_streams": f"with {_SUPPLIERS} select doc_id, case when doc_id % 3 = 0 then 0 else 1 end as finals, case when doc_id % 3 = 0 then case when 18 >= length('{{\"number\":\"' || doc_id || '\"') then (ceil(length('{{\"number\":\"' || doc_id || '\"') / 9.0) - 1)::int else 0 end else (ceil(length(t) / 9.0) - 1)::int end as last_seq from s",
    "streamed_records": "select s_suppkey as doc_id, s_suppkey::varchar as number, s_name as seller from supplier",
    "late_answers": "select n_nationkey as doc_id, case when n_nationkey % 5 = 0 then 'timeout' else 'accepted' end as status, case when n_nationkey % 5 <> 0 then 'n' || n_nationkey end as name from nation",
}
