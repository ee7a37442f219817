"""The pN queries of the core: nested records and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.nested import explode_items, flatten_payloads
from paperloom.operators.timestamps import to_moments
from paperloom.tables import delivered_once, table


def p5_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = delivered_once(table(spark, sf_dir, "raw_results"), "record_id", "payload")
    return flatten_payloads(raw, "record_id", "payload")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = delivered_once(table(spark, sf_dir, "raw_results"), "record_id", "payload")
    return flatten_payloads(raw, "record_id", "payload", texts=False)


def p5_receipt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_items(delivered_once(table(spark, sf_dir, "receipts"), "receipt_id", "items"), "receipt_id", "items")


def p5_invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_items(delivered_once(table(spark, sf_dir, "invoices"), "invoice_id", "line_items"), "invoice_id", "line_items")


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, zone: bool, *fields: str) -> DataFrame:
        extra = ["zone_name"] if zone else []
        rows = delivered_once(table(spark, sf_dir, name), key, "locale", *extra, *fields)
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("written")) for f in fields]))
        zone_name = F.col("zone_name") if zone else F.lit(None).cast("string")
        return rows.select(F.col(key).alias("record_id"), "locale", zone_name.alias("zone_name"), pairs.alias("_p")).select("record_id", "locale", "zone_name", "_p.*")

    return (
        of("receipts", "receipt_id", True, "receipt_date")
        .unionByName(of("invoices", "invoice_id", True, "due_date"))
        .unionByName(of("identity_documents", "identity_id", False, "date_of_birth", "expiry_date"))
    )


def p6_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "receipts").select("zone_name").union(table(spark, sf_dir, "invoices").select("zone_name"))
    moments = to_moments(_dates(spark, sf_dir), "written", "locale", "zone_name", zones)
    return moments.select("field_name", "record_id", "written", "reading", "epoch_s")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_moments(spark, sf_dir).where("epoch_s is not null").select("field_name", "record_id", "epoch_s")


QUERIES = {f.__name__: f for f in (p5_found, p5_elements, p5_receipt_items, p5_invoice_lines, p6_found, p6_moments)}

_ARRAY = """case json_type({0}) when 'ARRAY' then json_extract({0}, '$[*]') when 'OBJECT' then [{0}] when 'VARCHAR' then case when json_valid({0}->>'$') then case when json_type(({0}->>'$')::json) = 'ARRAY' then json_extract(({0}->>'$')::json, '$[*]') end end end"""

SQL = {
    "p5_found": rf"""
        with r as (select record_id, any_value(payload) as p from raw_results where record_id is not null group by 1),
        o as (select record_id, regexp_extract(p, '(?s)\{{.*\}}') as t from r), v as (select record_id, t::json as j from o where t <> '' and json_valid(t)),
        a as (select record_id, unnest([{{'node': 'value.lineItems', 'x': j->'$.value.lineItems'}}, {{'node': 'value.items', 'x': j->'$.value.items'}}, {{'node': 'signals.fields', 'x': j->'$.signals.fields'}}, {{'node': 'signals.mergeConflicts', 'x': j->'$.signals.mergeConflicts'}}, {{'node': 'tables', 'x': j->'$.tables'}}], recursive := true) from v),
        l as (select record_id, node, {_ARRAY.format("x")} as e from a),
        f as (select record_id, node, -1 as parent_ix, (generate_subscripts(e, 1) - 1)::int as child_ix, unnest(e) as x from l),
        k as (select record_id, case node when 'tables' then 'tables.cells' else 'signals.mergeConflicts.values' end as node, child_ix as parent_ix, case node when 'tables' then x->'$.cells' else x->'$.values' end as y from f where node in ('tables', 'signals.mergeConflicts') and json_type(x) = 'OBJECT'),
        m as (select record_id, node, parent_ix, {_ARRAY.format("y")} as e from k),
        g as (select record_id, node, parent_ix, (generate_subscripts(e, 1) - 1)::int as child_ix, unnest(e) as x from m)
        select record_id, node, parent_ix, child_ix from (from f union all from g) where json_type(x) <> 'NULL'""",
    "p5_receipt_items": """
        select record_id, (ix - 1)::int as child_ix, item.item_name as item_name, item.price as price, item.quantity as quantity
        from (select receipt_id as record_id, generate_subscripts(items, 1) as ix, unnest(items) as item
              from (select receipt_id, any_value(items) as items from receipts where receipt_id is not null group by 1))
        where item is not null""",
    "p5_invoice_lines": """
        select record_id, (ix - 1)::int as child_ix, item.description as description, item.amount as amount, item.quantity as quantity
        from (select invoice_id as record_id, generate_subscripts(line_items, 1) as ix, unnest(line_items) as item
              from (select invoice_id, any_value(line_items) as line_items from invoices where invoice_id is not null group by 1))
        where item is not null""",
}
