"""Orders rendered as invoice texts with seeded faults: the input of the evaluation queries.

Every order becomes a document (its text, its truth) and a prediction as a model might give
it: lower-case sellers, wrong totals, dropped lines, failures, each by a rule on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.tables import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_ix, description, quantity, amount, dropped``."""
    from pyspark.sql.window import Window

    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_shipdate", "l_quantity")
    # Numbered before anything is derived: the key stays the one the rows were spread by, so groups of
    # doc_id need no further shuffle, and two uses of the lines in one query can share theirs.
    return items.withColumn("line_ix", F.row_number().over(order) - 1).select(
        F.col("l_orderkey").alias("doc_id"), "line_ix", F.concat_ws(" ", "p_name", "p_brand").alias("description"),
        F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 5 == 0).alias("dropped"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, number, seller, issued, total, text`` and the prediction's ``p_number,
    p_seller, p_issued, p_total, hard_failure``."""
    rendered = F.format_string("%s  %d x %s", "description", "quantity", F.col("amount").cast("string"))
    body = lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_ix", rendered.alias("t")))), lambda r: r["t"]), "\n").alias("body"), F.sum("amount").alias("total"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    d = orders.join(body, key == F.col("doc_id"))
    number = F.concat(F.lit("INV-"), key.cast("string"))
    issued = F.to_date("o_orderdate")
    text = F.concat_ws("\n", F.concat(F.lit("Invoice "), number), F.concat(F.lit("Seller: "), F.col("c_name")), F.concat(F.lit("Date "), F.date_format("o_orderdate", "dd.MM.yyyy")), F.col("body"), F.concat(F.lit("Total "), F.col("total").cast("string")))
    return d.select(
        "doc_id", number.alias("number"), F.col("c_name").alias("seller"), issued.alias("issued"), F.col("total").cast("decimal(18,2)").alias("total"), text.alias("text"),
        F.when(key % 13 != 0, F.lower(number)).alias("p_number"), F.when(key % 4 == 0, F.concat(F.upper("c_name"), F.lit(" Ltd"))).otherwise(F.col("c_name")).alias("p_seller"),
        F.when(key % 5 == 0, F.date_add(issued, 1)).otherwise(issued).alias("p_issued"), F.when(key % 7 == 0, F.col("total") + 1).otherwise(F.col("total") + F.lit("0.01").cast("decimal(18,2)")).cast("decimal(18,2)").alias("p_total"), (key % 11 == 0).alias("hard_failure"),
    )


SQL_LINES = """
lines as (
    select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_suppkey, l_shipdate, l_quantity) - 1 as line_ix,
        p_name || ' ' || p_brand as description, l_quantity::int as quantity, l_extendedprice::decimal(18,2) as amount, (l_orderkey + l_linenumber) % 5 = 0 as dropped
    from lineitem join part on l_partkey = p_partkey)"""

SQL_DOCUMENTS = SQL_LINES + """,
body as (
    select doc_id, string_agg(description || '  ' || quantity || ' x ' || amount, chr(10) order by line_ix) as body, sum(amount)::decimal(28,2) as total from lines group by 1),
docs as (
    select doc_id, 'INV-' || o_orderkey as number, c_name as seller, o_orderdate::date as issued, total::decimal(18,2) as total,
        'Invoice INV-' || o_orderkey || chr(10) || 'Seller: ' || c_name || chr(10) || 'Date ' || strftime(o_orderdate, '%d.%m.%Y') || chr(10) || body || chr(10) || 'Total ' || total as text,
        case when o_orderkey % 13 <> 0 then lower('INV-' || o_orderkey) end as p_number, case when o_orderkey % 4 = 0 then upper(c_name) || ' Ltd' else c_name end as p_seller,
        case when o_orderkey % 5 = 0 then (o_orderdate::date + 1)::date else o_orderdate::date end as p_issued, case when o_orderkey % 7 = 0 then total + 1 else total + 0.01 end::decimal(18,2) as p_total, o_orderkey % 11 = 0 as hard_failure
    from orders join customer on o_custkey = c_custkey join body on o_orderkey = doc_id)"""
