"""Queries of layout, recognition passes and geometry over the scanned blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators import layout, ocr
from paperloom.tables import delivered_once, table


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id", "ord", "page_index", "text", "x", "y", "w", "h", "matching", "observing")
    return b.select(F.col("inspection_id").alias("doc_id"), "block_id", "ord", F.col("page_index").alias("page"), "text", "x", "y", "w", "h", "matching", "observing").where("page is not null and x is not null and y is not null and w is not null and h is not null and text is not null")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks cut into word boxes, as a page's words would come."""
    b = _blocks(spark, sf_dir)
    words = b.select("doc_id", "page", "block_id", "y", "h", "x", "w", F.posexplode(F.split("text", " +")).alias("i", "text"), F.size(F.split("text", " +")).alias("n")).where("text <> ''")
    return words.select("doc_id", "page", "block_id", "i", "text", (F.col("x") + F.col("w") * F.col("i") / F.col("n")).alias("x"), "y", (F.col("w") / F.col("n") * 0.5).alias("w"), "h")


def cell_merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.merged_cells(_words(spark, sf_dir), "doc_id", "page", "block_id").select("doc_id", "page", "block_id", "cell_no", "text", "parts")


def region_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).groupBy("doc_id", "page", F.round("y", 4).alias("y")).agg(F.max("h").alias("h"))
    numbered = layout.regions(rows, ["doc_id", "page"], "h")
    return numbered.groupBy("doc_id", "page").agg((F.max("region") + 1).alias("regions"), F.count("*").alias("rows"))


def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).groupBy("doc_id", "page", F.round("y", 4).alias("y")).agg(F.count("*").alias("n"))
    found = layout.largest_gap(rows, ["doc_id", "page"], "y", 2)
    return found.select("doc_id", "page", F.round("gap", 6).alias("gap"), F.round("cut", 6).alias("cut"))


def reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_lines(_words(spark, sf_dir)).groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


def column_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _words(spark, sf_dir).groupBy("doc_id", "page").agg(F.collect_list("x").alias("xs"))
    made = pages.select("doc_id", "page", layout.clustered(F.col("xs")).alias("centres"))
    return made.select("doc_id", "page", F.size("centres").alias("columns"), layout.nearest(F.col("centres"), F.lit(0.1)).alias("at_left"))


def detect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.detect_tables(_words(spark, sf_dir).select("doc_id", "page", "text", "x", "y", "w", "h")).groupBy("doc_id", "page", "table_ix", "row_count", "column_count").agg(F.count("*").alias("cells"))


def _order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as table rows: a heading, then part, quantity, price."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_shipdate", "l_quantity")
    l = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(order))
    cells = F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 5 == 0, F.lit("")).otherwise(F.col("l_quantity").cast("int").cast("string")), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    body = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("r", cells.alias("c")))).alias("_r"))
    head = F.array(F.lit("Item"), F.lit("Qty"), F.lit("Price | net"))
    return body.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.array(head), F.transform("_r", lambda x: x["c"])).alias("rows"))


def table_density_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _order_grid(spark, sf_dir)
    filled = F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(F.filter(r, lambda c: c != "")))
    fill = layout.density(filled, F.size("rows"), F.lit(3))
    return g.select("doc_id", F.round(fill, 6).alias("density"), layout.line_item_shaped(F.size("rows"), F.lit(3), fill).alias("shaped"), layout.header_row(F.element_at("rows", 1)).alias("heading"))


def table_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_grid(spark, sf_dir).select("doc_id", F.md5(layout.markdown(F.col("rows"), F.lit(True))).alias("digest"))


def spatial_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weakest agreement among the blocks each page's upper half meets."""
    from paperloom.operators.grounding import agreement_at

    b = _blocks(spark, sf_dir)
    boxes = b.select("doc_id", "page").distinct().select("doc_id", "page", F.concat(F.lit("p"), F.col("page").cast("string")).alias("path"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(0.5).alias("h"))
    return agreement_at(boxes, b)


def box_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("doc_id", "page").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.round(F.max(F.col("x") + F.col("w")) - F.min("x"), 6).alias("w"), F.round(F.max(F.col("y") + F.col("h")) - F.min("y"), 6).alias("h"))


def line_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).groupBy("doc_id", "page").agg(layout.upper_median(F.collect_list("h")).alias("upper_median"), F.round(F.percentile("h", 0.5), 6).alias("median"))


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    order = Window.partitionBy("doc_id", "page").orderBy("ord", "block_id")
    nxt = [F.lead(c).over(order).alias(f"n{c}") for c in ("x", "y", "w", "h")]
    pairs = b.select("doc_id", "block_id", "x", "y", "w", "h", *nxt).where("nx is not null")
    score = ocr.agreement_score(*[F.col(c) for c in ("x", "y", "w", "h", "nx", "ny", "nw", "nh")])
    return pairs.select("block_id", F.round(score, 6).alias("score"))


def reconcile_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First readings of a page and the further ones as two passes."""
    b = _blocks(spark, sf_dir)
    again = F.row_number().over(Window.partitionBy("doc_id", "page", F.round("y", 3)).orderBy("ord", "block_id")) > 1
    made = ocr.reconcile_passes(b.withColumn("pass", again.cast("int")))
    return made.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("matching").alias("matching"), F.sum(F.size("alternatives")).alias("alternatives"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recognised lines of probed pages: user = document, four turns."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).alias("page"), ((F.floor(F.col("event_id") / 3) % 4) * 90).cast("int").alias("turn"), F.col("event_type").alias("text"), (F.col("value") / 1000).alias("confidence"), F.lit(0.5).alias("w"), F.when(F.col("event_id") % 5 == 0, 0.9).otherwise(0.1).alias("h"))


def orientation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.orientation_scores(_probes(spark, sf_dir), "doc_id", "page").withColumn("score", F.round("score", 6))


def rotation_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ocr.orientation_scores(_probes(spark, sf_dir), "doc_id", "page").withColumn("score", F.round("score", 4))
    return ocr.resolve_rotations(ocr.best_rotation(scores, "doc_id", "page"))


def order_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _probes(spark, sf_dir).withColumn("orientation", F.when(F.col("confidence") > 0.05, "upright").when(F.col("confidence") > 0.01, "upsideDown").otherwise("unknown"))
    return ocr.order_witness(lines, "doc_id")


def raster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = ocr.raster_size(F.lit(595), F.lit(842), (F.col("p_size") * 30).cast("int"), (F.col("p_partkey") % 9 * 90 - 180).cast("int"))
    return p.select("p_partkey", size.alias("_s")).select("p_partkey", "_s.dpi", "_s.rotation", "_s.width", "_s.height")


def pass_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    plan = ocr.pass_plan(F.lit("300"), F.array(F.when(F.col("n_nationkey") % 2 == 0, F.lit("300")).otherwise(F.lit("600")), F.lit("400"), F.lit("400")))
    return n.select("n_nationkey", F.array_join(plan, ",").alias("passes"))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text", "used_ocr_fallback")
    read = ocr.read_page(F.coalesce("used_ocr_fallback", F.lit(False)), F.col("full_text"), F.lit("layer"))
    return i.select("inspection_id", read["source"].alias("source"), F.length(read["text"]).alias("characters"))


QUERIES = {f.__name__: f for f in (cell_merge_islands, region_islands, largest_gap, reading_lines, column_clusters, detect_tables, table_density_shape, table_markdown, spatial_agreement, box_unions, line_heights, pair_scores, reconcile_passes, orientation_score, rotation_vote, order_witness, raster_sizes, pass_plan, page_sources)}

_B = """b as (select * from (select block_id, any_value(inspection_id) as doc_id, any_value(ord) as ord, any_value(page_index) as page, any_value(text) as text, any_value(x) as x, any_value(y) as y, any_value(w) as w, any_value(h) as h, any_value(matching) as matching, any_value(observing) as observing
    from blocks where block_id is not null group by 1) where page is not null and x is not null and y is not null and w is not null and h is not null and text is not null)"""
_W = _B + """, s as (select *, regexp_split_to_array(text, ' +') as parts from b), u as (select doc_id, page, block_id, x, y, w, h, len(parts) as n, unnest(parts) as word, generate_subscripts(parts, 1) - 1 as i from s),
    words as (select doc_id, page, block_id, i, word, x + w * i / n as x, w / n * 0.5 as w, y, h from u where word <> '')"""
_GRID = """grid as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_suppkey, l_shipdate, l_quantity) as r, l_partkey::varchar as a, case when l_linenumber % 5 = 0 then '' else l_quantity::int::varchar end as q, l_extendedprice::decimal(18,2)::varchar as p from lineitem)"""
_PROBES = "probes as (select user_id as doc_id, event_id % 3 as page, (event_id // 3 % 4 * 90)::int as turn, event_type as text, value / 1000 as confidence, case when event_id % 5 = 0 then 0.1 else 1.0 end as wide from events)"
_TURNS = f"""{_PROBES}, sc as (select doc_id, page, turn, round(sum(length(text) * greatest(confidence, 0) * wide), 4) as score from probes group by all),
    p as (select doc_id, page, coalesce(max(score) filter (turn = 0), 0) as s0, coalesce(max(score) filter (turn = 90), 0) as s90, coalesce(max(score) filter (turn = 180), 0) as s180, coalesce(max(score) filter (turn = 270), 0) as s270 from sc group by all),
    t as (select *, greatest(s0, s90, s180, s270) as top from p), d as (select *, case when s0 = top or top < 1.5 * s0 then 0 when s90 = top then 90 when s180 = top then 180 else 270 end as rotation from t),
    v as (select *, case rotation when 0 then s0 < 1.2 * s180 when 90 then s90 < 1.2 * s270 when 180 then s180 < 1.2 * s0 else s270 < 1.2 * s90 end as ambiguous from d)"""

SQL = {
    "cell_merge_islands": f"""with {_W}, e as (select *, max(x + w) over (partition by doc_id, page, block_id order by x, w, word rows between unbounded preceding and 1 preceding) as edge from words),
        n as (select *, sum(case when edge is null or x - edge > 0.018 then 1 else 0 end) over (partition by doc_id, page, block_id order by x, w, word rows unbounded preceding) - 1 as cell_no from e)
        select doc_id, page, block_id, cell_no, string_agg(word, ' ' order by x, w, word) as text, count(*) as parts from n group by all""",
    "region_islands": f"""with recursive {_B}, r as (select doc_id, page, round(y, 4) as y, max(h) as h from b group by all), g as (select *, y - lag(y) over w as gap, greatest(0.12, 5 * h) as lim, row_number() over w as k from r window w as (partition by doc_id, page order by y)),
        walk as (select doc_id, page, k, 1 as opened from g where k = 1 union all
            select g.doc_id, g.page, g.k, case when g.gap >= g.lim and not (walk.opened = 1 and g.gap < g.lim * 1.25) then 1 else 0 end from walk join g on g.doc_id = walk.doc_id and g.page is not distinct from walk.page and g.k = walk.k + 1)
        select doc_id, page, sum(opened)::bigint as regions, count(*) as rows from walk group by all""",
    "largest_gap": f"""with {_B}, r as (select distinct doc_id, page, round(y, 4) as y from b), g as (select *, lead(y) over w as z, row_number() over w as n, count(*) over (partition by doc_id, page) as m from r window w as (partition by doc_id, page order by y)),
        f as (select *, z - y as gap from g where n >= 2 and m - n >= 2), k as (select *, row_number() over (partition by doc_id, page order by gap desc, y) as best from f) select doc_id, page, round(gap, 6) as gap, round((z + y) / 2, 6) as cut from k where best = 1""",
    "table_density_shape": f"""with {_GRID}, d as (select doc_id, count(*) + 1 as rows, 3 + sum((a <> '')::int + (q <> '')::int + (p <> '')::int) as filled from grid group by 1) select doc_id, round(filled / (rows * 3), 6) as density, rows >= 3 and filled / (rows * 3) >= 0.8 as shaped, true as heading from d""",
    "table_markdown": f"""with {_GRID} select doc_id, md5('| Item | Qty | Price \\| net |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || a || ' | ' || q || ' | ' || p || ' |', chr(10) order by r)) as digest from grid group by 1""",
    "spatial_agreement": f"""with {_B}, m as (select doc_id, page, 'p' || page as path, matching, observing, row_number() over (partition by doc_id, page order by matching / greatest(observing, 1), matching, observing) as k from b where x < 1 and 0 < x + w and y < 0.5 and 0 < y + h) select doc_id, path, matching, observing from m where k = 1""",
    "box_unions": f"with {_B} select doc_id, page, min(x) as x, min(y) as y, round(max(x + w) - min(x), 6) as w, round(max(y + h) - min(y), 6) as h from b group by all",
    "line_heights": f"with {_B} select doc_id, page, list_sort(list(h))[len(list(h)) // 2 + 1] as upper_median, round(quantile_cont(h, 0.5), 6) as median from b group by all",
    "pair_scores": f"""with {_B}, n as (select block_id, x, y, w, h, lead(x) over o as nx, lead(y) over o as ny, lead(w) over o as nw, lead(h) over o as nh from b window o as (partition by doc_id, page order by ord, block_id)),
        g as (select *, least(x + w, nx + nw) - greatest(x, nx) as ox, least(y + h, ny + nh) - greatest(y, ny) as oy from n where nx is not null), i as (select *, greatest(ox, 0) * greatest(oy, 0) as inter from g),
        s as (select *, coalesce(inter / nullif(w * h + nw * nh - inter, 0), 0) as iou from i)
        select block_id, round(case when iou >= 0.25 then iou when (oy >= 0.25 * least(h, nh) or abs(y + h / 2 - ny - nh / 2) <= greatest(0.6 * greatest(h, nh), 0.008)) and coalesce(ox / nullif(least(w, nw), 0), 0) >= 0.25 then greatest(iou, 0.01) else 0 end, 6) as score from s""",
    "orientation_score": f"with {_PROBES} select doc_id, page, turn, round(sum(length(text) * greatest(confidence, 0) * wide), 6) as score from probes group by all",
    "rotation_vote": f"""with {_TURNS}, c as (select doc_id, rotation % 180 as axis, rotation, count(*) as n from v where not ambiguous group by all), w as (select doc_id, axis, rotation as vote, row_number() over (partition by doc_id, axis order by n desc, rotation) as k from c)
        select v.doc_id, page, case when ambiguous then coalesce(vote, rotation) else rotation end as rotation from v left join w on v.doc_id = w.doc_id and v.rotation % 180 = w.axis and k = 1""",
    "order_witness": f"""with {_PROBES}, o as (select doc_id, turn, length(text) as n, case when confidence > 0.05 then turn when confidence > 0.01 then (turn + 180) % 360 end as for_turn from probes), q as (select doc_id, turn % 180 as axis, for_turn, n from o where for_turn is not null),
        s as (select doc_id, axis, coalesce(sum(n) filter (for_turn = axis), 0) as a, coalesce(sum(n) filter (for_turn <> axis), 0) as b, count(*) filter (for_turn = axis) as na, count(*) filter (for_turn <> axis) as nb from q group by all)
        select doc_id, axis, case when na >= 3 and a >= 3 * b then axis else axis + 180 end as turn from s where na >= 3 and a >= 3 * b or nb >= 3 and b >= 3 * a""",
    "raster_sizes": """with p as (select p_partkey, least(greatest(p_size * 30, 72), 1200) as dpi, ((p_partkey % 9 * 90 - 180) % 360 + 360) % 360 as rotation from part)
        select p_partkey, dpi, rotation, round(case when rotation in (90, 270) then 842 else 595 end * dpi / 72)::int as width, round(case when rotation in (90, 270) then 595 else 842 end * dpi / 72)::int as height from p""",
    "pass_plan": "select n_nationkey, case when n_nationkey % 2 = 0 then '300,400' else '300,600,400' end as passes from nation",
    "page_sources": """with i as (select inspection_id, any_value(full_text) as t, coalesce(any_value(used_ocr_fallback), false) as o from inspections where inspection_id is not null group by 1)
        select inspection_id, case when o and coalesce(trim(t), '') <> '' then 'ocr' else 'textLayer' end as source, case when o and coalesce(trim(t), '') <> '' then length(t) else 5 end as characters from i""",
}
