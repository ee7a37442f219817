"""Lines, rows and tables from positioned text boxes.

What is a plain window or gap rule is written as DataFrame windows; the table builder, whose
steps depend on each other's results, runs as one grouped function per page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import LIST_MARKERS, let

# Thresholds of the layout rules.
LINE_SHARE, LINE_LEAST, HEIGHT_FALLBACK = 0.6, 0.008, 0.008
CELL_GAP, REGION_GAP, REGION_HEIGHTS, ORPHAN = 0.018, 0.12, 5.0, 1.25
CLUSTER, SEPARATE, REACH, GUTTER = 0.05, 0.04, 0.075, 0.03
CORRIDOR, CORRIDOR_OVERLAP, CORRIDOR_FACTOR, SHARED_SHORT, SHARED_BOTH = 0.06, 0.25, 1.25, 0.80, 0.50
DEPTH, DENSITY, BAND_GAP, WORDS, WIDTH, ROW_OVERLAP = 3, 0.55, 0.09, 6, 0.28, 0.25
# Words of table headings.
HEADER_WORDS = ("item", "items", "description", "desc", "qty", "quantity", "qty.", "price", "amount", "total", "unit", "date", "name", "product", "sku", "cost", "rate", "hours", "tax", "subtotal", "code", "id", "no", "no.", "#")


# Window and array forms.
def upper_median(values: Column) -> Column:
    """The upper of the middle values (line heights)."""
    return F.element_at(F.sort_array(values), (F.size(values) / 2).cast("int") + 1)


def reading_lines(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words of a page as lines in reading order: ``key, page, line_no, line``.

    A word opens a new line when its middle is further from the first word of the line than
    max(0.6 of the typical height, 0.008); inside a line words go from left to right.
    """
    box = F.struct((F.col("y") + F.col("h") / 2).alias("a"), F.col("x").alias("x"), F.col("text").alias("t"))
    pages = words.groupBy(key, "page").agg(F.sort_array(F.collect_list(box)).alias("_w"), upper_median(F.collect_list("h")).alias("_h"))
    typical = F.when(F.coalesce("_h", F.lit(0.0)) > 0, F.col("_h")).otherwise(HEIGHT_FALLBACK)
    tolerance = F.greatest(LINE_SHARE * typical, F.lit(LINE_LEAST))
    word = "struct<a: double, x: double, t: string>"
    empty = F.array().cast(f"array<struct<a: double, w: array<{word}>>>")
    last = lambda lines: F.element_at(lines, -1)

    def step(lines: Column, w: Column) -> Column:
        opens = (F.size(lines) == 0) | (F.abs(w["a"] - last(lines)["a"]) > tolerance)
        fresh = F.concat(lines, F.array(F.struct(w["a"].alias("a"), F.array(w).alias("w"))))
        grown = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.struct(last(lines)["a"].alias("a"), F.concat(last(lines)["w"], F.array(w)).alias("w"))))
        return F.when(opens, fresh).otherwise(grown)

    made = pages.withColumn("_lines", F.aggregate("_w", empty, step))
    spread = made.select(key, "page", F.posexplode("_lines").alias("line_no", "_l"))
    ordered = F.transform(F.sort_array(F.transform("_l.w", lambda w: F.struct(w["x"], w["t"]))), lambda w: w["t"])
    return spread.select(key, "page", "line_no", F.array_join(ordered, " ").alias("line"))


def merged_cells(blocks: DataFrame, *row: str) -> DataFrame:
    """Boxes of a row joined while the gap to the right edge so far is small:
    ``*row, cell_no, text, x, w, parts``."""
    order = Window.partitionBy(*row).orderBy("x", "w", "text")
    edge = F.max(F.col("x") + F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = blocks.withColumn("_new", F.when(edge.isNull() | (F.col("x") - edge > CELL_GAP), 1).otherwise(0))
    numbered = opened.withColumn("cell_no", F.sum("_new").over(order) - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("x", "w", "text"))), lambda p: p["text"])
    return numbered.groupBy(*row, "cell_no").agg(F.array_join(parts, " ").alias("text"), F.min("x").alias("x"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), F.count("*").alias("parts"))


def regions(rows: DataFrame, page: list[str], median_height: str) -> DataFrame:
    """Rows of a page (``y`` of their tops) numbered by region: a vertical gap of at least
    max(0.12, 5 heights) opens one.  A region of one row alone takes the next one in, if the
    gap between them is less than a quarter above that."""
    order = Window.partitionBy(*page).orderBy("y")
    gap = F.col("y") - F.lag("y").over(order)
    limit = F.greatest(F.lit(REGION_GAP), REGION_HEIGHTS * F.col(median_height))
    marked = rows.withColumns({"_opens": F.coalesce(gap >= limit, F.lit(True)), "_short": F.coalesce((gap >= limit) & (gap < limit * ORPHAN), F.lit(False))})
    # Short gaps in a row open and join by turns, beginning with what the row before them did.
    marked = marked.withColumn("_turn", F.sum(F.when(F.col("_short"), 0).otherwise(1)).over(order))
    turn = Window.partitionBy(*page, "_turn").orderBy("y")
    before, place = F.first("_opens").over(turn).cast("int"), F.row_number().over(turn) - 1
    opened = marked.withColumn("_new", (before + place) % 2)
    opened = opened.withColumn("_new", F.when(F.col("_short"), F.col("_new")).otherwise(F.col("_opens").cast("int")))
    return opened.withColumn("region", F.sum("_new").over(order) - 1).drop("_opens", "_short", "_turn", "_new")


def largest_gap(blocks: DataFrame, page: list[str], at: str, side: int) -> DataFrame:
    """The widest gap between neighbours that leaves ``side`` on both sides:
    ``*page, gap, cut`` (the middle of the gap)."""
    order = Window.partitionBy(*page).orderBy(at)
    ahead = F.lead(at).over(order)
    ranked = blocks.withColumn("_gap", ahead - F.col(at)).withColumn("_cut", (ahead + F.col(at)) / 2).withColumn("_n", F.row_number().over(order)).withColumn("_all", F.count("*").over(Window.partitionBy(*page)))
    fit = ranked.where((F.col("_n") >= side) & (F.col("_all") - F.col("_n") >= side))
    return fit.groupBy(*page).agg(F.max("_gap").alias("gap"), F.max_by("_cut", F.struct("_gap", -F.col(at))).alias("cut"))


def clustered(values: Column) -> Column:
    """Centres of sorted positions: one joins while within 0.05 of the running mean, and
    centres nearer than 0.04 fall together."""
    start = F.array().cast("array<struct<m: double, n: double>>")

    def grow(limit: float, inclusive: bool):
        def step(groups: Column, v: Column) -> Column:
            last = F.element_at(groups, -1)
            far = (v["m"] - last["m"] > limit) if inclusive else (v["m"] - last["m"] >= limit)
            fresh = F.concat(groups, F.array(v))
            joined = F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(F.struct(((last["m"] * last["n"] + v["m"] * v["n"]) / (last["n"] + v["n"])).alias("m"), (last["n"] + v["n"]).alias("n"))))
            return F.when((F.size(groups) == 0) | far, fresh).otherwise(joined)

        return step

    points = F.transform(F.sort_array(values), lambda v: F.struct(v.cast("double").alias("m"), F.lit(1.0).alias("n")))
    return let(F.aggregate(points, start, grow(CLUSTER, True)), lambda groups: F.transform(F.aggregate(groups, start, grow(SEPARATE, False)), lambda g: g["m"]))


def nearest(centres: Column, x: Column) -> Column:
    """0-based index of the nearest centre within reach, else null."""
    best = F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))
    return F.when(best["d"] <= REACH, best["i"])


def density(cells: Column, rows: Column, columns: Column) -> Column:
    return cells / F.greatest(rows * columns, F.lit(1))


def line_item_shaped(rows: Column, columns: Column, fill: Column) -> Column:
    return (rows >= 3) & columns.between(3, 6) & (fill >= 0.80)


def header_row(cells: Column) -> Column:
    """Half of the filled cells are heading words and none is a number."""
    from paperloom.functions.numbers import table_numeric

    filled = F.filter(F.transform(cells, lambda c: F.lower(F.trim(c))), lambda c: c != "")
    hits = F.filter(filled, lambda c: F.exists(F.split(c, r"\s+"), lambda w: w.isin(*HEADER_WORDS)))
    return (F.size(filled) > 0) & (F.size(hits) * 2 >= F.size(filled)) & ~F.exists(filled, table_numeric)


def markdown(rows: Column, header: Column) -> Column:
    """A table as Markdown from an array of rows (arrays of cells); without a heading row the
    heading is blank."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, clean), " | "), F.lit(" |"))
    width = F.size(F.element_at(rows, 1))
    blank, rule = F.array_repeat(F.lit(""), width), F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    head = F.when(header, line(F.element_at(rows, 1))).otherwise(line(blank))
    body = F.when(header, F.slice(rows, 2, F.size(rows))).otherwise(rows)
    return F.array_join(F.concat(F.array(head, rule), F.transform(body, line)), "\n")


# The table builder.
_MARKER = re.compile(rf"^(?:{LIST_MARKERS})$")
_CURRENCY = re.compile(r"^(?:USD|EUR|GBP|JPY|CHF|CAD)\s*")


def is_number(text: str) -> bool:
    bare = _CURRENCY.sub("", re.sub(r"[$€£¥,]", "", text.strip())).strip()
    bare = bare[:-1].strip() if bare.endswith("%") else bare
    return bool(re.fullmatch(r"[0-9.\-]*[0-9][0-9.\-]*", bare))


def is_marker(text: str) -> bool:
    t = text.strip()
    return bool(_MARKER.match(t)) or len(t) == 1 and not t.isalnum()


class Box:
    __slots__ = ("text", "x", "y", "w", "h")

    def __init__(self, text: str, x: float, y: float, w: float, h: float):
        self.text, self.x, self.y, self.w, self.h = text, x, y, w, h

    @property
    def mid(self) -> float:
        return self.y + self.h / 2

    def joined(self, other: "Box") -> "Box":
        x, y = min(self.x, other.x), min(self.y, other.y)
        return Box(f"{self.text} {other.text}", x, y, max(self.x + self.w, other.x + other.w) - x, max(self.y + self.h, other.y + other.h) - y)


def _median(values: list[float]) -> float:
    s = sorted(values)
    return 0.0 if not s else s[len(s) // 2] if len(s) % 2 else (s[len(s) // 2 - 1] + s[len(s) // 2]) / 2


def _same_row(a: Box, b: Box) -> bool:
    overlap = min(a.y + a.h, b.y + b.h) - max(a.y, b.y)
    return overlap >= ROW_OVERLAP * min(a.h, b.h) and overlap > 0 or abs(a.mid - b.mid) <= max(LINE_SHARE * max(a.h, b.h), LINE_LEAST)


def grid_rows(boxes: list[Box]) -> list[list[Box]]:
    """Rows of merged cells, by the first box of each row; boxes go by (y, x)."""
    rows: list[list[Box]] = []
    for box in sorted(boxes, key=lambda b: (b.mid, b.x)):
        if rows and _same_row(rows[-1][0], box):
            rows[-1].append(box)
        else:
            rows.append([box])
    out = []
    for row in rows:
        cells: list[Box] = []
        for box in sorted(row, key=lambda b: b.x):
            if cells and box.x - (cells[-1].x + cells[-1].w) <= CELL_GAP:
                cells[-1] = cells[-1].joined(box)
            else:
                cells.append(box)
        out.append(cells)
    return out


def _corridor(boxes: list[Box]) -> float | None:
    """A vertical cut between two side-by-side regions, if there is one."""
    if len(boxes) < 8:
        return None
    mids = sorted(b.x + b.w / 2 for b in boxes)
    gaps = [(mids[i + 1] - mids[i], (mids[i] + mids[i + 1]) / 2) for i in range(3, len(mids) - 4)]
    if not gaps:
        return None
    gap, cut = max(gaps)
    if gap < CORRIDOR:
        return None
    left, right = [b for b in boxes if b.x + b.w / 2 < cut], [b for b in boxes if b.x + b.w / 2 >= cut]
    free = min(b.x for b in right) - max(b.x + b.w for b in left)
    if free < CORRIDOR:
        return None
    spans = [(min(b.y for b in s), max(b.y + b.h for b in s)) for s in (left, right)]
    overlap = min(spans[0][1], spans[1][1]) - max(spans[0][0], spans[1][0])
    if overlap < CORRIDOR_OVERLAP * min(t - s for s, t in spans):
        return None
    several = [[r for r in grid_rows(s) if len(r) >= 2] for s in (left, right)]
    if min(map(len, several)) < 2:
        return None
    inner = max([GUTTER] + [row[i + 1].x - row[i].x - row[i].w for side in several for row in side for i in range(len(row) - 1)])
    if free < CORRIDOR_FACTOR * inner or _shared_baselines(several[0], several[1]):
        return None
    return cut


def _shared_baselines(left: list[list[Box]], right: list[list[Box]]) -> bool:
    """Do the rows of both sides stand on the same lines (then it is one table)?"""
    a, b = ([_median([c.mid for c in row]) for row in side] for side in (left, right))
    heights = [c.h for side in (left, right) for row in side for c in row]
    tolerance = max(LINE_SHARE * _median(heights), LINE_LEAST)
    free, met = list(b), 0
    for y in a:
        best = min(free, key=lambda v: abs(v - y), default=None)
        if best is not None and abs(best - y) <= tolerance:
            free.remove(best)
            met += 1
    return met / min(len(a), len(b)) >= SHARED_SHORT or met / len(a) >= SHARED_BOTH and met / len(b) >= SHARED_BOTH


def _bands(rows: list[list[Box]]) -> list[list[list[Box]]]:
    heights = [c.h for r in rows for c in r]
    limit = max(REGION_GAP, REGION_HEIGHTS * _median(heights))
    bands: list[list[list[Box]]] = []
    for row in rows:
        top = min(c.y for c in row)
        if bands and top - max(c.y + c.h for c in bands[-1][-1]) < limit:
            bands[-1].append(row)
        elif bands and len(bands[-1]) == 1 and top - max(c.y + c.h for c in bands[-1][-1]) < limit * ORPHAN:
            bands[-1].append(row)
        else:
            bands.append([row])
    return bands


def _centres(xs: list[float]) -> list[float]:
    groups: list[list[float]] = []
    for x in sorted(xs):
        if groups and x - sum(groups[-1]) / len(groups[-1]) <= CLUSTER:
            groups[-1].append(x)
        else:
            groups.append([x])
    out: list[list[float]] = []
    for g in groups:
        if out and sum(g) / len(g) - sum(out[-1]) / len(out[-1]) < SEPARATE:
            out[-1].extend(g)
        else:
            out.append(g)
    return [sum(g) / len(g) for g in out]


def _keywords(row: list[Box]) -> int:
    return sum(any(w in HEADER_WORDS for w in c.text.lower().split()) for c in row)


def _build(band: list[list[Box]]) -> list[list[Box | None]] | None:
    """The grid of a band of rows, or none: doubtful bands make no table."""
    most = max(map(len, band))
    spine = []
    for row in band:
        numbers = sum(is_number(c.text) for c in row)
        if numbers >= 1 and (len(row) >= max(2, most - 1) or len(row) >= 3) or numbers >= 2 or any(is_marker(c.text) for c in row) or _keywords(row) >= 2:
            spine.append(row)
    if len(spine) < 2:
        spine = [row for row in band if len(row) >= max(2, most - 1)]
    if len(spine) < 2 or sum(any(r[i + 1].x - r[i].x - r[i].w >= GUTTER for i in range(len(r) - 1)) for r in spine) < 2:
        return None
    centres = _centres([c.x for row in spine for c in row])

    def assign(rows: list[list[Box]], at: list[float]) -> list[list[Box | None]]:
        grid = []
        for row in rows:
            line: list[Box | None] = [None] * len(at)
            for cell in row:
                distance, i = min((abs(cell.x - c), i) for i, c in enumerate(at))
                if distance <= REACH:
                    line[i] = cell if line[i] is None else line[i].joined(cell)
            grid.append(line)
        return grid

    def kept_columns(grid: list[list[Box | None]], at: list[float]) -> list[float]:
        least = max(2, math.ceil(0.25 * len(grid)))
        out = []
        for i, c in enumerate(at):
            hits = [row[i] for row in grid if row[i] is not None]
            if len(hits) >= least and not all(is_marker(h.text) for h in hits):
                out.append(c)
        return out

    rows = band
    for _ in range(2):
        grid = assign(rows, centres)
        centres = kept_columns(grid, centres)
        if len(centres) < 2:
            return None
        grid = assign(rows, centres)
        good = [k for k, row in enumerate(grid) if sum(c is not None for c in row) >= max(2, len(centres) - 1)]
        rows = [rows[k] for k in good]
        grid = [grid[k] for k in good]
        if len(grid) < 2:
            return None
    columns = [[row[i] for row in grid if row[i] is not None] for i in range(len(centres))]
    if any(not c for c in columns):
        return None
    if not any(sum(is_number(c.text) for c in column) * 2 >= len(column) for column in columns):
        cells = [c for column in columns for c in column]
        if any(len(c.text.split()) > WORDS or c.w > WIDTH for c in cells) or len(grid) < 3:
            return None
    filled = sum(c is not None for row in grid for c in row)
    if filled / (len(grid) * len(centres)) < DENSITY or sum(sum(c is not None for c in row) >= 2 for row in grid) < 2:
        return None
    return grid


def find_tables(boxes: list[Box], depth: int = 0) -> list[list[list[Box | None]]]:
    if len(boxes) < 4:
        return []
    if depth < DEPTH:
        cut = _corridor(boxes)
        if cut is not None:
            return find_tables([b for b in boxes if b.x + b.w / 2 < cut], depth + 1) + find_tables([b for b in boxes if b.x + b.w / 2 >= cut], depth + 1)
    rows = [row for row in grid_rows(boxes) if len(row) >= 2]
    tables = []
    for band in _bands(rows):
        if len(band) < 2:
            continue
        grid = _build(band)
        if grid is not None:
            tables.append(grid)
        elif len(band) >= 4 and depth < DEPTH:
            gaps = [(min(c.y for c in b) - max(c.y + c.h for c in a), k + 1) for k, (a, b) in enumerate(zip(band, band[1:]))]
            gap, at = max(gaps)
            if gap >= BAND_GAP:
                for part in (band[:at], band[at:]):
                    tables.extend(find_tables([c for row in part for c in row], depth + 1))
    return tables


def detect_tables(blocks: DataFrame, key: str = "doc_id", mode: str = "automatic") -> DataFrame:
    """Cells of the tables on each page: ``key, page, table_ix, row, col, row_count,
    column_count, header_row, text, x, y, w, h``; holes have no row.  Mode 'off' finds none.
    Blank texts and boxless blocks are left out."""
    kind = dict(blocks.dtypes)[key]
    schema = f"`{key}` {kind}, page int, table_ix int, row int, col int, row_count int, column_count int, header_row int, text string, x double, y double, w double, h double"
    usable = blocks.where("trim(text) <> '' and x is not null and y is not null and w is not null and h is not null and page is not null")
    if mode == "off":
        usable = usable.limit(0)

    def run(page: pd.DataFrame) -> pd.DataFrame:
        boxes = [Box(*r) for r in page[["text", "x", "y", "w", "h"]].itertuples(index=False)]
        out = []
        for t, grid in enumerate(find_tables(boxes)):
            texts = [[re.sub(rf"^(?:{LIST_MARKERS}) +(?=\S)", "", c.text) if c else None for c in row] for row in grid]
            first = [c for c in texts[0] if c]
            head = 0 if sum(any(w in HEADER_WORDS for w in c.lower().split()) for c in first) * 2 >= len(first) and not any(is_number(c) for c in first) else -1
            out += [(page[key].iloc[0], int(page["page"].iloc[0]), t, r, i, len(grid), len(row), head, texts[r][i], c.x, c.y, c.w, c.h) for r, row in enumerate(grid) for i, c in enumerate(row) if c is not None]
        return pd.DataFrame(out, columns=[s.split()[0].strip("`") for s in schema.split(", ")])

    return usable.select(key, F.col("page").cast("int").alias("page"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]).groupBy(key, "page").applyInPandas(run, schema)
