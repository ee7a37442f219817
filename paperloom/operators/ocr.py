"""Recognition passes: planning, orientation votes, line repair and reconciling passes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import latin_only, latin_repair

# Thresholds of orientation and reconciling.
GAIN, MARGIN, ORDER_RATIO, WITNESSES = 1.5, 1.2, 3.0, 3
GLYPH_SPREAD, IOU_LEAST, OVERLAP_LEAST = 0.25, 0.25, 0.25
DPI_LOW, DPI_HIGH = 72, 1200
TURNS = (0, 90, 180, 270)


def raster_size(width: Column, height: Column, dpi: Column, rotation: Column) -> Column:
    """Struct ``dpi, rotation, width, height`` in pixels of a page given in points."""
    clamped = F.least(F.greatest(dpi, F.lit(DPI_LOW)), F.lit(DPI_HIGH))
    turn = F.pmod(rotation, F.lit(360))
    sideways = turn.isin(90, 270)
    px = lambda v: F.round(v * clamped / 72).cast("int")
    return F.struct(clamped.alias("dpi"), turn.alias("rotation"), px(F.when(sideways, height).otherwise(width)).alias("width"), px(F.when(sideways, width).otherwise(height)).alias("height"))


def top_left(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """A box in points with its origin at the bottom left, as shares of the page from the top."""
    return F.struct((x / page_w).alias("x"), (1 - (y + h) / page_h).alias("y"), (w / page_w).alias("w"), (h / page_h).alias("h"))


def pass_plan(primary: Column, extra: Column) -> Column:
    """The passes to run: the primary one and the extras, each once, in order."""
    return F.array_distinct(F.concat(F.array(primary), F.coalesce(extra, F.array().cast("array<string>"))))


def probe_turns(pages: DataFrame) -> DataFrame:
    return pages.withColumn("turn", F.explode(F.array(*[F.lit(t) for t in TURNS])))


def line_blocks(lines: DataFrame, languages: Column) -> DataFrame:
    """Recognised lines as blocks: look-alikes repaired where all languages are Latin-written."""
    return lines.withColumn("text", F.when(latin_only(languages), latin_repair(F.col("text"))).otherwise(F.col("text")))


def right_to_left(text: Column) -> Column:
    """Is the first letter of a right-to-left script?"""
    first = F.regexp_extract(text, r"(\p{L})", 1)
    return first.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}]")


def line_orientation(text: Column, xs: Column, width: Column, height: Column) -> Column:
    """'upright' or 'upsideDown' by the order of the glyphs, 'unknown' where they say nothing."""
    spread = F.element_at(xs, -1) - F.element_at(xs, 1)
    tells = (width > height) & (F.size(xs) == F.length(text)) & (F.size(xs) >= 2) & (F.abs(spread) >= GLYPH_SPREAD * width)
    forward = (spread > 0) != right_to_left(text)
    return F.when(F.coalesce(tells, F.lit(False)), F.when(forward, "upright").otherwise("upsideDown")).otherwise("unknown")


def orientation_scores(lines: DataFrame, *page: str) -> DataFrame:
    """Per page and turn the summed length times confidence; lines that are not wide count a
    tenth: ``*page, turn, score``."""
    weight = F.length("text") * F.greatest(F.col("confidence"), F.lit(0.0)) * F.when(F.col("w") > F.col("h"), 1.0).otherwise(0.1)
    return lines.groupBy(*page, "turn").agg(F.sum(weight).alias("score"))


def order_witness(lines: DataFrame, *page: str) -> DataFrame:
    """Votes of the glyph order for each turn: upright lines for theirs, upside-down ones for
    the opposite; at least three lines and three times the rival's characters decide:
    ``*page, axis, turn``."""
    n = F.length("text")
    voted = lines.where("orientation in ('upright', 'upsideDown')").withColumn("for_turn", F.when(F.col("orientation") == "upright", F.col("turn")).otherwise(F.pmod(F.col("turn") + 180, F.lit(360))))
    voted = voted.withColumn("axis", F.col("turn") % 180)
    base = F.col("for_turn") == F.col("axis")
    sums = voted.groupBy(*page, "axis").agg(F.sum(F.when(base, n).otherwise(0)).alias("a"), F.sum(F.when(base, 0).otherwise(n)).alias("b"), F.count_if(base).alias("na"), F.count_if(~base).alias("nb"))
    turn = F.when((F.col("na") >= WITNESSES) & (F.col("a") >= ORDER_RATIO * F.col("b")), F.col("axis")).when((F.col("nb") >= WITNESSES) & (F.col("b") >= ORDER_RATIO * F.col("a")), F.col("axis") + 180)
    return sums.select(*page, "axis", turn.alias("turn")).where("turn is not null")


def best_rotation(scores: DataFrame, *page: str) -> DataFrame:
    """The turn of a page: the best score if it gains half on standing as it is, and whether
    its opposite comes within 1.2 of it: ``*page, rotation, ambiguous`` (ties: least turn)."""
    by_turn = scores.groupBy(*page).agg(*[F.max(F.when(F.col("turn") == t, F.col("score"))).alias(f"_{t}") for t in TURNS])
    score = {t: F.coalesce(f"_{t}", F.lit(0.0)) for t in TURNS}
    top = F.greatest(*score.values())
    best = F.coalesce(*[F.when(score[t] == top, t) for t in TURNS])
    turned = F.when((best != 0) & (top >= GAIN * score[0]) & (top > 0), best).otherwise(0)
    opposite = F.when(turned == 0, score[180]).when(turned == 90, score[270]).when(turned == 180, score[0]).otherwise(score[90])
    own = F.when(turned == 0, score[0]).when(turned == 90, score[90]).when(turned == 180, score[180]).otherwise(score[270])
    return by_turn.select(*page, turned.alias("rotation"), (own < MARGIN * opposite).alias("ambiguous"))


def resolve_rotations(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """An ambiguous page follows the decisive pages of its axis, by most pages (ties: least
    turn): ``key, page, rotation``."""
    with_axis = pages.withColumn("axis", F.col("rotation") % 180)
    counts = with_axis.where("not ambiguous").groupBy(key, "axis", "rotation").count()
    votes = counts.groupBy(key, "axis").agg(F.max_by("rotation", F.struct(F.col("count"), -F.col("rotation"))).alias("vote"))
    joined = with_axis.join(votes, [key, "axis"], "left")
    return joined.select(key, "page", F.when(F.col("ambiguous"), F.coalesce("vote", "rotation")).otherwise(F.col("rotation")).alias("rotation"))


def read_page(gate: Column, ocr_text: Column, layer_text: Column) -> Column:
    """Struct ``text, source``: recognition where the gate asks for it and it read something,
    else the text layer."""
    use = gate & (F.coalesce(F.trim(ocr_text), F.lit("")) != "")
    return F.struct(F.when(use, ocr_text).otherwise(layer_text).alias("text"), F.when(use, "ocr").otherwise("textLayer").alias("source"))


def _overlap(a: tuple, b: tuple) -> float:
    """How well two boxes match: IoU from its least on; boxes of one line by their overlap."""
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    ox, oy = min(ax + aw, bx + bw) - max(ax, bx), min(ay + ah, by + bh) - max(ay, by)
    inter = max(ox, 0) * max(oy, 0)
    union = aw * ah + bw * bh - inter
    iou = inter / union if union > 0 else 0.0
    if iou >= IOU_LEAST:
        return iou
    same_line = oy >= 0.25 * min(ah, bh) or abs(ay + ah / 2 - by - bh / 2) <= max(0.6 * max(ah, bh), 0.008)
    share = ox / min(aw, bw) if min(aw, bw) > 0 else 0
    return max(iou, 0.01) if same_line and share >= OVERLAP_LEAST else 0.0


def _union(a: tuple, b: tuple) -> tuple:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


def reconcile(lines: list[tuple[int, str, float, float, float, float]]) -> list[dict]:
    """One page's lines of several passes as one reading.

    The first pass's text is the page; other readings of a line are its alternatives, and
    agreement counts the passes that read the same.  A line that only a later pass saw fills
    a gap, unless its text is there already or it lies over a kept line (then it is that
    line's alternative).  Passes without text do not count.
    """
    passes = sorted({p for p, text, *_ in lines if text.strip()})
    rank = {p: i for i, p in enumerate(passes)}
    rows = sorted(((rank[p], i, text.strip(), (x, y, w, h)) for i, (p, text, x, y, w, h) in enumerate(lines) if text.strip()), key=lambda r: (r[0], r[1]))
    if len(passes) <= 1:
        return [{"text": t, "box": b, "matching": 1, "observing": 1, "alternatives": []} for _, _, t, b in rows]
    free, clusters = list(rows), []
    while free:
        seed = free.pop(0)
        members, box = [seed], seed[3]
        while True:
            seen = {m[0] for m in members}
            score, pick = max(((_overlap(box, r[3]), -k) for k, r in enumerate(free) if r[0] not in seen), default=(0.0, 0))
            if score <= 0:
                break
            chosen = free.pop(-pick)
            members.append(chosen)
            box = _union(box, chosen[3])
        clusters.append(members)
    out = []
    for members in clusters:
        lead = min(members)
        if lead[0] == 0:
            others = list(dict.fromkeys(m[2] for m in sorted(members) if m[2] != lead[2]))
            out.append({"text": lead[2], "box": lead[3], "matching": sum(m[2] == lead[2] for m in members), "observing": len(passes), "alternatives": others})
    for members in clusters:
        lead = min(members)
        if lead[0] == 0 or any(k["text"] == lead[2] for k in out):
            continue
        over = max(out, key=lambda k: _overlap(k["box"], lead[3]), default=None)
        if over is not None and _overlap(over["box"], lead[3]) > 0:
            over["alternatives"] = list(dict.fromkeys([*over["alternatives"], lead[2]]))
            over["matching"] = min(over["matching"], 1)
        else:
            out.append({"text": lead[2], "box": lead[3], "matching": 1, "observing": len(passes), "alternatives": []})
    return out


def reconcile_passes(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, page, ord, text, x, y, w, h, matching, observing, alternatives`` per page."""
    kind = dict(lines.dtypes)[key]
    schema = f"`{key}` {kind}, page int, ord int, text string, x double, y double, w double, h double, matching int, observing int, alternatives array<string>"

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["pass", "y", "x", "text"], kind="stable")
        made = reconcile([tuple(r) for r in page[["pass", "text", "x", "y", "w", "h"]].itertuples(index=False)])
        rows = [(page[key].iloc[0], int(page["page"].iloc[0]), i, m["text"], *m["box"], m["matching"], m["observing"], m["alternatives"]) for i, m in enumerate(made)]
        return pd.DataFrame(rows, columns=[s.split()[0].strip("`") for s in schema.split(", ")])

    boxes = [F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]
    return lines.where("text is not null").select(key, F.col("page").cast("int").alias("page"), F.col("pass").cast("int").alias("pass"), "text", *boxes).groupBy(key, "page").applyInPandas(run, schema)


def agreement_score(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """The pair score of two boxes as an expression (IoU, or 0.01 on one line)."""
    ox, oy = F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.least(ay + ah, by + bh) - F.greatest(ay, by)
    inter = F.greatest(ox, F.lit(0.0)) * F.greatest(oy, F.lit(0.0))
    iou = F.coalesce(F.try_divide(inter, aw * ah + bw * bh - inter), F.lit(0.0))
    same = (oy >= 0.25 * F.least(ah, bh)) | (F.abs(ay + ah / 2 - by - bh / 2) <= F.greatest(0.6 * F.greatest(ah, bh), F.lit(0.008)))
    share = F.coalesce(F.try_divide(ox, F.least(aw, bw)), F.lit(0.0))
    return F.when(iou >= IOU_LEAST, iou).when(same & (share >= OVERLAP_LEAST), F.greatest(iou, F.lit(0.01))).otherwise(0.0)
