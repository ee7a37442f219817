"""Documents from blocks: page text, lines in reading order, packing and hard splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import trimmed

AUTOMATIC_BUDGET = 12_000
SPLIT_WINDOW = 80


def scanned_text(text: Column) -> Column:
    """Blocks of a plain text: one of the trimmed text, none of a blank one."""
    return F.when(trimmed(text) != "", F.array(trimmed(text))).otherwise(F.array().cast("array<string>"))


def filled_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with their text trimmed, blank ones gone."""
    return blocks.withColumn("text", trimmed(F.col("text"))).where("text <> ''")


def positioned(blocks: DataFrame) -> DataFrame:
    """Blocks that have a page and a whole box."""
    return blocks.where("page is not null and x is not null and y is not null and w is not null and h is not null")


def document_text(blocks: DataFrame, key: str = "doc_id", headers: bool = True) -> DataFrame:
    """``key, full_text``: unpaged text first, then the pages in order, each under its header.

    With ``headers`` off it is the text that chunking counts: page texts joined by newlines.
    """
    pages = filled_blocks(blocks).groupBy(key, "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), "\n").alias("body"))
    if headers:
        body = F.when(F.col("page").isNull(), F.col("body")).otherwise(F.concat(F.format_string("--- Page %d ---\n", F.col("page") + 1), F.col("body")))
        pages, glue = pages.withColumn("body", body), "\n\n"
    else:
        glue = "\n"
    order = F.struct(F.coalesce(F.col("page"), F.lit(-1)).alias("p"), F.col("body").alias("body"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda p: p["body"]), glue).alias("full_text"))


def hard_split(text: str, budget: int) -> list[str]:
    """Slices of about ``budget`` characters, cut at a newline near the budget, else at a
    blank, else hard; a slice may run past the budget as far as the window reaches."""
    if budget <= 0:
        return [text]
    slices, start = [], 0
    while start < len(text):
        hard = start + budget
        if hard >= len(text):
            slices.append(text[start:])
            break
        window = min(SPLIT_WINDOW, budget)
        back, ahead = text[max(start, hard - window):hard], text[hard:hard + window]
        cut = hard
        for fits in (lambda c: c in "\n\r\x0b\x0c\x85\u2028\u2029", str.isspace):
            before = next((i for i in range(len(back) - 1, -1, -1) if fits(back[i])), None)
            if before is not None:
                cut = hard - len(back) + before + 1
                break
            after = next((i for i, c in enumerate(ahead) if fits(c)), None)
            if after is not None:
                cut = hard + after + 1
                break
        slices.append(text[start:cut])
        start = cut
    return slices


def pack(pages: list[str], budget: int) -> list[str]:
    """Page texts packed greedily into chunks of the budget (marks between them uncounted)."""
    whole = "\n".join(pages)
    if budget <= 0 or sum(map(len, pages)) <= budget:
        return [whole] if whole else []
    chunks, held, size = [], [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            chunks.append("\n".join(held))
        held, size = [], 0

    for page in pages:
        if len(page) > budget:
            flush()
            chunks.extend(hard_split(page, budget))
            continue
        if size + len(page) > budget:
            flush()
        held.append(page)
        size += len(page)
    flush()
    return chunks


def chunk_documents(pages: DataFrame, key: str, pages_column: str, budget: Column) -> DataFrame:
    """``key, chunk_ix, chunk``: each document's page texts (an array) packed to its budget."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, p, b in zip(batch["_k"], batch["_p"], batch["_b"]) for i, c in enumerate(pack([x for x in (p if p is not None else []) if x], int(b) if pd.notna(b) else 0))]
            yield pd.DataFrame(rows, columns=[key, "chunk_ix", "chunk"])

    narrow = pages.select(F.col(key).alias("_k"), F.col(pages_column).alias("_p"), budget.cast("bigint").alias("_b"))
    return narrow.mapInPandas(run, f"`{key}` {kind}, chunk_ix int, chunk string")


def resolved_budget(mode: str, length: Column, fixed: int | None = None) -> Column:
    """The budget of a chunking mode: 'none' is 0, 'fixed' as given, 'automatic' the default
    where the text is longer than it."""
    if mode == "none":
        return F.lit(0)
    if mode == "fixed":
        return F.lit(fixed or 0)
    return F.when(length > AUTOMATIC_BUDGET, AUTOMATIC_BUDGET).otherwise(0)


def tables_in_chunks(chunks: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables whose every filled cell stands in a chunk: ``key, chunk_ix, table_ix``.
    ``tables`` has ``key, table_ix, cells array<string>``."""
    cells = F.filter("cells", lambda c: trimmed(c) != "")
    joined = chunks.join(tables.withColumn("_cells", cells), key)
    return joined.where((F.size("_cells") > 0) & F.forall("_cells", lambda c: F.contains(F.col("chunk"), trimmed(c)))).select(key, "chunk_ix", "table_ix")
