"""Files as documents: discovery, type sniffing, frames, embedded e-invoices; and sinks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.dates import invoice_date
from paperloom.functions.numbers import parse_decimal
from paperloom.functions.text import trimmed

# Extensions by kind.
PDF, IMAGES, TEXTS = ("pdf",), ("png", "jpg", "jpeg", "heic", "heif", "tif", "tiff", "gif", "bmp", "webp"), ("txt", "md", "csv", "json", "html", "xml")
# Attachment names of e-invoices, best first.
PREFERRED = ("factur-x.xml", "zugferd-invoice.xml", "zugferd.xml", "xrechnung.xml")
# Root elements that tell an e-invoice.
INVOICE_ROOTS = ("CrossIndustryInvoice", "CrossIndustryDocument")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def discover(spark: SparkSession, *roots: str, extensions: tuple[str, ...] = PDF + IMAGES + TEXTS) -> DataFrame:
    """Files below the roots, each once, by path: ``path, length, modificationTime, content``.
    Hidden files and folders are left out; content is read only where it is used."""
    found = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        found = files if found is None else found.unionByName(files)
    return found.where(extension(F.col("path")).isin(*extensions) & ~F.col("path").rlike(r"/\.")).dropDuplicates(["path"])


def sniffed(path: Column, content: Column) -> Column:
    """Kind of a file: by its first bytes, then its extension, then whether it is text."""
    head = F.hex(F.substring(content, 1, 12))
    ext = extension(path)
    text = F.try_validate_utf8(content)
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.rlike("^(89504E47|FFD8FF|47494638|49492A00|4D4D002A|424D|52494646.{8}57454250)"), "image")
        .when(ext.isin(*PDF), "pdf").when(ext.isin(*IMAGES), "image").when(ext.isin(*TEXTS) & text.isNotNull(), "text")
        .when((trimmed(text) != "") & ~text.rlike(r"[\x{00}-\x{08}]"), "text").otherwise("unreadableSource")
    )


def ingest_files(files: DataFrame) -> DataFrame:
    """``path, kind, text, status``: text files read, others passed on to the seams."""
    kinds = files.withColumn("kind", sniffed(F.col("path"), F.col("content")))
    text = F.when(F.col("kind") == "text", trimmed(F.try_validate_utf8(F.col("content"))))
    status = F.when(F.col("kind") == "unreadableSource", "unreadableSource").when((F.col("kind") == "text") & (text == ""), "emptyDocument").otherwise("ok")
    return kinds.select("path", "kind", text.alias("text"), status.alias("status"))


def frames_of(files: DataFrame, decode: Callable[[bytes], list[bytes | None]]) -> DataFrame:
    """Frames of pictures as pages: ``path, page, frame, status``.  An empty frame keeps its
    number; a frame that cannot be decoded (None) or an exception fails the whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    frames = decode(bytes(content))
                except Exception:  # noqa: BLE001 - whatever a decoder raises is the file's failure
                    frames = [None]
                if any(f is None for f in frames):
                    rows.append((path, None, None, "unreadableSource"))
                else:
                    rows += [(path, i, f, "ok") for i, f in enumerate(frames)]
            yield pd.DataFrame(rows, columns=["path", "page", "frame", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, frame binary, status string")


def single_picture(frames: DataFrame) -> DataFrame:
    """A source that takes one picture: files of several frames fail."""
    counted = frames.groupBy("path").agg(F.count("*").alias("n"), F.first("status").alias("status"), F.first("frame").alias("frame"))
    return counted.select("path", F.when(F.col("n") > 1, F.lit("multipleFrames")).otherwise(F.col("status")).alias("status"), F.when(F.col("n") == 1, F.col("frame")).alias("frame"))


def page_images(pages: DataFrame, key: str) -> DataFrame:
    """Page images kept beside the text: ``key, images array<struct<page, media_type, data>>``."""
    return pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page", "media_type", "data"))).alias("images"))


def chosen_attachment(attachments: DataFrame, key: str) -> DataFrame:
    """The e-invoice of a document among its attachments (``key, name, xml``): of the XML files
    that look like one, first those of a preferred name, then by name.  A preferred name whose
    content is no invoice is passed over."""
    names = F.create_map(*[F.lit(x) for i, n in enumerate(PREFERRED) for x in (n, i)])
    looks = F.greatest(*[F.contains(F.col("xml"), F.lit(root)) for root in INVOICE_ROOTS])
    rank = F.coalesce(F.element_at(names, F.lower("name")), F.lit(len(PREFERRED)))
    fitting = attachments.where(looks & (extension(F.col("name")) == "xml"))
    return fitting.groupBy(key).agg(F.min_by("xml", F.struct(rank, F.lower("name"), "name")).alias("xml"))


def invoice_truth(docs: DataFrame, key: str, xml: str = "xml") -> DataFrame:
    """Header and lines of cross-industry invoices: ``key, invoice_number, currency, seller,
    issue_date, grand_total, tax_total, lines``; names are read without their prefixes."""
    bare = F.regexp_replace(F.regexp_replace(F.col(xml), r"(</?)[A-Za-z0-9]+:", "$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    made = docs.withColumn("_x", bare)
    first = lambda path: F.nullif(F.xpath_string("_x", F.lit(path)), F.lit(""))
    base = "/CrossIndustryInvoice"
    deal, line = f"{base}/SupplyChainTradeTransaction", f"{base}/SupplyChainTradeTransaction/IncludedSupplyChainTradeLineItem"
    column = lambda path: F.xpath("_x", F.lit(f"{line}/{path}/text()"))
    summary = f"{deal}/ApplicableHeaderTradeSettlement/SpecifiedTradeSettlementHeaderMonetarySummation"
    lines = F.transform(
        F.arrays_zip(column("SpecifiedTradeProduct/Name").alias("d"), column("SpecifiedLineTradeDelivery/BilledQuantity").alias("q"), column("SpecifiedLineTradeSettlement/SpecifiedTradeSettlementLineMonetarySummation/LineTotalAmount").alias("t")),
        lambda z: F.struct(z["d"].alias("description"), parse_decimal(z["q"]).alias("quantity"), parse_decimal(z["t"]).alias("line_total")),
    )
    return made.select(
        key, first(f"{base}/ExchangedDocument/ID").alias("invoice_number"), first(f"{deal}/ApplicableHeaderTradeSettlement/InvoiceCurrencyCode").alias("currency"),
        first(f"{deal}/ApplicableHeaderTradeAgreement/SellerTradeParty/Name").alias("seller"), invoice_date(first(f"{base}/ExchangedDocument/IssueDateTime/DateTimeString")).alias("issue_date"),
        parse_decimal(first(f"{summary}/GrandTotalAmount")).alias("grand_total"), parse_decimal(first(f"{summary}/TaxTotalAmount")).alias("tax_total"), lines.alias("lines"),
    )


def inspect(docs: DataFrame, blocks: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """What a document holds, without any model: ``key, characters, blocks, positioned, pages,
    tables``."""
    b = blocks.where("trim(text) <> ''").groupBy(key).agg(F.count("*").alias("blocks"), F.count_if(F.col("page").isNotNull() & F.col("x").isNotNull()).alias("positioned"), F.count_distinct("page").alias("pages"))
    t = tables.groupBy(key).agg(F.count_distinct("page", "table_ix").alias("tables"))
    joined = docs.select(key, F.length(trimmed(F.coalesce("text", F.lit("")))).alias("characters")).join(b, key, "left").join(t, key, "left")
    return joined.fillna(0, ["blocks", "positioned", "pages", "tables"])


# Sinks.
def write_lines(df: DataFrame, path: str, private: tuple[str, ...] = ("text", "raw"), show_text: bool = False, order: str | None = None) -> None:
    """Rows as JSON lines with sorted keys and doubles to six places; body texts only if asked."""
    kept = df if show_text else df.drop(*private)
    rounded = kept.select(*[(F.round(c, 6) if t == "double" else F.col(c)).alias(c) for c, t in sorted(kept.dtypes)])
    (rounded.orderBy(order) if order else rounded).write.mode("overwrite").json(path)


def record_json(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as one pretty JSON text with sorted keys and ISO dates."""
    return df.select(F.to_json(F.struct(*sorted(columns)), {"pretty": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("json"))


def write_report(summary: DataFrame, path: str, title: str) -> None:
    """A small aggregate as a Markdown table.  The summary is one row per measure group (fields,
    arms), so it is brought to the driver; its rows are counted first and must be few."""
    rows = summary.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("a report is for aggregates, not for rows of data")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(summary.columns) + " |", "|" + " --- |" * len(summary.columns)]
    lines += ["| " + " | ".join(show(v) for v in row) + " |" for row in rows]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n".join(lines) + "\n")
