"""The pN queries of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.encode import encode_documents
from paperloom.llm.entities import link_names
from paperloom.llm.leaks import find_leaks, find_similar
from paperloom.llm.lookalike import add_canonical, lookalike_pairs
from paperloom.llm.personal import find_personal, redact
from paperloom.llm.pieces import cut_texts
from paperloom.llm.scans import count_lexicon, repaired, repairs
from paperloom.llm.sentences import sentence_units, train
from paperloom.tables import delivered_once, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = delivered_once(table(spark, sf_dir, "blocks"), "block_id", "inspection_id", "text")
    pairs = lookalike_pairs(blocks, "block_id", "inspection_id", "text")
    rows = delivered_once(table(spark, sf_dir, "mrz_comparisons"), "comparison_id", "mrz_value", "extracted_value")
    rows = add_canonical(rows.where("mrz_value <> extracted_value"), {"mrz_value": "form_a", "extracted_value": "form_b"})
    same = rows.where("form_a = form_b")
    return pairs.select(F.lit("blocks").alias("src"), "id_a", "id_b").unionByName(
        same.select(F.lit("mrz_comparisons").alias("src"), F.col("comparison_id").alias("id_a"), F.col("comparison_id").alias("id_b"))
    )


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, key: str, field: str) -> DataFrame:
        return delivered_once(table(spark, sf_dir, name), key, field).select(F.lit(name).alias("src"), F.col(key).alias("record_id"), F.col(field).alias("written"))

    records = of("receipts", "receipt_id", "merchant").unionByName(of("invoices", "invoice_id", "vendor"))
    return link_names(records, "written", table(spark, sf_dir, "organisations"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    register = table(spark, sf_dir, "organisations").select("org_id", "registered_name")
    linked = p2_links(spark, sf_dir).where("org_id is not null")
    return linked.join(register, "org_id").where("written <> registered_name").select("src", "record_id", "org_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text")
    arms = delivered_once(table(spark, sf_dir, "chunk_merge_arms"), "arm_id", "inspection_id", "soft_budget", "overlap_chars")
    return cut_texts(texts, arms, "inspection_id", "full_text", "arm_id", "soft_budget", "overlap_chars")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The last piece of a text that had to be cut.
    return p3_pieces(spark, sf_dir).where("pieces > 1 and piece_no = pieces - 1").select("arm_id")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = p3_pieces(spark, sf_dir).where("piece_no = pieces - 1").select("arm_id", "pieces")
    arms = delivered_once(table(spark, sf_dir, "chunk_merge_arms"), "arm_id", "chunks_used")
    return arms.join(made, "arm_id", "left").select("arm_id", "chunks_used", "pieces")


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    texts = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text")
    return texts, count_lexicon(texts, "full_text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, lexicon = _scans(spark, sf_dir)
    return repairs(texts, "inspection_id", "full_text", lexicon)


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, lexicon = _scans(spark, sf_dir)
    return repaired(texts, "inspection_id", "full_text", lexicon)


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = delivered_once(table(spark, sf_dir, "inspections"), "inspection_id", "full_text")
    known = table(spark, sf_dir, "identity_documents")
    names = known.select(F.col("full_name").alias("seed"))
    numbers = known.select(F.col("document_number").alias("seed"))
    return texts, find_personal(texts, "inspection_id", "full_text", names, numbers)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mentions = _mentions(spark, sf_dir)
    return mentions.select(F.col("id").alias("inspection_id"), "pii_kind", "surface").distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, mentions = _mentions(spark, sf_dir)
    return redact(texts, "inspection_id", "full_text", mentions)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_similar(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentence_units(docs, train(docs))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plain = docs.where("markup = 'plain' and text <> ''")
    return sentence_units(plain, train(docs)).select("doc_id", "sent_end").dropDuplicates()


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_links, p3_found, p3_pieces, p3_counts, p4_found, p4_paragraphs, p7_found, p7_redacted, p8_ids, p9_found, p9_similar, p10_found, p10_sentences)}

SQL: dict[str, str] = {
    "p3_found": """
        select arm_id from (select distinct arm_id, inspection_id, soft_budget from chunk_merge_arms)
        join (select inspection_id, any_value(full_text) as full_text from inspections group by 1) using (inspection_id)
        where length(full_text) > soft_budget and soft_budget >= 1""",
    "p9_found": r"""
        with i as (select item_id, coalesce(lower(lang), '') like 'zh%' as zh, text from eval_items),
        iw as (select item_id, zh, case when zh then 20 else 12 end as n, regexp_extract_all(lower(regexp_replace(text, '<[^<>]*>|\[[^\[\]]*\]', ' ', 'g')), case when zh then '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]|\p{Nd}' else '[\p{L}\p{N}]+' end) as w from i),
        ig as (select distinct item_id, zh, array_to_string(w[k:k + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as k from iw)),
        d as (select doc_id, regexp_replace(text, '<[^<>]*>|\[[^\[\]]*\]', ' ', 'g') as t from documents where text is not null),
        dw as (select doc_id, false as zh, 12 as n, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') as w from d union all select doc_id, true, 20, regexp_extract_all(t, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]|\p{Nd}') from d),
        dg as (select doc_id, zh, array_to_string(w[k:k + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as k from dw))
        select distinct doc_id, item_id from dg join ig using (zh, g)""",
}
