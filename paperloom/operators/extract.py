"""The attempt loop: prompt, generation, decoding, invariants, repair, policy.

Generation is a pluggable function from prompt rows to texts; everything around it is
DataFrames.  Attempt k runs on the rows that attempt k-1 did not settle, so a document is
generated for no more often than it has to be, and each attempt is materialised once
(generation is not repeatable).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from paperloom.functions.text import trimmed
from paperloom.operators.chunk import chunk_documents
from paperloom.operators.json_text import decode_errors, found_object, partial_record
from paperloom.operators.merge import merge_documents
from paperloom.plans.schema import Schema
from paperloom.session import checkpointed

MAX_RETRIES = 2
STATUSES = ("accepted", "rejected", "failed", "emptyResponse", "cannotReadImages", "emptyDocument", "unreadableSource", "timeout")

Generate = Callable[[pd.Series, pd.Series, int], pd.Series]


def prompt(schema: Schema, text: Column, locale: Column | None = None, tables: Column | None = None, repair: Column | None = None, partial: bool = False) -> Column:
    """The prompt in its order: record type, schema, partial note, guides, locale, repair,
    document, tables (only for schemas with a collection), closing line."""
    shown = schema.partial() if partial else schema
    guides = schema.guides()
    sections: list[Column] = [F.lit(f"Extract one {schema.title or 'record'} from the document."), F.lit("Schema:\n" + shown.text())]
    if partial:
        sections.append(F.lit("The document is one part of a longer one: give only what this part shows."))
    if guides:
        sections.append(F.lit("Fields:\n" + "\n".join(guides)))
    if locale is not None:
        sections.append(F.when(locale.isNotNull(), F.concat(F.lit("Numbers and dates follow the locale "), locale, F.lit("."))))
    if repair is not None:
        sections.append(F.when(trimmed(repair) != "", F.concat(F.lit("The last answer was refused:\n"), repair)))
    sections.append(F.concat(F.lit("Document:\n"), text))
    if tables is not None and schema.has_collection():
        sections.append(F.when(trimmed(tables) != "", F.concat(F.lit("Tables:\n"), tables)))
    sections.append(F.lit("Answer with the JSON object alone."))
    return F.concat_ws("\n\n", *sections)


def issue_text(issues: Column) -> Column:
    """Issues as lines for a repair prompt."""
    return F.array_join(F.transform(issues, lambda i: F.format_string("field `%s`: expected %s, found %s", i["path"], i["expected"], F.coalesce(i["found"], F.lit("nothing")))), "\n")


def canned(answers: list[str]) -> Generate:
    """A stand-in for a model: the answer of each attempt, the last one from then on."""

    def generate(keys: pd.Series, prompts: pd.Series, attempt: int) -> pd.Series:
        return pd.Series([answers[min(attempt, len(answers) - 1)]] * len(prompts), dtype="object")

    return generate


def growing(answers: list[str], size: int = 7) -> Callable[[int], Iterator[str]]:
    """A stand-in for a model that streams: of each attempt's answer the text so far, piece by
    piece."""

    def stream(attempt: int) -> Iterator[str]:
        answer = answers[min(attempt, len(answers) - 1)]
        for end in range(size, len(answer) + size, size):
            yield answer[:end]

    return stream


def generated(rows: DataFrame, key: str, generate: Generate, attempt: int, seconds: float | None = None) -> DataFrame:
    """``rows`` (with ``prompt``) and the model's ``raw`` text.

    With ``seconds`` each row is asked for by itself, and an answer that takes longer is given
    up: its ``raw`` is null and ``late`` (boolean, there only with ``seconds``) is true.
    """
    late = [] if seconds is None else [StructField("late", BooleanType())]
    schema = StructType([*rows.schema.fields, StructField("raw", StringType()), *late])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if seconds is None:
                yield batch.assign(raw=generate(batch[key], batch["prompt"], attempt).to_numpy())
                continue
            done = [within_seconds(lambda i=i: generate(batch[key].iloc[i:i + 1], batch["prompt"].iloc[i:i + 1], attempt).iloc[0], seconds) for i in range(len(batch))]
            yield batch.assign(raw=pd.Series([d[0] for d in done], index=batch.index, dtype="object"), late=[d[1] is not None for d in done])

    return rows.mapInPandas(run, schema)


def attempt_loop(docs: DataFrame, key: str, schema: Schema, generate: Generate, invariants: Callable[[Column], Column] | None = None, max_retries: int = MAX_RETRIES, images: Column | None = None, sees_images: bool = True, first: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    """All attempts of all documents: ``key, attempt, raw, json, status, issues, errors``.

    A document whose text is blank is not asked for ('emptyDocument'), nor one with images
    for a model that sees none ('cannotReadImages').  A blank answer ends a document
    ('emptyResponse'); an answer that does not decode ('failed') or breaks an invariant
    ('rejected') is asked again with the reasons, up to ``max_retries`` more times.  With
    ``first`` (``key, json``) the attempt 0 is that record, for which nothing is generated.
    An answer that takes more than ``seconds`` ends its document ('timeout').
    """
    kind = dict(docs.dtypes)[key]
    base = docs.select(key, "text", (images if images is not None else F.lit(False)).alias("_images"))
    blank = F.coalesce(trimmed(F.col("text")), F.lit("")) == ""
    refused = F.when(blank, "emptyDocument").when(F.col("_images") & F.lit(not sees_images), "cannotReadImages")
    nothing = "array<struct<path: string, expected: string, found: string>>"
    done = base.where(refused.isNotNull()).select(key, F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("raw"), F.lit(None).cast("string").alias("json"), refused.alias("status"), F.array().cast(nothing).alias("issues"), F.array().cast("array<string>").alias("errors"))
    todo = base.where(refused.isNull()).select(key, "text", F.lit("").alias("repair"))
    for attempt in range(max(1, max_retries + 1)):
        if attempt == 0 and first is not None:
            answered = todo.join(first.select(key, F.col("json").alias("raw")), key, "left").withColumn("json", F.col("raw"))
        else:
            asked = todo.withColumn("prompt", prompt(schema, F.col("text"), repair=F.col("repair")))
            answered = generated(asked, key, generate, attempt, seconds).withColumn("json", found_object(F.col("raw")))
        answered = answered.withColumn("errors", F.when(F.col("json").isNull(), F.array(F.lit("the answer holds no JSON object"))).otherwise(decode_errors(F.col("json"), schema)))
        checked = invariants(F.col("json")) if invariants is not None else F.array().cast(nothing)
        answered = answered.withColumn("issues", F.when(F.size("errors") == 0, checked).otherwise(F.array().cast(nothing)))
        late = F.col("late") if "late" in answered.columns else F.lit(False)
        status = F.when(late, "timeout").when(F.coalesce(trimmed(F.col("raw")), F.lit("")) == "", "emptyResponse").when(F.size("errors") > 0, "failed").when(F.size("issues") > 0, "rejected").otherwise("accepted")
        settled = checkpointed(answered.withColumn("status", status).withColumn("attempt", F.lit(attempt)))
        done = done.unionByName(settled.select(key, "attempt", "raw", "json", "status", "issues", "errors"))
        todo = settled.where("status in ('failed', 'rejected')").select(key, "text", F.concat_ws("\n", F.array_join("errors", "\n"), issue_text(F.col("issues"))).alias("repair"))
    return done.withColumn(key, F.col(key).cast(kind))


def chunked_extraction(docs: DataFrame, key: str, schema: Schema, generate: Generate, budget: Column, invariants: Callable[[Column], Column] | None = None, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Attempts of documents that are read in chunks: a partial record per chunk, merged
    deterministically into attempt 0, then repairs on the whole document.  The columns of
    ``attempt_loop`` and ``chunks_used``."""
    pages = docs.select(key, F.split("text", "\n\n").alias("pages"), budget.alias("_budget"))
    chunks = chunk_documents(pages, key, "pages", F.col("_budget"))
    asked = chunks.withColumn("prompt", prompt(schema, F.col("chunk"), partial=True))
    partials = checkpointed(generated(asked, key, generate, 0).select(key, F.col("chunk_ix").alias("chunk"), partial_record(F.col("raw")).alias("json")))
    merged = merge_documents(partials, docs, key).select(key, F.col("merged").alias("json"))
    used = partials.groupBy(key).agg(F.count("*").cast("int").alias("chunks_used"))
    attempts = attempt_loop(docs, key, schema, generate, invariants, max_retries, first=merged)
    return attempts.join(used, key, "left").fillna(0, ["chunks_used"])


def outcome(attempts: DataFrame, key: str, policy: str = "strict") -> DataFrame:
    """One row per document: ``key, status, json, attempts, issues``.

    Strict: only an accepted record counts.  Report: the last rejected record stands with its
    issues, even if a later attempt failed to decode.
    """
    order = Window.partitionBy(key).orderBy("attempt").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    usable = F.when(F.col("status").isin("accepted", "rejected"), F.struct("json", "issues", "status"))
    seen = attempts.withColumn("_last", F.last(usable, ignorenulls=True).over(order)).withColumn("_final", F.last("status").over(order)).withColumn("_n", F.max("attempt").over(order) + 1)
    one = seen.groupBy(key).agg(F.first("_last").alias("_last"), F.first("_final").alias("_final"), F.first("_n").alias("attempts"))
    good = F.col("_last.status") == "accepted"
    if policy == "strict":
        return one.select(key, F.when(good, "accepted").otherwise(F.col("_final")).alias("status"), F.when(good, F.col("_last.json")).alias("json"), "attempts", F.when(~F.coalesce(good, F.lit(False)), F.col("_last.issues")).alias("issues"))
    return one.select(key, F.coalesce(F.col("_last.status"), F.col("_final")).alias("status"), F.col("_last.json").alias("json"), "attempts", F.col("_last.issues").alias("issues"))


def within_seconds(call: Callable[[], str], seconds: float = 240.0) -> tuple[str | None, str | None]:
    """(answer, None), or (None, 'timeout') where a call takes longer."""
    from concurrent.futures import ThreadPoolExecutor
    from concurrent.futures import TimeoutError as Late

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(call).result(timeout=seconds), None
    except Late:
        return None, "timeout"
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
