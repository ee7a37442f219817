"""Generated text as a stream of pieces: growing records, emitted when they change.

Pieces arrive per document; the state holds the text so far (what came out of order waits)
and the last snapshot.  A snapshot goes out when it differs from the last, and the final
record when the end piece has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from paperloom.operators.json_text import find_record, object_snapshot, snapshot

UPDATES = StructType([StructField("doc_id", LongType()), StructField("seq", IntegerType()), StructField("kind", StringType()), StructField("payload", StringType())])
_STATE = StructType([StructField("text", StringType()), StructField("next", IntegerType()), StructField("last", StringType()), StructField("wait_seq", ArrayType(IntegerType())), StructField("wait_text", ArrayType(StringType())), StructField("wait_end", ArrayType(BooleanType()))])


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    text, due, last, seqs, texts, ends = state.get if state.exists else ("", 0, None, [], [], [])
    waiting = {s: (t, e) for s, t, e in zip(seqs, texts, ends)}
    rows = []
    if state.hasTimedOut:
        state.remove()
        final = find_record(text)
        rows = [] if final is None else [(key[0], due, "final", final)]
        # What waits behind a piece that never came is no part of the record, and is not lost.
        rows += [(key[0], s, "stray", waiting[s][0]) for s in sorted(waiting)]
        yield pd.DataFrame(rows, columns=UPDATES.names)
        return
    for batch in batches:
        for seq, piece, end in zip(batch["seq"], batch["piece"], batch["is_end"]):
            if int(seq) >= due:
                waiting[int(seq)] = (piece or "", bool(end))
    while due in waiting:
        piece, end = waiting.pop(due)
        text += piece
        grown = snapshot(text)
        if grown is not None and grown != last:
            rows.append((key[0], due, "partial", grown))
            last = grown
        due += 1
        if end:
            rows.append((key[0], due - 1, "final", find_record(text)))
            state.remove()
            yield pd.DataFrame(rows, columns=UPDATES.names)
            return
    state.update((text, due, last, list(waiting), [v[0] for v in waiting.values()], [v[1] for v in waiting.values()]))
    state.setTimeoutDuration(600_000)
    yield pd.DataFrame(rows, columns=UPDATES.names)


def record_updates(pieces: DataFrame) -> DataFrame:
    """Streaming rows ``doc_id, seq, kind, payload`` from ``doc_id, seq, piece, is_end``.

    ``kind`` is 'partial' or 'final'.  A document that falls silent for ten minutes ends with
    what its text holds; pieces that still wait behind a missing one come out as they are, as
    'stray'.  A null end mark is none.
    """
    return pieces.groupBy("doc_id").applyInPandasWithState(_advance, UPDATES, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def until_cancelled(pieces: DataFrame, cancels: DataFrame) -> DataFrame:
    """The pieces that came before their document's stream was cancelled.

    ``cancels`` has ``doc_id, seq``: from that piece on nothing is read, so no final record
    comes out of what is left.  Of several the first holds; a null piece number cancels all.
    """
    stop = cancels.groupBy("doc_id").agg(F.min(F.coalesce("seq", F.lit(0))).alias("_stop"))
    return pieces.join(stop, "doc_id", "left").where("_stop is null or seq < _stop").drop("_stop")


def updates_of_batch(pieces: DataFrame) -> DataFrame:
    """The same rows from a finished table of pieces, by windows: the text up to each piece,
    its snapshot, and only the changes; the final record at the end piece."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    so_far = F.array_join(F.collect_list(F.coalesce("piece", F.lit(""))).over(order.rowsBetween(Window.unboundedPreceding, 0)), "")
    grown = pieces.withColumn("text", so_far).withColumn("snap", object_snapshot(F.col("text")))
    known = F.last("snap", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    partial = grown.withColumn("_known", known).where("snap is not null and (_known is null or snap <> _known)").select("doc_id", "seq", F.lit("partial").alias("kind"), F.col("snap").alias("payload"))
    from paperloom.operators.json_text import found_object

    final = grown.where("is_end").select("doc_id", "seq", F.lit("final").alias("kind"), found_object(F.col("text")).alias("payload"))
    return partial.unionByName(final)
