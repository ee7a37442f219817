"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Each Python worker holds an in-process DuckDB with the merge table.  The distinct words
of a batch become rows (segment, position, token), a segment being a word at first; a
recursive query joins neighbouring positions with the merge table and contracts, in all
words at once, the pairs of least rank, left to right, until no pair is in the table.  The
tokens are read back in the order of their positions.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pattern that splits text before any merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker remembers; beyond it the memory is emptied, results stay the same.
MEMORY = 200_000
#: Symbols contracted in one recursive query.
SLAB_SYMBOLS = 400_000

# Merged tokens have higher ranks than what they are made of, so a word's pairs are merged by
# rising rank.  `potentials` has for two neighbouring tokens the least rank of any merge that can
# ever cross the border between them, however both grow; where there is none, the word falls into
# segments that go on by themselves.  In a round a segment contracts its pair of least rank, and
# every other pair that nothing can forestall: both neighbouring pairs rank higher, and no merge
# below its rank can cross the borders behind them.  This equals one leftmost pair of least rank
# at a time.  A segment without pairs is done and leaves the recursion.
CONTRACT = """
with recursive step(seg, p, t, done) as (
    select seg, p, t, false from symbols
    union all
    select seg, p, case when taken then made else t end, best = 2147483647
    from (
        select *, coalesce(lag(taken) over (partition by seg order by p), false) as eaten
        from (
            select *, hit and (i - min(i) over (partition by seg, island)) % 2 = 0 as taken
            from (
              select *, rank < 2147483647 and (rank = best or bool_and(free) over (partition by seg, island)) as hit
              from (
                select *, i - sum((rank < 2147483647 and rl = rank)::int) over (partition by seg order by p) as island,
                    (rl = rank or rl > rank and pl > rank) and (rr = rank or rr > rank and pr > rank) as free
                from (
                    select seg2 as seg, p, t, rank, made, row_number() over o as i, min(rank) over (partition by seg2) as best,
                        lag(rank, 1, 2147483647) over o as rl, lead(rank, 1, 2147483647) over o as rr, lag(pot, 1, 2147483647) over o as pl, lead(pot, 1, 2147483647) over o as pr
                    from (
                        select *, max(case when before = 2147483647 then p end) over (partition by seg order by p) as seg2
                        from (
                            select s.*, coalesce(m.rank, 2147483647) as rank, m.made, coalesce(x.pot, 2147483647) as pot, lag(coalesce(x.pot, 2147483647), 1, 2147483647) over (partition by seg order by p) as before
                            from (select seg, p, t, lead(t) over (partition by seg order by p) as u from step where not done) s
                            left join merges m on m.l = s.t and m.r = s.u
                            left join potentials x on x.l = s.t and x.r = s.u
                        )
                    )
                    window o as (partition by seg2 order by p)
                )
              )
            )
        )
    )
    where not eaten
)
select p, t from step where done order by p
"""


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """(id of each byte, merges as (left, right, rank, made)) of a vocabulary file."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    symbols = byte_symbols()
    merges = []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        merges.append((ids[left], ids[right], rank, ids[left + right]))
    return [ids[symbols[b]] for b in range(256)], merges


def potentials(merges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(left, right, least rank) of all pairs of tokens whose border some merge can cross.

    A merge crosses it if the left token ends its left part, being that part, the right half
    of it, and so on, and the right token begins its right part.
    """
    first = {made: left for left, _, _, made in merges}
    last = {made: right for _, right, _, made in merges}

    def chain(token: int, halves: dict[int, int]) -> list[int]:
        out = [token]
        while out[-1] in halves:
            out.append(halves[out[-1]])
        return out

    least: dict[tuple[int, int], int] = {}
    for left, right, rank, _ in merges:
        for a in chain(left, last):
            for b in chain(right, first):
                least[a, b] = min(rank, least.get((a, b), rank))
    return [(a, b, rank) for (a, b), rank in least.items()]


class Contractor:
    """One worker's DuckDB and its memory of words."""

    def __init__(self, byte_ids: list[int], merges: np.ndarray, crossing: np.ndarray):
        import duckdb

        self.byte_ids = np.array(byte_ids, np.int32)
        # It spills where Spark's own workers do.
        spill = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": os.path.join(spill, f"duckdb-{os.getpid()}")})
        for name, rows, columns in (("merges", merges, ("l", "r", "rank", "made")), ("potentials", crossing, ("l", "r", "pot"))):
            self.db.register("given", pa.table({c: pa.array(rows[:, k], pa.int32()) for k, c in enumerate(columns)}))
            self.db.execute(f"create table {name} as select * from given")
            self.db.unregister("given")
        self.known: dict[str, list[int]] = {}

    def learn(self, words: list[str]) -> None:
        begin = 0
        while begin < len(words):
            raws, size = [], 0
            while begin + len(raws) < len(words) and (size < SLAB_SYMBOLS or not raws):
                raws.append(words[begin + len(raws)].encode("utf-8", "surrogatepass"))
                size += len(raws[-1])
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
            owner = np.repeat(bounds[:-1], np.diff(bounds)).astype(np.int32)
            tokens = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
            self.db.register("symbols", pa.table({"seg": owner, "p": np.arange(size, dtype=np.int32), "t": tokens}))
            result = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("symbols")
            ids = result.column("t").to_numpy()
            cuts = np.searchsorted(result.column("p").to_numpy(), bounds)
            for k in range(len(raws)):
                self.known[words[begin + k]] = ids[cuts[k]:cuts[k + 1]].tolist()
            begin += len(raws)


def encode_column(df: DataFrame, text: str, target: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Add ``target`` (array<int>): the token ids of ``text`` without special tokens.

    A null and an empty text have the empty list.  A string that spells a special token is
    ordinary text.  Every row comes out once; a column already called ``target`` is
    replaced.
    """
    byte_ids, merge_list = read_vocabulary(vocabulary)
    # Both are fixed by the vocabulary: 50 000 and 109 000 rows.
    merges, crossing = np.array(merge_list, np.int32), np.array(potentials(merge_list), np.int32)
    kept = df.drop(target)
    schema = StructType([*kept.schema.fields, StructField(target, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        worker: Contractor | None = None
        for batch in batches:
            if worker is None:
                worker = Contractor(byte_ids, merges, crossing)
            rows = [split(t) if t else [] for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            if len(worker.known) > MEMORY:
                worker.known.clear()
            fresh = {w for row in rows for w in row if w not in worker.known}
            if fresh:
                worker.learn(sorted(fresh))
            known = worker.known
            flat: list[int] = []
            offsets = [0]
            for row in rows:
                for word in row:
                    flat.extend(known[word])
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, target])

    return kept.mapInArrow(run, schema)


def encode_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of every document."""
    return encode_column(df.select(F.col(key), F.col(text).alias("_text")), "_text", "ids", vocabulary).select(key, "ids")
