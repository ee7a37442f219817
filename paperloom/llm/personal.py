"""Personal information in free text, found by bootstrapped contextual extraction.

Candidate spans come from loose grammars (mail addresses, digit groups, document numbers,
postal addresses, runs of capitalised words).  Each candidate is an instance tied to lexical
patterns: the folded words before it, the words behind it, and its own mask.  Seeds (known
names and document numbers, shapes that speak for themselves) score the patterns they occur
in, patterns score their instances, and so on until the scores stand; instances reached by
high-confidence patterns are taken.  The scoring is Spark aggregation over the
pattern-instance graph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.scans import count_lexicon, fold
from paperloom.session import checkpointed

#: Scoring goes on until no score moves by more than SETTLED, at most for so many rounds.
ROUNDS, SETTLED = 12, 0.05
ACCEPT, LEAST_INSTANCES = 0.6, 3
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
# Titles before a name, and parts of street names by language.
TITLES = frozenset("mr mrs ms miss dr prof sir mme mlle m hr fr herr frau sr sra".split())
STREET_WORDS = r"Street|St\.|Lane|Ln\.|Road|Rd\.|Rd|Avenue|Ave\.|Drive|Dr\.|Way|Close|Court|Square|Terrace|Boulevard|Blvd\.|Place|Row"
STREET_ENDS = r"stra(?:ß|ss)e|str\.|weg|platz|allee|gasse|gatan|gata|vägen|väg"
STREET_STARTS = r"rue|avenue|boulevard|place|chemin|calle|avenida|plaza|via|viale|piazza"

_AT = r"(?:@|\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)+")
_PHONE = re.compile(r"(?<![\w+/.-])(?:\+ ?)?(?:\(\d{2,5}\) ?)?\d+(?:(?:[ ./-]| ?\(\d{1,5}\) ?|-)\d+)*(?![\w/-]|\.\w)")
_ID = re.compile(r"(?<![\w@./-])(?:[A-Z]{1,3} ?\d{2} \d{2} \d{2} [A-Z]|\d{3}-\d{2}-\d{4}|(?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{7,12})(?![\w@/]|-\w)")
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’-]*"
_TOWN = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?: [^\W\d_a-zß-öø-ÿ][^\W\d_]+)?(?![\d\w])"
_ADDRESS = re.compile(
    rf"(?<![\w/-])(?:(?:Flat|Apt\.?|Unit|Suite) \d+[a-z]?, )?"
    rf"(?:P\.? ?O\.? Box \d+|(?:{_CAP}(?:{STREET_ENDS})|(?:{_CAP} )(?:{STREET_ENDS})) \d+(?: ?[A-Za-z](?!\w))?"
    rf"|\d+ ?[A-Za-z]?,? (?:{STREET_STARTS}) (?:d[eu]s? (?:la )?|l')?{_CAP}|\d+ ?[A-Za-z]? (?:{_CAP} ){{1,2}}(?:{STREET_WORDS}))"
    rf"(?:, (?:Flat|Apt\.?|Unit|Suite) \d+[a-z]?)?, (?:\d{{4,6}} )?{_TOWN}(?: (?:\d{{4,6}}|[A-Z]{{1,2}}\d{{1,2}} \d[A-Z]{{2}}))?(?:, [A-Z]{{2}} \d{{4,6}})?(?!\w)"
)
_NAME_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")
_CONTEXT = re.compile(r"[^\W_]+|[^\w\s]")
REACH = 48


def lower_words(text: str) -> Iterator[str]:
    """Words written small, which are no parts of names."""
    for word in re.findall(r"(?<![\w@.+-])[^\W\d_]{2,}(?![\w@+]|\.\w)", _EMAIL.sub(" ", text)):
        if word.islower():
            yield word


def names_in(line: str, common) -> Iterator[tuple[int, int]]:
    """Spans that can be a person's name, from every word that can begin one."""
    tokens = [(m.start(), m.end(), m[0]) for m in _NAME_TOKEN.finditer(line)]

    def initial(word: str) -> bool:
        return len(word) == 2 and word[0].isupper() and word[1] == "."

    def part(word: str) -> bool:
        bare = word.rstrip(".")
        return len(bare) > 1 and bare[0].isupper() and word[-1] != "." and bare.lower() not in common and (bare[1:].islower() or bare.isupper() or "-" in bare or "'" in bare or "’" in bare)

    for i, (begin, _, word) in enumerate(tokens):
        if not word[0].isupper():
            continue
        if word.rstrip(".").lower() in TITLES and len(word.rstrip(".")) > 1:
            continue
        if not (part(word.rstrip(".")) or initial(word)):
            continue
        j, end, full = i, begin, 0
        while j < len(tokens) and j - i < 4 and (j == i or line[tokens[j - 1][1]:tokens[j][0]] == " "):
            token = tokens[j][2]
            if initial(token):
                end = tokens[j][1]
            elif part(token.rstrip(".")):
                full += 1
                end = tokens[j][0] + len(token.rstrip("."))
                if token.endswith("."):
                    j += 1
                    break
            else:
                break
            j += 1
        if j - i >= 2 and full >= 1 and not initial(tokens[j - 1][2]):
            yield begin, end
        elif j - i == 1 and full == 1 and j < len(tokens) and line[end:tokens[j][0]] == ", ":
            given_before = i > 0 and line[tokens[i - 1][1]:begin] == " " and (part(tokens[i - 1][2]) or initial(tokens[i - 1][2]))
            if given_before and not word.rstrip(".").isupper():
                continue
            # Family name first: "Name, Given Given".
            k, stop, given = j, end, 0
            while k < len(tokens) and k - j < 3 and (k == j or line[tokens[k - 1][1]:tokens[k][0]] == " "):
                token = tokens[k][2]
                if initial(token):
                    stop, given = tokens[k][1], given + 1
                elif part(token.rstrip(".")):
                    stop, given = tokens[k][0] + len(token.rstrip(".")), given + 1
                    if token.endswith("."):
                        k += 1
                        break
                else:
                    break
                k += 1
            if given:
                yield begin, stop


def candidates(text: str, common) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of all candidates; none crosses a line break."""
    base = 0
    for line in text.split("\n"):
        taken = []
        for m in _EMAIL.finditer(line):
            taken.append(m.span())
            yield "email", base + m.start(), base + m.end()
        free = lambda a, b: all(b <= x or a >= y for x, y in taken)
        for m in _ADDRESS.finditer(line):
            if free(*m.span()):
                taken.append(m.span())
                yield "address", base + m.start(), base + m.end()
        for m in _PHONE.finditer(line):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15 and free(*m.span()):
                yield "phone", base + m.start(), base + m.end()
        for m in _ID.finditer(line):
            if free(*m.span()):
                yield "id_number", base + m.start(), base + m.end()
        for a, b in names_in(line, common):
            if free(a, b):
                yield "person", base + a, base + b
        base += len(line) + 1


def mask_of(kind: str, surface: str) -> str:
    """The candidate's own shape."""
    if kind in ("email", "address", "person"):
        return kind
    if re.fullmatch(r"[A-Z0-9]+", surface) and not re.fullmatch(r"[A-Z]{0,2}\d+[A-Z]?", surface):
        return f"mix{len(surface)}"
    return re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", surface))


def contexts_of(kind: str, text: str, begin: int, end: int) -> list[str]:
    """The patterns of one candidate: words before, words behind, mask."""
    before = text[max(0, begin - REACH):begin]
    if begin > REACH:
        before = before.split(None, 1)[-1] if " " in before or "\n" in before else before
    left = [_folded(w) for w in _CONTEXT.findall(before)]
    if kind == "person":
        while left and left[-1] in (".", *_TITLE_FOLDS) and (left[-1] != "." or len(left) > 1 and left[-2] in _TITLE_FOLDS):
            left.pop()
    right = [_folded(w) for w in _CONTEXT.findall(text[end:end + REACH])[:2]]
    # A mask speaks only where it tells candidates of one kind apart.
    out = ["m:" + mask_of(kind, text[begin:end])] if kind in ("phone", "id_number") else []
    # Only contexts with a word in them say anything; marks and numbers stand everywhere.
    spoken = lambda words: any(len(w) > 1 for w in words)
    out += [f"l{n}:" + " ".join(left[-n:]) for n in (1, 2, 3) if len(left) >= n and spoken(left[-n:])]
    if len(right) == 2 and spoken(right):
        out.append("r2:" + " ".join(right))
    if left and right and spoken(left[-1:]) and spoken(right[:1]):
        out.append(f"b:{left[-1]}|{right[0]}")
    return out


def _folded(word: str) -> str:
    if word.isdigit():
        return "9"
    return (fold(word) or word) if word[0].isalnum() else word


_TITLE_FOLDS = {fold(t) for t in TITLES}
_SHAPE_PRIOR = {"email": 0.99, "address": 0.75}


def _folded_firsts(words: pd.Series) -> pd.Series:
    return words.map(lambda w: _folded(w.rstrip(".")) if w and w.rstrip(".") else "")


def _normal(kind: str, surface: str) -> str:
    return re.sub(r"[\s-]+", "", surface) if kind == "id_number" else " ".join(surface.lower().split())


def _scan(df: DataFrame, key: str, text: str, common: dict[str, int]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(frozenset(common))  # as large as the words written small
    names = ["id", "kind", "begin", "end", "surface", "instance", "first", "patterns", "prior"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                if value.is_valid:
                    whole = value.as_py()
                    for kind, begin, end in candidates(whole, known):
                        surface = whole[begin:end]
                        prior = _SHAPE_PRIOR.get(kind, 0.95 if kind == "phone" and (surface[0] == "+" or re.match(r"00[1-9]\d{8,}$", surface)) else 0.0)
                        rows.append((doc, kind, begin, end, surface, _normal(kind, surface), re.split(r"[\s,]", surface.lower(), maxsplit=1)[0], contexts_of(kind, whole, begin, end), prior))
                if rows:
                    columns = list(zip(*rows))
                    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    narrow = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return narrow.mapInArrow(run, "id bigint, kind string, begin int, end int, surface string, instance string, first string, patterns array<string>, prior double")


def find_personal(df: DataFrame, key: str, text: str, seed_names: DataFrame, seed_numbers: DataFrame) -> DataFrame:
    """Mentions of personal information: ``id, pii_kind, begin, end, surface, score``.

    ``seed_names`` and ``seed_numbers`` have one string column ``seed`` each: names of
    persons and document numbers that are known.  Null and empty texts have no mentions;
    null seeds are no seeds; without any seed only shapes and what they lead to are found.
    """
    common = count_lexicon(df, text, lower_words)
    found = checkpointed(_scan(df, key, text, common))
    edges = checkpointed(found.select("kind", "instance", F.explode("patterns").alias("pattern")).distinct())

    instances = found.groupBy("kind", "instance").agg(F.max("prior").alias("prior"))
    numbers = seed_numbers.select(F.regexp_replace("seed", r"[\s-]+", "").alias("instance"), F.lit("id_number").alias("kind"), F.lit(1.0).alias("known")).where("instance <> ''").distinct()
    tokens = seed_names.select(F.explode(F.split(F.lower("seed"), r"[\s,]+")).alias("token")).where("length(token) > 1").distinct()
    parts = instances.where("kind = 'person'").select("instance", F.explode(F.array_distinct(F.split("instance", r"[\s,]+"))).alias("token")).where("length(rtrim('.', token)) > 1")
    named = parts.join(tokens.withColumn("hit", F.lit(1)), "token", "left").groupBy("instance").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("share"))
    # A name made of known parts only is a seed; one with some is likely.
    people = named.select("instance", F.lit("person").alias("kind"), F.when(F.col("share") == 1, 0.95).when(F.col("share") >= 0.3, 0.7).otherwise(0.0).alias("known"))
    seeded = instances.join(numbers.unionByName(people), ["kind", "instance"], "left")
    state = checkpointed(seeded.select("kind", "instance", F.greatest("prior", F.coalesce("known", F.lit(0.0))).alias("seed")).withColumn("score", F.col("seed")))

    for _ in range(ROUNDS):
        scored = edges.join(state, ["kind", "instance"])
        # A pattern is worth the mean of its instances; a rare one is held back.  Of a mask
        # that seeds have, most instances are no seeds: it is trusted from a fifth on.
        mean = F.sum("score") / (F.count("*") + 0.5)
        patterns = scored.groupBy("kind", "pattern").agg(mean.alias("mean"), F.count("*").alias("n"))
        worth = F.when(F.col("pattern").startswith("m:") & F.col("kind").isin("id_number", "phone") & (F.col("mean") >= 0.15), F.pow("mean", F.lit(0.2))).otherwise(F.col("mean"))
        patterns = patterns.withColumn("worth", worth)
        strong = patterns.where((F.col("n") >= LEAST_INSTANCES) & (F.col("worth") >= F.when(F.col("kind") == "person", 0.7).otherwise(0.35)))
        lifted = edges.join(strong, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("worth").alias("lift"))
        raised = F.greatest("seed", F.coalesce(F.col("lift") * 0.98, F.lit(0.0)))
        state = checkpointed(state.join(lifted, ["kind", "instance"], "left").select("kind", "instance", "seed", raised.alias("score"), F.col("score").alias("was")))
        if state.where(F.abs(F.col("score") - F.col("was")) > SETTLED).isEmpty():
            break

    # A capitalised cue ("Applicant", "Name") is no part of the name behind it: it stands as
    # a strong word before names and is no known part of one.
    cues = strong.where("kind = 'person' and pattern like 'l1:%'").select(F.expr("substring(pattern, 4)").alias("_cue"))
    fold_first = F.pandas_udf(_folded_firsts, "string")
    cue_words = (
        found.where("kind = 'person'").select("first").distinct().join(tokens.withColumnRenamed("token", "first"), "first", "left_anti")
        .withColumn("_cue", fold_first("first")).join(cues, "_cue", "left_semi").select("first", F.lit("person").alias("kind"))
    )
    found = found.join(cue_words, ["first", "kind"], "left_anti")
    taken = found.join(state.where(F.col("score") >= ACCEPT).select("kind", "instance", "score"), ["kind", "instance"])
    # What lies inside a longer mention that was taken is a part of it.
    before = Window.partitionBy("id").orderBy("begin", F.col("end").desc(), F.col("score").desc(), "kind").rowsBetween(Window.unboundedPreceding, -1)
    outer = taken.withColumn("_reach", F.max("end").over(before)).where("_reach is null or `end` > _reach")
    return outer.select("id", F.col("kind").alias("pii_kind"), "begin", "end", "surface", "score")


def redact(df: DataFrame, key: str, text: str, mentions: DataFrame) -> DataFrame:
    """``key, redacted``: the text with a typed placeholder for each mention, all else as it
    was.  A null text stays null, a text without mentions stays as it is."""
    spans = mentions.groupBy(F.col("id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("begin", "end", "pii_kind"))).alias("_spans"))
    joined = df.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("_text")).join(spans, key, "left")

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, begins: pd.Series, ends: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for whole, *marks in zip(texts, begins, ends, kinds):
            if whole is None or marks[0] is None:
                out.append(whole)
                continue
            parts, at = [], 0
            for begin, end, kind in zip(*marks):
                if begin >= at:
                    parts += [whole[at:begin], PLACEHOLDERS[kind]]
                at = max(at, end)
            out.append("".join([*parts, whole[at:]]))
        return pd.Series(out, dtype="object")

    return joined.select(key, replaced("_text", "_spans.begin", "_spans.end", "_spans.pii_kind").alias("redacted"))
