"""Sentence units in any script by a linear chain over boundary candidates.

Every character is tagged as boundary or inside; only ends of terminal runs (and, in
scripts written without punctuation, blanks) can be boundaries at all.  Emissions come from
counts over the whole corpus that need no labels: an empty line is a certain boundary, so
what stands before and behind empty lines shows how sentences end and begin, and what is
followed by a small letter shows where none ends.  Transitions are counted from candidates
that stand side by side and whose tags are certain, by the length of text between them.
What a blank says where no marks are written is learned from text of scripts without blanks
between words that has marks: they are stripped off, and the blanks they leave are set
against the blanks that stood there.  Whether a script is punctuated is seen from its
paragraph ends.

Viterbi decodes the chain.  Its state is the last tag and what the open quotation allows: one
that opened in mid-sentence holds no boundary, and one that holds a boundary must end with
one, so that a quotation is split or run through as a whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that stand before a name or number and end no sentence.
TITLES = frozenset(
    "mr mrs ms dr prof st mt no nos sec fig art p pp vol ch ca approx incl excl cf vs e.g i.e "
    "hr fr nr abschn bzw ggf inkl z d m mme mlle mm env sr sra dra pág págs aprox núm см стр рис г-н т"
    " डॉ श्री د".split()
)
# Abbreviations that end a sentence where a new one follows.
MAY_END = frozenset("a.m p.m etc usw inc ltd co corp bros jr u.s u.k lbs г руб тыс evtl u.s.w mon tues wed thurs fri sat sun".split())
# Of the first ones, those that only a number follows.
NUMBERED = frozenset("no nos sec fig art p pp vol ch nr abschn pág págs núm стр".split())
# Sentence terminals, closing marks, opening marks.
TERMINALS = ".!?…。！？।॥؟۔．｡။។៕"
HARD = "。！？।॥؟۔｡။។៕"
CLOSERS = "\"'”’»)]」』）】›"
OPENERS = "\"'“‘«([「『（【‹„¿¡"
PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "‘": "’", "‹": "›"}
#: What is counted of a key: ends (or boundaries), others, and small letters behind a stop (or
#: insides), paragraph starts, places behind a stop and in the middle; N is a script's end
#: without a stop.
TAGS = "EOLSAMN"
#: Weight of the overall share in a transition, and the most that one can say: less than half of
#: the weakest emission that is sure, since the tags transitions are counted from are not drawn
#: at random.
SMOOTH, MOST = 20.0, 0.45
#: What one broken rule of quotations costs, and what its further boundaries weigh.
RULE, INNER = 20.0, 1e-6

_CANDIDATE = regex.compile(r"[.!?…。！？।॥؟۔．｡။។៕]+(?:[   ]?[»›]|[\"'”’)\]」』）】]|(?<=[.!?…])“)*")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.'’-]*")
_WORDS = regex.compile(r"\p{Lu}[\p{L}\p{M}]+")
_GAP = re.compile(r"\n[^\S\n]*\n\s*")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
# Blocks of the scripts that part no words.
_SCRIPTS = (("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF), ("Myanmar", 0x1000, 0x109F), ("Khmer", 0x1780, 0x17FF))
#: Paragraph ends with a stop that a script with stops of its own is taken to have shown.
_OWN_STOPS = {"Myanmar": 4, "Khmer": 4}
_SPACELESS = "".join(f"{chr(a)}-{chr(b)}" for _, a, b in _SCRIPTS)
# Between two characters of scripts that have no blanks between words but have marks: marks that
# are stripped off (group 1), or a blank of its own.
_STRIPPED = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}])(?:([。！？]+)\s*|[^\S\n]+)(?=[\p{Han}\p{Hiragana}\p{Katakana}])")
_BLANKS = re.compile(rf"(?<=[{_SPACELESS}])\s+|\s+(?=[{_SPACELESS}])")


def _spaceless(char: str) -> str:
    """The script of a character that parts no words by blanks, or ''."""
    if char < "\u0e00":
        return ""
    code = ord(char)
    return next((name for name, low, high in _SCRIPTS if low <= code <= high), "")


def _left_key(text: str, end: int) -> str:
    """The token before a terminal, digits as 9, case folded; '' if there is none."""
    begin = end
    while begin > 0 and end - begin < 40 and not text[begin - 1].isspace() and text[begin - 1] not in "\"“«([{（「":
        if _UNSPACED.match(text[begin - 1]) and end - begin >= 2:
            break
        begin -= 1
    return re.sub(r"\d+", "9", text[begin:end].lower())


def _right_key(text: str, at: int, stop: int) -> str:
    """The token behind a candidate with its case; of unspaced scripts two characters."""
    while at < stop and (text[at].isspace() or text[at] in OPENERS or text[at] in "-–—*"):
        at += 1
    if at < stop and _UNSPACED.match(text[at]):
        return text[at:at + 2]
    found = _TOKEN.match(text, at, min(stop, at + 40))
    return re.sub(r"\d+", "9", found[0].rstrip(".'’-")) if found else text[at:at + 1]


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(begin, end) of what stands between empty lines, trimmed."""
    spans, begin = [], 0
    for gap in [*_GAP.finditer(text), None]:
        end = gap.start() if gap else len(text)
        while begin < end and text[begin].isspace():
            begin += 1
        while end > begin and text[end - 1].isspace():
            end -= 1
        if end > begin:
            spans.append((begin, end))
        begin = gap.end() if gap else len(text)
    return spans


def candidates(text: str, begin: int, end: int) -> list[tuple[int, int, bool]]:
    """(terminal begin, boundary offset, is a blank of an unpunctuated script)."""
    found = []
    for m in _CANDIDATE.finditer(text, begin, end):
        stop = m.end()
        last = text[stop - 1]
        if stop < end and not text[stop].isspace():
            hard = any(c in HARD or c == "…" for c in m[0]) or last in "」』”）"
            if not hard and not _UNSPACED.match(text[stop]):
                continue
            if not hard and all(c == "." for c in m[0]):
                continue
        found.append((m.start(), stop, False))
    found += [(m.start(), m.start(), True) for m in _BLANKS.finditer(text, begin, end)]
    return sorted(set(found), key=lambda x: x[1])


def _bucket(gap: int) -> int:
    """Lengths of text between two candidates, by doubling."""
    return min(gap.bit_length(), 8)


def _step(run: str, gap: int) -> str:
    """What a transition goes by: the kind of mark it leads to, and the length in between."""
    mark = "h" if run[0] in HARD else "b" if run[0] in "!?" else "e" if run[0] == "…" or run[:2] == ".." else "d"
    return f"{mark}{_bucket(gap)}"


def _certain(text: str, mark: tuple[int, int, bool], end: int, key: str, nxt: str) -> str:
    """The tag of a candidate that needs no model: 'E' boundary, 'L' inside, '' not known."""
    start, stop, _ = mark
    if stop == end:
        return "E"
    if nxt[:1].islower() and nxt == nxt.lower():
        return "L"
    run = text[start:stop]
    if run[-1] in "!?" or run[-1] in HARD:
        return "E"
    return "E" if run == "." and len(key) >= 5 and key.isalpha() and nxt[:1].isupper() else ""


def observe(text: str, into: Counter) -> None:
    """Count what one text shows about ends, beginnings and middles."""
    for begin, end in paragraphs(text):
        marks = candidates(text, begin, end)
        ends = {stop for _, stop, blank in marks if not blank}
        script = _spaceless(text[end - 1])
        if script:
            into["script", script, "E" if text[end - 1] in TERMINALS else "N"] += 1
        into["right", _right_key(text, begin, end), "S"] += 1
        for m in _STRIPPED.finditer(text, begin, end):
            into["blank", "", "E" if m[1] else "L"] += 1
        before, at = "E", begin
        for start, stop, blank in marks:
            if blank:
                continue
            key = _left_key(text, start)
            tag = _certain(text, (start, stop, blank), end, key, "" if stop == end else _right_key(text, stop, end))
            if before and tag:
                into["pair", before + _step(text[start:stop], stop - at), tag] += 1
            before, at = tag, stop
            if stop == end:
                into["left", key, "E"] += 1
                into["left", "", "E"] += 1
                continue
            nxt = _right_key(text, stop, end)
            into["left", key, "L" if nxt[:1].islower() and nxt == nxt.lower() else "O"] += 1
            into["left", "", "O"] += 1
            into["right", nxt, "A"] += 1
        for word in _WORDS.finditer(text, begin + 1, end):
            at = word.start() - 1
            while at > begin and text[at].isspace():
                at -= 1
            if at + 1 not in ends and at >= begin and text[at] not in ":" + OPENERS:
                into["right", word[0], "M"] += 1


class Model:
    """Emission scores from the corpus counts."""

    def __init__(self, counts: dict[tuple[str, str], dict[str, int]]):
        self.counts = counts
        whole = counts.get(("left", ""), {})
        ended, going = whole.get("E", 0), whole.get("O", 0)
        self.rate = min(max((ended + 2) / (ended + going + 10), 0.05), 0.6)
        self.stay = math.log(1 - self.rate)
        script = lambda name, tag: counts.get(("script", name), {}).get(tag, 0)
        self.unpunctuated = {name for name, _, _ in _SCRIPTS if (script(name, "E") + _OWN_STOPS.get(name, 0)) * 4 <= script(name, "N") + 1}
        blank = counts.get(("blank", ""), {})
        self.blank = math.log((blank.get("E", 0) + 3) / (blank.get("L", 0) + 1))
        self.turns = self._turns()

    def _turns(self) -> dict[tuple[int, int, str], float]:
        """(last tag, tag, step) -> by how much likelier the tag is there than at all marks of
        the kind."""
        pairs = {key: c for (kind, key), c in self.counts.items() if kind == "pair"}
        overall: dict[tuple[str, str], int] = {}
        for key, c in pairs.items():
            for tag in "EL":
                overall[key[1], tag] = overall.get((key[1], tag), 1) + c.get(tag, 0)
        made = {}
        for key, c in pairs.items():
            many = c.get("E", 0) + c.get("L", 0)
            for tag in "EL":
                share = overall[key[1], tag] / (overall[key[1], "E"] + overall[key[1], "L"])
                score = math.log((c.get(tag, 0) + SMOOTH * share) / (many + SMOOTH) / share)
                made[int(key[0] == "E"), int(tag == "E"), key[1:]] = max(-MOST, min(MOST, score))
        return made

    def abbreviation(self, key: str) -> bool:
        """Would an ordinary last word so seldom stand before an empty line?"""
        c = self.counts.get(("left", key))
        if not c:
            return False
        ended, going = c.get("E", 0), c.get("O", 0) + c.get("L", 0)
        return ended * math.log(self.rate / 0.004) + going * (self.stay - math.log(0.996)) < -5

    def starter(self, key: str) -> float:
        """Log-odds that a token opens a sentence, by how often it opens a paragraph; nought
        where they are too weak to decide, so that such tokens need not be held."""
        c = self.counts.get(("right", key), {})
        opened, after = c.get("S", 0), c.get("A", 0)
        score = max(min(opened * math.log(self.rate / 0.004) + after * self.stay, 6.0), -24.0)
        cased = key[:1].lower() != key[:1].upper()
        return score if score >= 1 or cased and score <= -1 else 0.0

    def named(self, key: str) -> bool:
        c = self.counts.get(("right", key), {})
        return c.get("M", 0) > c.get("S", 0) and c.get("M", 0) * 5 > c.get("A", 0)

    def tells(self, kind: str, key: str) -> bool:
        """Whether emission() ever differs between this key and one never seen."""
        if kind == "left":
            return key == "" or self.abbreviation(key)
        if kind == "right":
            return self.named(key) or self.starter(key) != 0
        return True

    def emission(self, text: str, begin: int, end: int, mark: tuple[int, int, bool]) -> float:
        """Log-odds of a boundary at one candidate, apart from its neighbours."""
        start, stop, blank = mark
        if blank:
            return self.blank if {_spaceless(text[stop - 1]), _spaceless(text[_skip(text, stop, end)])} & self.unpunctuated else -8.0
        if stop == end:
            return 100.0
        run = text[start:stop]
        bare = run.rstrip(CLOSERS + "“   ")
        nxt = _right_key(text, stop, end)
        first = nxt[:1]
        cased = first.lower() != first.upper()
        if cased and first.islower() and nxt == nxt.lower() and text[_skip(text, stop, end)] not in "¿¡":
            return -20.0
        ellipsis = "…" in bare or ".." in bare
        closed = stop - start > len(bare)
        key = _left_key(text, start)
        score = 3.0
        if bare == ".":
            plain = key.strip("\"'(")
            letters = [c for c in plain if c.isalpha()]
            if len(letters) == 1 and len(plain) == 1:
                score = -8.0 if cased or plain not in MAY_END else -1.0
            elif plain in MAY_END:
                score = 2.0 if cased and not self.named(nxt) else -4.0
                if nxt.isupper() and 1 < len(nxt) <= 4 and self.starter(nxt) < 2:
                    score = -4.0
            elif plain in NUMBERED and cased and len(plain) > 1 and not self.abbreviation(key):
                score = 3.0
            elif plain in TITLES or self.abbreviation(key):
                score = -8.0
            elif plain and all(c.isdigit() for c in plain):
                score = 1.0 + (min(self.starter(nxt), 2.0) if cased else 0.0)
        if not cased and not first.isdigit() and (ellipsis or closed):
            score = -1.0 + self.starter(nxt)
        elif not cased and first.isdigit() and (ellipsis or closed):
            score = 1.0
        elif text[stop:stop + 1] and text[_skip(text, stop, end)] in ",;:、，；،—–-)":
            score = -20.0
        return score


def _skip(text: str, at: int, end: int) -> int:
    while at < end - 1 and text[at].isspace():
        at += 1
    return min(at, end - 1)


def quotations(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """(opening, closing) offsets of quotations and brackets that close in the paragraph."""
    spans, stack = [], []
    for at in range(begin, end):
        c = text[at]
        if stack and c in stack[-1][1]:
            before = text[at - 1]
            if c not in "\"'" or not before.isspace():
                if c != "'" or at + 1 >= end or not text[at + 1].isalnum():
                    spans.append((stack.pop()[0], at))
                    continue
        if c in PAIRS:
            stack.append((at, PAIRS[c]))
        elif c in "\"'" and (at == begin or text[at - 1].isspace() or text[at - 1] in OPENERS) and at + 1 < end and not text[at + 1].isspace():
            if c not in [s[1] for s in stack]:
                stack.append((at, c))
    outer = []
    for s in sorted(spans):
        if not outer or s[1] > outer[-1][1]:
            outer.append(s)
    return outer


#: What an open quotation allows: none is open, it may be split, it may not, it has been.
OUT, FRESH, BOUND, SPLIT = range(4)


def boundaries(text: str, model: Model) -> list[int]:
    """Offsets just behind each sentence of a text."""
    ends: list[int] = []
    for begin, end in paragraphs(text):
        marks = candidates(text, begin, end)
        spans = quotations(text, begin, end)
        here = _decode(text, begin, end, marks, spans, model)
        if not here or here[-1] != end:
            here.append(end)
        ends.extend(here)
    return ends


def _decode(text: str, begin: int, end: int, marks: list[tuple[int, int, bool]], spans: list[tuple[int, int]], model: Model) -> list[int]:
    """The best tags of a paragraph's candidates, as the offsets tagged as boundaries.

    A state is (last tag, what the open quotation allows); its value the score and the
    boundaries so far, linked backwards.
    """
    opens = [s[0] for s in spans]
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(1, OUT): (0.0, None)}
    at, open_now = begin, -1

    def keep(into: dict, state: tuple[int, int], score: float, path: tuple | None) -> None:
        if state not in into or score > into[state][0]:
            into[state] = (score, path)

    for mark in marks:
        start, stop, blank = mark
        ix = bisect_left(opens, start) - 1
        inside = ix if ix >= 0 and spans[ix][0] < start <= spans[ix][1] else -1
        closes = inside >= 0 and stop > spans[inside][1]
        if inside != open_now:
            moved: dict = {}
            for (tag, mode), (score, path) in best.items():
                if mode == SPLIT:  # the quotation was split and went on behind its end
                    score -= RULE
                mode = OUT
                if inside >= 0:
                    before = spans[inside][0]
                    while before > begin and text[before - 1].isspace():
                        before -= 1
                    mode = FRESH if before == begin or before == at and tag else BOUND
                keep(moved, (tag, mode), score, path)
            best, open_now = moved, inside
        score = model.emission(text, begin, end, mark)
        if stop == at and open_now < 0:
            score = -100.0
        step = "" if blank else _step(text[start:stop], stop - at)
        after: dict = {}
        for (tag, mode), (value, path) in best.items():
            on, off = (0.0, 0.0) if blank else (model.turns.get((tag, 1, step), 0.0), model.turns.get((tag, 0, step), 0.0))
            if closes:
                keep(after, (0, OUT), value + off - (RULE if mode == SPLIT else 0.0), path)
                keep(after, (1, OUT), value + on + score, (stop, path))
            else:
                # A quotation is split or not; how many sentences it holds must not outvote its end.
                weight = INNER if mode == SPLIT else 1.0
                keep(after, (0, mode), value + weight * off, path)
                keep(after, (1, SPLIT if mode in (FRESH, SPLIT) else mode), value + weight * (on + score) - (RULE if mode == BOUND else 0.0), (stop, path))
        best, at = after, stop
        if closes:
            open_now = -1
    path = max(best.items(), key=lambda item: item[1][0] - (RULE if item[0][1] == SPLIT else 0.0))[1][1]
    here = []
    while path:
        here.append(path[0])
        path = path[1]
    return here[::-1]


def train(df: DataFrame, text: str = "text") -> Model:
    """A model of the whole corpus: counts per key, summed and judged by Spark.

    No count is cut.  Each key is judged by all of its counts; what comes to the driver are
    the keys judged otherwise than one never seen, with all their counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0):
                if value.is_valid:
                    observe(value.as_py(), seen)
            if seen:
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys]) for i in range(3)] + [pa.array([seen[k] for k in keys], pa.int64())], names=["kind", "key", "what", "n"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = _by_key(batch.to_pylist())
            model = Model(whole | of)
            yield batch.filter(pa.array([model.tells(*key) for key in of], pa.bool_()))

    seen = df.select(text).mapInArrow(run, "kind string, key string, what string, n bigint")
    counts = seen.groupBy("kind", "key").agg(*[F.sum(F.when(F.col("what") == tag, F.col("n"))).alias(tag) for tag in TAGS]).persist()
    try:
        whole = _by_key(r.asDict() for r in counts.where("kind = 'left' and key = ''").collect())
        return Model(_by_key(r.asDict() for r in counts.mapInArrow(judge, counts.schema).toLocalIterator()))
    finally:
        counts.unpersist()


def _by_key(rows: Iterable[dict]) -> dict[tuple[str, str], dict[str, int]]:
    return {(row["kind"], row["key"]): {tag: row[tag] for tag in TAGS if row[tag]} for row in rows}


def sentence_units(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, sent_no, sent_begin, sent_end, sentence`` of every document.

    Offsets count code points; sent_end stands just behind the sentence, closing marks
    included.  Null, empty and blank texts have no rows.  Repeated rows give repeated rows.
    """
    kind = dict(df.dtypes)[key]
    shared = df.sparkSession.sparkContext.broadcast(model)  # the keys that tell, see train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not value.is_valid:
                    continue
                whole = value.as_py()
                begin = 0
                for n, end in enumerate(boundaries(whole, model)):
                    while begin < end and whole[begin].isspace():
                        begin += 1
                    for column, x in zip(out, (doc, n, begin, end, whole[begin:end])):
                        column.append(x)
                    begin = end
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field(0).type), *[pa.array(x, pa.int32()) for x in out[1:4]], pa.array(out[4], pa.string())],
                names=[key, "sent_no", "sent_begin", "sent_end", "sentence"],
            )

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, sent_no int, sent_begin int, sent_end int, sentence string")
