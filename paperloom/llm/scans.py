"""Text of scanned pages repaired into continuous paragraphs.

A lexicon is counted over the whole corpus.  Each document is de-lined: page numbers and
running lines are found and set aside, and the words of the remaining lines are decoded as
one stream by dynamic programming over a lattice whose edges are a word as it stands, a word
with confused characters put right, two fragments joined over a break mark or a blank, and a
run-together word split in two; each edge costs what the lexicon and the confusion say.
Paragraph boundaries are a second dynamic program over the gaps between lines.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a recogniser prints -> what stood there, by how sure the print shows it.
SURE = {"0": "oO", "1": "liI", "5": "sS", "9": "gq", "4": "A", "8": "B", "6": "b", "ſ": "fs", "|": "lI", "3": "e", "$": "s", "€": "e"}
PAIRED = {"ri": "n", "cl": "d", "rn": "m", "ii": "u", "vv": "w", "nn": "m", "tl": "d", "ni": "m", "in": "m", "lc": "k"}
PLAIN = {"c": "e", "l": "iIt", "f": "t", "o": "a", "b": "h", "h": ("li", "b"), "q": "g", "m": ("rn", "in"), "d": ("cl",), "e": "c", "i": "l", "I": "l", "n": ("ri", "u"), "u": "n", "t": "f", "a": "o", "y": "v", "v": "y", "g": "q", "w": ("vv",), "z": "s", "k": ("lc",), "H": "N", "S": "5", "O": "0", "B": "8"}
#: How many times commoner the right word must be than the print, by confusion.
MARGIN = {"sure": 2.0, "paired": 8.0, "plain": 15.0}
# Words of page numbers, marks of a broken word, letters read for digits.
PAGE_WORDS = ("page", "seite", "p", "pg", "s", "pag", "pág", "página", "sida", "blatt", "sheet", "folio", "no", "nr", "第", "页", "頁", "ページ")
OF_WORDS = ("of", "von", "de", "sur", "av", "/")
SOFT_BREAKS = "¬­"
HYPHEN_BREAKS = "-‐‑⁃"
DIGIT_FOR = str.maketrans("OoQDlI|iSsZzBgqA", "0000111155228994")
#: A word of this share of all words is common, and a rarer one may be split or merged.  A rate:
#: it drops no word, and more text of the same kind leaves it where it is.
COMMON_SHARE = 2e-6

_WORD = re.compile(r"[^\W_]+(?:['’|$€][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐‑][^\W\d_]+)+")
# Addresses of mail and web, and blobs of characters, hold no words.
_SKIP = re.compile(r"\S*(?:@|://|www\.|[(\[](?:at|dot)[)\]])\S*|\S+(?= ?[(\[]at[)\]])|[!-~]{30,}")
_SUSPECT = re.compile(r"@|://|www\.|[(\[](?:at|dot)[)\]]|[!-~]{30}")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_CASES = re.compile(r"(?:[^\W\d_]|[0-9|$€]){2,}")


def lexicon_words(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        broken = line.rstrip()[-1:] in SOFT_BREAKS + HYPHEN_BREAKS
        words = _WORD.findall(_mask(line))
        for n, word in enumerate(words):
            if not (broken and n == len(words) - 1) and not word.isdigit() and not _CJK.search(word):
                yield word.lower()
        for m in _COMPOUND.finditer(line):
            yield m[0].lower().replace("‐", "-").replace("‑", "-")


def count_lexicon(df: DataFrame, text: str, words=lexicon_words) -> dict[str, int]:
    """Word counts over all texts; ``words`` gives the words of a text.

    No word is left out, so the result is as large as the vocabulary.  Words of digits alone
    are no entries of lexicon_words().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column(0):
                if value.is_valid:
                    seen.update(words(value.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = df.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {row.word: row.n for row in counts.toLocalIterator()}


class Tree:
    """Lexicon words by their letters, for words with two confusions: only beginnings that
    some word has are followed up."""

    END = ""

    def __init__(self, words: Iterable[str]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[self.END] = {}

    def twice(self, word: str) -> Iterator[tuple[str, tuple[str, str]]]:
        """(word of the lexicon in the print's case, kinds) of what stood there, if two places
        of the print were misread."""
        open_ = [(0, self.root, "", ())]
        while open_:
            at, node, made, kinds = open_.pop()
            if at == len(word):
                if len(kinds) == 2 and self.END in node:
                    yield made, kinds
                continue
            child = node.get(word[at].lower())
            if child is not None:
                open_.append((at + 1, child, made + word[at], kinds))
            if len(kinds) < 2:
                for size, kind, table in _TABLES:
                    for true in table.get(word[at:at + size], ()):
                        child = node
                        for c in true.lower():
                            child = child.get(c)
                            if child is None:
                                break
                        else:
                            open_.append((at + size, child, made + true, (*kinds, kind)))


_TABLES = ((1, "sure", SURE), (1, "plain", PLAIN), (2, "paired", PAIRED))


class Decoder:
    """The word lattice and its costs; verdicts on word types are remembered."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.total = max(sum(lexicon.values()), 1)
        self.least = max(1, math.ceil(self.total * COMMON_SHARE))
        self.tree = Tree(word for word, n in lexicon.items() if n >= MARGIN["sure"] ** 2)
        self.known: dict[str, tuple[str, float] | None] = {}
        self.plain: set[str] = set()  # common words that stand as they are

    def cost(self, word: str) -> float:
        n = self.lexicon.get(word.lower(), 0)
        if n:
            return math.log(self.total / n)
        return math.log(self.total) + 1.5 + 0.7 * len(word)

    def _common(self, word: str) -> bool:
        return self.lexicon.get(word, 0) >= self.least

    def _variants(self, word: str) -> Iterator[tuple[str, str]]:
        for at in range(len(word)):
            for size in (1, 2):
                print_ = word[at:at + size]
                if len(print_) < size:
                    break
                kinds = (("sure", SURE), ("plain", PLAIN)) if size == 1 else (("paired", PAIRED),)
                for kind, table in kinds:
                    for true in table.get(print_, ()):
                        yield word[:at] + true + word[at + size:], kind

    def corrected(self, word: str) -> tuple[str, float] | None:
        """The word that stood there and its cost, if the print is more likely a misreading."""
        if word in self.known:
            return self.known[word]
        best = None
        if _CASES.fullmatch(word.replace("ſ", "f")) and not _CJK.search(word) and not word.isdigit():
            own = self.lexicon.get(word.lower(), 0)
            letters = [c for c in word if c.isalpha()]
            mixed = any(not c.isalpha() for c in word)
            if len(letters) >= 2 and (len(word) > 2 or word.islower()) and not (mixed and word.upper() == word and len(letters) < 4):
                for variant, kind in self._variants(word):
                    n = self.lexicon.get(variant.lower(), 0)
                    if n >= MARGIN[kind] * max(own, 1) and (best is None or n > best[2]):
                        best = (variant, math.log(self.total / n) + math.log(MARGIN[kind]) + 1.0, n)
                if best is None and len(word) >= 6:
                    for variant, kinds in self.tree.twice(word):
                        n, margin = self.lexicon[variant.lower()], MARGIN[kinds[0]] * MARGIN[kinds[1]]
                        if n >= margin * max(own, 1) and (best is None or n > best[2]):
                            best = (variant, math.log(self.total / n) + math.log(margin) + 2.0, n)
                if best is None and mixed and _digit_in_word(word):
                    best = (word, self.cost(word), 1)
        verdict = None if best is None else (best[0], best[1])
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[word] = verdict
        return verdict

    def joined(self, head: str, mark: str, tail: str) -> tuple[str, bool, float]:
        """(word, does the break mark go, cost) of two fragments over a break mark."""
        whole = head + tail
        if mark in SOFT_BREAKS:
            return whole, True, min(self.cost(whole), 12.0)
        if any(c.isdigit() for c in head[-1:] + tail[:1]) or not tail[:1].islower() or not head[-1:].isalpha():
            return f"{head}-{tail}", False, 8.0
        together = self.lexicon.get(whole.lower(), 0)
        apart = self.lexicon.get(f"{head}-{tail}".lower(), 0)
        if together or apart:
            return (whole, True, self.cost(whole)) if together >= apart else (f"{head}-{tail}", False, self.cost(f"{head}-{tail}"))
        mended = self.corrected(whole)
        if mended and mended[0] != whole:
            return mended[0], True, mended[1]
        # Neither is known: fragments that are words by themselves make a compound.
        words = [self.lexicon.get(x.lower(), 0) for x in (head, tail.split("-")[0])]
        if all(n * 20_000 > self.total for n in words) and len(tail) > 2:
            return f"{head}-{tail}", False, 10.0
        if "-" in tail and self.lexicon.get(tail.lower(), 0):
            return f"{head}-{tail}", False, 10.0
        return whole, True, 12.0

    def decode(self, words: list[str]) -> list[tuple[int, int, str, str]]:
        """Best path over a stream of words: (begin, end, text, what) per edge; what is
        'same', 'misread', 'merge' or 'split'."""
        if not self.all_plain(words):
            return self._decode(words)
        return [(i, i + 1, word, "same") for i, word in enumerate(words)]

    def all_plain(self, words: list[str]) -> bool:
        """No other edge leaves or joins common words that are no misreadings."""
        return self.plain.issuperset(words) or all(word in self.plain or self._plain(word) for word in words)

    def _plain(self, word: str) -> bool:
        if not self._common(word.lower()) or self.corrected(word):
            return False
        if len(self.plain) > 400_000:
            self.plain.clear()
        self.plain.add(word)
        return True

    def _decode(self, words: list[str]) -> list[tuple[int, int, str, str]]:
        n = len(words)
        best = [0.0] + [math.inf] * n
        back: list[tuple | None] = [None] * (n + 1)
        for i, word in enumerate(words):
            base = best[i]
            plain = self.cost(word)
            edges = [(i + 1, plain, word, "same")]
            mended = self.corrected(word)
            if mended:
                edges = [(i + 1, min(mended[1], plain), mended[0], "misread")]
            elif not self._common(word.lower()) and word.isalpha():
                for k in range(2, len(word) - 1):
                    a, b = word[:k].lower(), word[k:].lower()
                    if a in self.lexicon and b in self.lexicon and min(self.lexicon[a], self.lexicon[b]) * 5_000 > self.total:
                        edges.append((i + 1, self.cost(a) + self.cost(b) + 3.0, f"{word[:k]} {word[k:]}", "split"))
            if i + 1 < n and word.isalpha() and words[i + 1].isalpha() and words[i + 1].islower() and not (self._common(word.lower()) and self._common(words[i + 1])):
                whole = word + words[i + 1]
                if self.lexicon.get(whole.lower(), 0):
                    edges.append((i + 2, self.cost(whole) + 2.0, whole, "merge"))
            for to, cost, text, what in edges:
                if base + cost < best[to]:
                    best[to] = base + cost
                    back[to] = (i, text, what)
        path, at = [], n
        while at > 0:
            i, text, what = back[at]
            path.append((i, at, text, what))
            at = i
        return path[::-1]


def _digit_in_word(word: str) -> bool:
    """A digit where only a letter can stand: inside or at the edge of a cased word."""
    if sum(not c.isalpha() for c in word) > 1 + len(word) // 8:
        return False
    letters = "".join(c for c in word if c.isalpha())
    shaped = letters.islower() or letters.istitle() or len(letters) > 1 and letters[1:].islower()
    return len(letters) >= 4 and shaped and (not word[-1].isdigit() or word[-1] in "01593")


def number_of(token: str) -> int | None:
    """The number a token of digits, partly misread, stands for."""
    digits = token.translate(DIGIT_FOR)
    if not digits.isdigit() or len(digits) > 5 or not (any(c.isdigit() for c in token) or token in ("l", "I", "i", "S", "O")):
        return None
    return int(digits)


def fold(text: str) -> str:
    """A skeleton in which a line and its misreadings fall together."""
    s = unicodedata.normalize("NFKC", text).lower()
    for pair, one in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("ri", "n")):
        s = s.replace(pair, one)
    s = s.translate(str.maketrans("0159ſ|4q8", "olsgtlagb"))
    s = "".join(c for c in s if c.isalpha())
    return s.translate(str.maketrans("cioftb", "elatth"))


_DIGITS = r"[0-9OoQDlI|iSsZzBgqA]{1,5}"
_TAIL = rf"({_DIGITS})\s*(?:(/|[^\W\d_]{{1,3}})\s*({_DIGITS}))?\s*([页頁])?\W*$"
# A number first, then one behind a word; a misread digit must not be taken for the word.
_FURNITURE_NUMBERS = (re.compile(rf"^\W*(){_TAIL}"), re.compile(rf"^\W*([^\W\d_]{{1,6}})\W{{0,2}}\s*{_TAIL}"))


def page_number(line: str) -> tuple[str, int] | None:
    """(dress, number) if a line can be a page number and nothing else."""
    s = unicodedata.normalize("NFKC", line).strip()
    if not s:
        return None
    for shape in _FURNITURE_NUMBERS:
        m = shape.match(s)
        if not m:
            continue
        word, number, of, total, after = m.groups()
        value = number_of(number)
        if value is None or word and fold(word) not in _PAGE_FOLDS:
            continue
        if of and (fold(of) not in _OF_FOLDS and of != "/" or number_of(total) is None):
            continue
        break
    else:
        return None
    if s[-1] == "." and not word and not of:
        return None
    rest = s.replace(number, "", 1) if not of else ""
    if not word and not of and not after and re.sub(r"[\s\[\](){}<>|~=*_.·•—–−-]", "", rest):
        return None
    marks = "".join(sorted(set(re.sub(r"[\w\s]", "", s))))
    return (f"{'w' if word else ''}{'o' if of else ''}{marks}", value)


_PAGE_FOLDS = {fold(w) for w in PAGE_WORDS}
_OF_FOLDS = {fold(w) for w in OF_WORDS if w != "/"}


def _title_like(line: str) -> bool:
    if line.lstrip()[:1].islower():
        return False
    words = _LETTERS.findall(line)
    if not words or line[-1:] in ".,;:" and line[-2:-1].islower():
        return False
    small = sum(w[0].islower() for w in words)
    return small * 2 <= len(words)


def furniture(lines: list[str]) -> dict[int, str]:
    """Line numbers of 'running' lines and 'page_number' lines."""
    found: dict[int, str] = {}
    text = [k for k, line in enumerate(lines) if line.strip()]
    if not text:
        return found
    numbers = [(k, *p) for k in text if (p := page_number(lines[k]))]
    # The longest run of numbers that go up one by one, in one dress, is the numbering.
    best: list[int] = []
    for dress in {n[1] for n in numbers}:
        own = [(k, v) for k, d, v in numbers if d == dress]
        length: dict[int, tuple[int, int]] = {}
        back: dict[int, int] = {}
        for k, v in own:
            before = max((length[u] for u in (v - 1, v - 2) if u in length), default=None, key=lambda x: x[0])
            if before:
                back[k] = before[1]
            here = (before[0] + 1 if before else 1, k)
            if v not in length or here[0] >= length[v][0]:
                length[v] = here
        if not length:
            continue
        size, k = max(length.values())
        chain = [k]
        while k in back:
            k = back[k]
            chain.append(k)
        # A dress of its own is evidence; a bare number needs a row of them or the page's edge.
        edge = chain[0] in (text[0], text[-1])
        if size == 1 and not edge and dress in ("", "."):
            continue
        if (size, dress not in ("", ".")) > (len(best), False) or not best:
            best = chain if (len(chain), dress not in ("", ".")) >= (len(best), False) else best
    for k in best:
        found[k] = "page_number"
    dressed = {n[1] for n in numbers if n[0] in found}
    if dressed - {"", "."}:  # the same dress out of order is a misread number
        for k, d, _ in numbers:
            if d in dressed and k not in found and d not in ("", "."):
                found[k] = "page_number"
    groups: dict[str, list[int]] = {}
    for k in text:
        if k not in found and _title_like(lines[k]):
            key = fold(lines[k])
            if len(key) >= 7:
                groups.setdefault(key, []).append(k)
    merged: list[list[int]] = []
    near = _Near()
    for key in sorted(groups, key=lambda x: -len(groups[x])):
        other = near.first(key)
        if other is None:
            near.add(key)
            merged.append(list(groups[key]))
        else:
            merged[other].extend(groups[key])
    marks = set(found)
    order = {k: i for i, k in enumerate(text)}
    for held in merged:
        if len(held) < 2:
            continue
        if marks:  # beside a page number, or at the document's edges, but for a few
            beside = sum(any(text[j] in marks for j in range(max(0, order[k] - 3), min(len(text), order[k] + 4))) or order[k] < 3 or order[k] >= len(text) - 3 for k in held)
            if beside * 2 < len(held):
                continue
        for k in held:
            found[k] = "running"
    return found


class _Near:
    """Keys that differ by few edits, found by their equal parts.

    A key within e edits of one of e + 1 parts has one of them unchanged with exactly as many
    edits before it as parts: the edits before a part less the parts before it begin at nought,
    end below it and sink by one at most, at an unchanged part.
    """

    def __init__(self) -> None:
        self.keys: list[str] = []
        self.lengths: set[int] = set()
        self.parts: dict[tuple[int, int, int, str], list[int]] = {}
        self.bags = np.zeros((64, 64), np.int16)

    def add(self, key: str) -> None:
        for edits in {_edits(key, other) for other in range(len(key) - 3, len(key) + 4)}:
            for part, (begin, end) in enumerate(_cuts(len(key), edits)):
                self.parts.setdefault((len(key), edits, part, key[begin:end]), []).append(len(self.keys))
        if len(self.keys) == len(self.bags):
            self.bags = np.concatenate([self.bags, np.zeros_like(self.bags)])
        self.bags[len(self.keys)] = self._bag(key)
        self.lengths.add(len(key))
        self.keys.append(key)

    @staticmethod
    def _bag(key: str) -> np.ndarray:
        """How often each letter occurs (letters may share a place)."""
        return np.bincount(np.frombuffer(key.encode("utf-32-le"), np.uint32) % 64, minlength=64).astype(np.int16)

    def first(self, key: str) -> int | None:
        """The number of the first key added that is close to this one."""
        met: set[int] = set()
        for length in range(len(key) - 3, len(key) + 4):
            if length not in self.lengths:
                continue
            edits = _edits(key, length)
            for part, (begin, end) in enumerate(_cuts(length, edits)):
                # Before the unchanged part stand at most so many edits as parts.
                for at in range(max(0, begin - part), min(len(key) - (end - begin), begin + part) + 1):
                    found = self.parts.get((length, edits, part, key[at:at + end - begin]))
                    if found:
                        met.update(found)
        if not met:
            return None
        # An edit changes the counts of two letters at most.
        order = np.array(sorted(met))
        apart = np.abs(self.bags[order] - self._bag(key)).sum(axis=1)
        return next((n for n in order[apart <= 2 * _edits(key, len(key) + 3)].tolist() if _close(self.keys[n], key)), None)


def _edits(key: str, other: int) -> int:
    """Edits that two keys may differ by: one in eight characters of the longer."""
    return max(1, max(len(key), other) // 8)


def _cuts(length: int, edits: int) -> list[tuple[int, int]]:
    bounds = [length * k // (edits + 1) for k in range(edits + 2)]
    return list(zip(bounds, bounds[1:]))


def _close(a: str, b: str) -> bool:
    """At most one change in eight characters (banded edit distance)."""
    most = max(1, max(len(a), len(b)) // 8)
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


# Digits with a letter read for one of them; a capital and digits alone are a code.
_NUMBER_MISREAD = re.compile(r"(?!\d{7,}[A-Z])(?![A-HJ-NP-Z]\d+(?![\w.,]\w))(?<![\w@./-])(?=[\dOolISBZ.,]*\d)(?=\d*[.,]?\d*[OolISBZ])\d*[OolISBZ]?\d+[OolISBZ]?\d*(?:[.,][\dOolISBZ]+)?(?![\w@-])")


def repair(text: str, decoder: Decoder, joined: bool = True) -> tuple[list[str], list[tuple[int, str]]]:
    """(paragraphs, repairs as (line number, kind)) of one document; without ``joined`` the
    lines are repaired and no paragraphs made."""
    lines = text.split("\n")
    set_aside = furniture(lines)
    noise = set(set_aside.items())
    body = [k for k in range(len(lines)) if k not in set_aside]
    filled = [k for k in body if lines[k].strip()]
    following = dict(zip(filled, filled[1:]))
    made: dict[int, str] = {}
    head_cut: dict[int, int] = {}
    carried: dict[int, bool] = {}
    for k in filled:
        line = lines[k].rstrip()
        begin = head_cut.get(k, 0)
        mark = line[-1:]
        nxt = following.get(k)
        tail_join = None
        end = len(line)
        if mark in SOFT_BREAKS + HYPHEN_BREAKS and nxt is not None:
            head = re.search(r"[^\W_]+(?:[-‐‑][^\W_]+)*$", line[:-1])
            tail = re.match(r"\s*([^\W_]+(?:[-‐‑][^\W_]+)*)", lines[nxt])
            if head and tail and head.start() >= begin:
                first = re.split(r"[-‐‑]", tail[1])
                rest = tail[1] if len(first) > 1 else first[0]
                lead = re.split(r"[-‐‑]", head[0])[-1]
                whole, gone, _ = decoder.joined(lead, mark, rest if mark not in SOFT_BREAKS else first[0])
                if gone:
                    noise.add((k, "hyphen"))
                    whole = lead + first[0]
                    rest = first[0]
                else:
                    whole = f"{lead}-{rest}"
                mended = decoder.corrected(whole) if gone else None
                if mended and mended[0] != whole:
                    noise.add((_blame(lead, rest, mended[0], k, nxt), "misread"))
                    whole = mended[0]
                elif not gone:
                    for part, where in ((lead, k), (first[0], nxt)):
                        if decoder.corrected(part):
                            noise.add((where, "misread"))
                end = head.start() + len(head[0]) - len(lead)
                head_cut[nxt] = tail.start(1) + len(rest)
                tail_join = whole
        part = line[begin:end]
        masked = _mask(part)
        fixed_line = part
        spans = list(_WORD.finditer(masked))
        words = [m[0] for m in spans]
        if not decoder.all_plain(words):
            out, last = [], 0
            for i, j, fixed, what in decoder.decode(words):
                a, b = spans[i].start(), spans[j - 1].end()
                out.append(part[last:a])
                out.append(fixed if what != "same" else part[a:b])
                last = b
                if what == "misread":
                    noise.add((k, "misread"))
            out.append(part[last:])
            fixed_line = "".join(out)
        if _NUMBER_MISREAD.search(masked):
            noise.add((k, "misread"))
            fixed_line = _NUMBER_MISREAD.sub(lambda m: m[0].translate(DIGIT_FOR), fixed_line)
        made[k] = fixed_line + (tail_join or "")
        carried[k] = tail_join is not None
    return _paragraphs(lines, body, made, carried) if joined else [], sorted(noise)


def _mask(line: str) -> str:
    """The line with addresses of mail and web blanked out, offsets kept."""
    return _SKIP.sub(lambda m: " " * len(m[0]), line) if _SUSPECT.search(line) else line


def _blame(head: str, tail: str, fixed: str, k: int, nxt: int) -> int:
    """The line whose fragment holds the misread characters."""
    return nxt if fixed.lower().startswith(head.lower()) else k


def _paragraphs(lines: list[str], body: list[int], made: dict[int, str], carried: dict[int, bool]) -> list[str]:
    """Lines joined into paragraphs; breaks chosen by dynamic programming over the gaps."""
    filled = [k for k in body if k in made]
    if not filled:
        return []
    widths = sorted(len(lines[k].strip()) for k in filled)
    full = widths[int(len(widths) * 0.9)] if widths else 0

    def gap_costs(a: int, b: int) -> tuple[float, float]:
        """(cost of going on, cost of a break) between two text lines."""
        here, there = lines[a].strip(), lines[b].strip()
        if carried.get(a):
            return 0.0, 50.0
        blank = any(not lines[j].strip() for j in range(a + 1, b))
        ended = here[-1:] in ".!?…:。！？।\"”»)"
        short = len(here) < 0.75 * full
        fresh = there[:1].isupper() or not there[:1].isalpha()
        go, stop = 0.0, 0.0
        go += 3.0 * blank + 1.0 * short + 0.5 * ended
        stop += 2.0 * (not blank) + 2.5 * (not ended) + 2.5 * (not fresh)
        if _title_like(here) and len(here) < 0.8 * full:
            stop -= 3.0
        return go, stop

    # State: number of lines in the open paragraph (1 or more); a lone line costs a little.
    best, back = {1: 0.0}, []
    for a, b in zip(filled, filled[1:]):
        go, stop = gap_costs(a, b)
        new, trace = {}, {}
        for state, cost in best.items():
            if cost + go < new.get(2, math.inf):
                new[2], trace[2] = cost + go, state
            alone = 0.3 if state == 1 else 0.0
            if cost + stop + alone < new.get(1, math.inf):
                new[1], trace[1] = cost + stop + alone, state
        back.append(trace)
        best = new
    state = min(best, key=best.get)
    breaks = []
    for trace in reversed(back):
        breaks.append(state == 1)
        state = trace[state]
    breaks.reverse()
    out, current = [], made[filled[0]].strip()
    for (a, b), broken in zip(zip(filled, filled[1:]), breaks):
        if broken:
            out.append(current)
            current = made[b].strip()
        else:
            glue = "" if carried.get(a) or current and made[b].strip() and _CJK.match(current[-1]) and _CJK.match(made[b].strip()[0]) else " "
            # Behind a carried word its line goes on as it stands, blank or mark first.
            current += made[b].rstrip() if carried.get(a) else glue + made[b].strip()
    out.append(current)
    return [re.sub(r"[^\S\n]+", " ", p) for p in out if p]


_DECODERS: dict = {}


def _run(df: DataFrame, key: str, text: str, lexicon: dict[str, int], schema: str, rows, joined: bool):
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # as large as the distinct words counted
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker keeps its decoder, and the verdicts it came to, for the tasks that follow.
        if _DECODERS.get("of") != name:
            _DECODERS.update(of=name, decoder=Decoder(shared.value))
        decoder = _DECODERS["decoder"]
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                if value.is_valid and value.as_py():
                    made = rows(doc, *repair(value.as_py(), decoder, joined))
                    if made is not None:
                        yield made

    return df.select(F.col(key).cast("bigint").alias(key), text).where(F.col(key).isNotNull()).mapInArrow(run, schema)


def repairs(df: DataFrame, key: str, text: str, lexicon: dict[str, int]) -> DataFrame:
    """``key, line_no, noise`` for every repaired place: 'running', 'page_number', 'hyphen'
    or 'misread'; each once per line.  Lines are counted from 0, empty ones included; null
    and empty texts have no rows."""

    def rows(doc: int, _: list[str], noise: list[tuple[int, str]]):
        if noise:
            return pa.RecordBatch.from_arrays([pa.array([doc] * len(noise), pa.int64()), pa.array([n[0] for n in noise], pa.int32()), pa.array([n[1] for n in noise])], names=[key, "line_no", "noise"])

    return _run(df, key, text, lexicon, f"`{key}` bigint, line_no int, noise string", rows, False)


def repaired(df: DataFrame, key: str, text: str, lexicon: dict[str, int]) -> DataFrame:
    """``key, para_no, paragraph``: the continuous paragraphs of each text, in order."""

    def rows(doc: int, paras: list[str], _: list[tuple[int, str]]):
        if paras:
            return pa.RecordBatch.from_arrays([pa.array([doc] * len(paras), pa.int64()), pa.array(range(len(paras)), pa.int32()), pa.array(paras)], names=[key, "para_no", "paragraph"])

    return _run(df, key, text, lexicon, f"`{key}` bigint, para_no int, paragraph string", rows, True)
