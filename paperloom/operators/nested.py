"""Deeply nested JSON records turned into flat, linked tables.

No parser walks the text.  All payloads of a batch lie in one byte array; bitmaps of
quotes, brackets, colons and commas are made for all of them at once, the inside of
strings is a prefix sum over unescaped quotes, the nesting depth a prefix sum over
brackets, and openers meet their closers by a stable sort on (record, depth).  The
grammar is checked on the resulting token table by looking at each token's neighbour and
its container.  The wanted members of all objects are found by comparing key bytes, and
the walk from the records down to the elements goes level by level for all of them at
once; the elements leave as rows with the link to their parent.

A record may stand in prose.  Each brace that a key or a closing brace follows can begin
it; the index restarts there, so that stray quotes and braces ahead of it count for
nothing.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The nested arrays of an extraction record.
NODES = ("value.lineItems", "value.items", "signals.fields", "signals.mergeConflicts", "signals.mergeConflicts.values", "tables", "tables.cells")
SLAB_BYTES = 8 << 20
#: Bytes looked at first where a record is sought behind one that was none; grows on demand.
WINDOW = 1 << 8
#: Scalars of up to so many bytes are made distinct together.
SCALAR_BYTES = 24

OPEN_O, OPEN_A, CLOSE_O, CLOSE_A, COLON, COMMA, STRING, SCALAR = range(1, 9)
_KIND = np.zeros(256, np.uint8)
for _char, _code in zip(b"{[}]:,", (OPEN_O, OPEN_A, CLOSE_O, CLOSE_A, COLON, COMMA)):
    _KIND[_char] = _code
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True
_ESCAPED, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True
_OPENER = re.compile(rb'\{(?=[ \t\r\n]*["}])')

NONE, WHOLE, CUT_OFF, BROKEN = range(4)


class Reading(NamedTuple):
    """Of each text: its state, the first and last token of its record and, where the grammar
    breaks, the token at which it does; of each token its container and partner (or -1)."""

    state: np.ndarray
    first: np.ndarray
    last: np.ndarray
    error: np.ndarray
    container: np.ndarray
    partner: np.ndarray


class Index:
    """The token table of many texts in one byte array."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        # One blank behind each text keeps a token from running into the next text.
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.ends = self.starts + lengths
        self._tokens()

    def _tokens(self) -> None:
        data, size = self.data, len(self.data)
        back = data == 0x5C
        # A quote is escaped behind an odd run of backslashes.
        where = np.arange(size)
        not_back = np.maximum.accumulate(np.where(back, -1, where))
        run = np.zeros(size, np.int64)
        run[1:] = where[1:] - 1 - not_back[:-1]
        quote = np.flatnonzero((data == 0x22) & (run % 2 == 0))
        text_of = np.searchsorted(self.starts, quote, "right") - 1
        first = np.searchsorted(quote, self.starts)
        parity = (np.arange(len(quote)) - first[text_of]) % 2
        step = np.zeros(size + 1, np.int32)
        step[quote[parity == 0]] += 1
        np.add.at(step, quote[parity == 1], -1)
        # An open string ends with its text.
        counts = np.diff(np.append(first, len(quote)))
        np.add.at(step, self.ends[counts % 2 == 1], -1)
        inside = np.cumsum(step[:-1]) > 0
        opening, closing = quote[parity == 0], quote[parity == 1]
        kind = np.where(inside, 0, _KIND[data]).astype(np.uint8)
        kind[closing] = 0
        loose = ~inside & (kind == 0) & ~_BLANK[data]
        loose[closing] = False
        scalar_from = np.flatnonzero(loose & ~np.concatenate([[False], loose[:-1]]))
        scalar_to = np.flatnonzero(loose & ~np.concatenate([loose[1:], [False]])) + 1
        marks = np.flatnonzero(kind)
        # Strings left open get the end of their text, and no valid grammar.
        open_of = np.searchsorted(self.starts, opening, "right") - 1
        nxt = np.searchsorted(closing, opening)
        close_at = np.where(nxt < len(closing), closing[np.minimum(nxt, max(len(closing) - 1, 0))] if len(closing) else 0, size)
        string_to = np.minimum(close_at + 1, self.ends[open_of] if len(open_of) else close_at)
        begin = np.concatenate([marks, opening, scalar_from])
        end = np.concatenate([marks + 1, string_to, scalar_to])
        what = np.concatenate([kind[marks], np.full(len(opening), STRING, np.uint8), np.full(len(scalar_from), SCALAR, np.uint8)])
        order = np.argsort(begin, kind="stable")
        self.begin, self.end, self.kind = begin[order], end[order], what[order]
        self.text = np.searchsorted(self.starts, self.begin, "right") - 1
        left_open = np.concatenate([np.zeros(len(marks), bool), close_at >= self.ends[open_of] if len(open_of) else np.zeros(0, bool), np.zeros(len(scalar_from), bool)])
        self.left_open = left_open[order]
        # What no string may hold: control characters, and escapes that are none.
        padded = np.concatenate([data, np.zeros(6, np.uint8)])
        escape = back & (run % 2 == 0)
        follower = padded[1:size + 1]
        hexed = _HEX[padded]
        wide = hexed[2:size + 2] & hexed[3:size + 3] & hexed[4:size + 4] & hexed[5:size + 5]
        wrong = (data < 0x20) | escape & (~_ESCAPED[follower] | (follower == 0x75) & ~wide)
        self.wrong = np.concatenate([[0], np.cumsum(wrong)])
        self.slashes = np.concatenate([[0], np.cumsum(back)])

    def read(self, roots: tuple[int, ...] = (OPEN_O,)) -> Reading:
        """The record of each text: it begins at the first opener of a kind in ``roots`` and
        ends where the depth comes back to nought."""
        opens = (self.kind == OPEN_O) | (self.kind == OPEN_A)
        closes = (self.kind == CLOSE_O) | (self.kind == CLOSE_A)
        n, texts = len(self.kind), len(self.texts)
        at = np.arange(n)
        from_ = np.searchsorted(self.text, np.arange(texts + 1))
        none = np.full(texts, -1, np.int64)
        if not n:
            return Reading(np.full(texts, NONE), none, none, none, np.zeros(0, np.int64), np.zeros(0, np.int64))
        # Tokens ahead of the record are prose and count for no depth.
        lead = np.full(texts, n, np.int64)
        rooty = np.flatnonzero(np.isin(self.kind, roots))
        np.minimum.at(lead, self.text[rooty], rooty)
        live = at >= lead[self.text]
        delta = np.where(live, opens.astype(np.int64) - closes, 0)
        total = np.cumsum(delta)
        base = np.concatenate([[0], total])[from_[:-1]]
        depth = total - base[self.text]  # behind the token
        level = np.where(opens, depth, depth + closes)  # an opener and its closer agree
        zero = np.flatnonzero(live & closes & (depth == 0))
        last = none.copy()
        if len(zero):
            seen, where = np.unique(self.text[zero], return_index=True)
            last[seen] = zero[where]
        closed = last >= 0
        begun = lead < n
        first = np.where(begun, lead, -1)
        stop = np.where(closed, last, from_[1:] - 1)
        used = live & (at <= stop[self.text])
        # Openers meet closers: in the order of (text, level) they alternate.
        brackets = np.flatnonzero(used & (opens | closes))
        order = brackets[np.lexsort((brackets, level[brackets], self.text[brackets]))]
        head, tail = order[:-1], order[1:]
        pair = opens[head] & closes[tail] & (level[head] == level[tail]) & (self.text[head] == self.text[tail])
        partner = np.full(n, -1, np.int64)
        partner[head[pair]], partner[tail[pair]] = tail[pair], head[pair]
        container = self._containers(used, opens, closes, level, depth, brackets)
        grammar, leaf = self._faults(first, container, partner)
        # Where the grammar breaks first; only the last token of a text can be cut off itself.
        error = np.full(texts, n, np.int64)
        faults = np.flatnonzero(used & (grammar | leaf))
        np.minimum.at(error, self.text[faults], faults)
        broken = error < n
        e = np.minimum(error, n - 1)
        torn = broken & ~closed & (e == from_[1:] - 1) & ~grammar[e] & (self.left_open[e] | (self.kind[e] == SCALAR) & (self.end[e] == self.ends))
        state = np.where(~begun, NONE, np.where(broken & ~torn, BROKEN, np.where(closed, WHOLE, CUT_OFF)))
        return Reading(state, first, last, np.where(broken, error, -1), container, partner)

    def _containers(self, used, opens, closes, level, depth, brackets) -> np.ndarray:
        """Of each token the last opener one level up: one sort, carried forward."""
        held = np.where(opens | closes, level - 1, depth)
        rows = np.flatnonzero(used)
        openers = brackets[opens[brackets]]
        key_level = np.concatenate([level[openers], held[rows]])
        key_text = np.concatenate([self.text[openers], self.text[rows]])
        key_at = np.concatenate([openers, rows])
        is_row = np.concatenate([np.zeros(len(openers), bool), np.ones(len(rows), bool)])
        sort = np.lexsort((is_row, key_at, key_level, key_text))
        carried = np.maximum.accumulate(np.where(is_row[sort], -1, np.arange(len(sort)))) if len(sort) else np.zeros(0, np.int64)
        container = np.full(len(self.kind), -1, np.int64)
        source = np.maximum(carried, 0)
        same = (carried >= 0) & (key_level[sort][source] == key_level[sort]) & (key_text[sort][source] == key_text[sort])
        own = is_row[sort]
        container[key_at[sort][own]] = np.where(same, key_at[sort][source], -1)[own]
        return container

    def _faults(self, first: np.ndarray, container: np.ndarray, partner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token: does it stand where the grammar allows none like it, and is it a
        string or scalar that is none."""
        kind = self.kind
        prev = np.concatenate([[0], kind[:-1]])
        root = np.arange(len(kind)) == first[self.text]
        in_object = np.where(container >= 0, kind[np.maximum(container, 0)] == OPEN_O, False)
        prev_value = np.isin(prev, (STRING, SCALAR, CLOSE_O, CLOSE_A))
        starts = np.isin(kind, (STRING, SCALAR, OPEN_O, OPEN_A))
        key = in_object & (kind == STRING) & np.isin(prev, (OPEN_O, COMMA))
        value_here = np.where(in_object, prev == COLON, np.isin(prev, (OPEN_A, COMMA)))
        bad = starts & ~root & ~key & ~value_here
        # In an object, what follows '{' or ',' must be a key.
        prev_key = np.concatenate([[False], key[:-1]]) & ~root
        bad |= (kind == COLON) & ~prev_key
        bad |= (kind != COLON) & prev_key
        bad |= (kind == COMMA) & ~prev_value
        closes = (kind == CLOSE_O) | (kind == CLOSE_A)
        bad |= closes & ~(prev_value | np.isin(prev, (OPEN_O, OPEN_A)))
        mate = kind[np.maximum(partner, 0)]
        bad |= (kind == CLOSE_O) & (mate != OPEN_O) | (kind == CLOSE_A) & (mate != OPEN_A)
        leaf = (kind == STRING) & ((self.wrong[self.end] > self.wrong[self.begin]) | self.left_open)
        scalars = np.flatnonzero(kind == SCALAR)
        short = scalars[self.end[scalars] - self.begin[scalars] <= SCALAR_BYTES]
        if len(short):
            # Scalars side by side as rows of bytes; each distinct one is judged once.
            length = self.end[short] - self.begin[short]
            reach = np.arange(SCALAR_BYTES)
            chars = self.data[np.minimum(self.begin[short][:, None] + reach, len(self.data) - 1)]
            rows = np.where(reach < length[:, None], chars, 0).astype(np.uint8)
            distinct, which = np.unique(rows.view(f"S{SCALAR_BYTES}").ravel(), return_inverse=True)
            leaf[short] = np.array([not _leaf(d) for d in distinct.tolist()], bool)[which]
        for i in scalars[self.end[scalars] - self.begin[scalars] > SCALAR_BYTES].tolist():
            leaf[i] = not _leaf(self.data[self.begin[i]:self.end[i]].tobytes())
        return bad, leaf


def _leaf(leaf: bytes) -> bool:
    def refuse(_: str) -> None:
        raise ValueError

    try:
        json.loads(leaf, parse_constant=refuse)
        return True
    except (ValueError, RecursionError):
        return False


class Rows(NamedTuple):
    """Elements of one node: the text each belongs to, its link, and its bytes' place."""

    node: str
    text: np.ndarray
    parent: np.ndarray
    child: np.ndarray
    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray


class Walk:
    """The way from objects down to the elements of the wanted arrays, for all at once."""

    def __init__(self, index: Index, reading: Reading, live: np.ndarray):
        """``live``: the tokens that belong to records."""
        self.index, self.reading = index, reading
        kind, container = index.kind, reading.container
        prev = np.concatenate([[0], kind[:-1]]) if len(kind) else kind
        starts = live & np.isin(kind, (STRING, SCALAR, OPEN_O, OPEN_A))
        in_object = np.where(container >= 0, kind[np.maximum(container, 0)] == OPEN_O, False)
        self.members = np.flatnonzero(starts & in_object & (prev == COLON))
        in_array = np.flatnonzero(starts & (container >= 0) & ~in_object)
        self.ordered = in_array[np.argsort(container[in_array], kind="stable")]
        self.group = container[self.ordered]
        key = self.members - 2
        self.key_from, self.key_to = index.begin[key] + 1, index.end[key] - 1
        escaped = np.flatnonzero(index.slashes[self.key_to] > index.slashes[self.key_from])
        self.spelled = {int(i): json.loads(index.data[index.begin[key[i]]:index.end[key[i]]].tobytes()) for i in escaped}
        self.known: dict[str, np.ndarray] = {}
        self.rows: list[Rows] = []

    def member(self, name: str) -> np.ndarray:
        """Of each object token the value of its member (or -1); the last of equal keys holds."""
        if name not in self.known:
            raw = np.frombuffer(name.encode(), np.uint8)
            fit = np.flatnonzero(self.key_to - self.key_from == len(raw))
            place = self.key_from[fit][:, None] + np.arange(len(raw))
            fit = fit[(self.index.data[place] == raw).all(axis=1)]
            fit = np.sort(np.concatenate([fit, np.array([i for i, s in self.spelled.items() if s == name], np.int64)]))
            held = np.full(len(self.index.kind), -1, np.int64)
            held[self.reading.container[self.members[fit]]] = self.members[fit]
            self.known[name] = held
        return self.known[name]

    def holds(self, objects: np.ndarray, tree: dict) -> np.ndarray:
        """Has each object any of the tree's arrays?"""
        found = np.zeros(len(objects), bool)
        for name, below in tree.items():
            child = self.member(name)[objects]
            kind = np.where(child >= 0, self.index.kind[np.maximum(child, 0)], 0)
            if "[]" in below:
                found |= np.isin(kind, (OPEN_O, OPEN_A, STRING))
            else:
                sub = np.flatnonzero(kind == OPEN_O)
                found[sub] |= self.holds(child[sub], below)
        return found

    def objects(self, objects: np.ndarray, parent: np.ndarray, tree: dict, path: str = "") -> None:
        kind = self.index.kind
        for name, below in tree.items():
            child = self.member(name)[objects]
            held = np.flatnonzero(child >= 0)
            child, link = child[held], parent[held]
            here = f"{path}.{name}" if path else name
            single = kind[child] == OPEN_O
            if "[]" not in below:
                self.objects(child[single], link[single], below, here)
                continue
            # A single object stands for an array of one.
            self.elements(child[single], link[single], np.zeros(int(single.sum()), np.int64), below["[]"], here)
            many = kind[child] == OPEN_A
            self.arrays(child[many], link[many], below["[]"], here)
            stored = kind[child] == STRING
            if stored.any():
                self.stored(child[stored], link[stored], below["[]"], here)

    def arrays(self, arrays: np.ndarray, parent: np.ndarray, below: dict, path: str) -> None:
        low, high = np.searchsorted(self.group, arrays), np.searchsorted(self.group, arrays, "right")
        many = high - low
        child = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.elements(self.ordered[np.repeat(low, many) + child], np.repeat(parent, many), child, below, path)

    def elements(self, tokens: np.ndarray, parent: np.ndarray, child: np.ndarray, below: dict, path: str) -> None:
        index = self.index
        # Of the valid scalars only null begins with n.
        real = ~((index.kind[tokens] == SCALAR) & (index.data[index.begin[tokens]] == 0x6E))
        tokens, parent, child = tokens[real], parent[real], child[real]
        if not len(tokens):
            return
        mate = self.reading.partner[tokens]
        end = index.end[np.where(mate >= 0, mate, tokens)]
        self.rows.append(Rows(path, index.text[tokens], parent, child, index.data, index.begin[tokens], end))
        whole = index.kind[tokens] == OPEN_O
        if below and whole.any():
            self.objects(tokens[whole], child[whole], below, path)

    def stored(self, tokens: np.ndarray, parent: np.ndarray, below: dict, path: str) -> None:
        """Arrays that were stored as JSON text are indexed again, all of a node together."""
        index = self.index
        owner = index.text[tokens]
        inner = Index([json.loads(index.data[a:b].tobytes()).encode("utf-8", "surrogatepass") for a, b in zip(index.begin[tokens].tolist(), index.end[tokens].tolist())])
        read = inner.read((OPEN_A,))
        n = len(inner.kind)
        # Nothing but blanks may stand beside the array.
        before = np.searchsorted(inner.text, np.arange(len(tokens) + 1))
        good = np.flatnonzero((read.state == WHOLE) & (read.first == before[:-1]) & (read.last == before[1:] - 1))
        live = np.zeros(n + 1, np.int64)
        live[read.first[good]] += 1
        live[read.last[good] + 1] -= 1
        walk = Walk(inner, read, np.cumsum(live[:-1]) > 0)
        walk.arrays(read.first[good], parent[good], below, path)
        self.rows += [r._replace(text=owner[r.text]) for r in walk.rows]


def _tree(nodes: tuple[str, ...]) -> dict:
    """Nodes as a tree of members; '[]' marks an array and holds its elements' members."""
    tree: dict = {}
    for node in sorted(nodes):
        here = tree
        names = node.split(".")
        for depth, name in enumerate(names):
            here = here.setdefault(name, {})
            if ".".join(names[: depth + 1]) in nodes:
                here = here.setdefault("[]", {})
    return tree


def shred(payloads: list[bytes], nodes: tuple[str, ...] = NODES) -> list[Rows]:
    """Elements of all payloads, node by node.

    The record of a payload is its first complete object that has one of the wanted arrays.
    An object that is complete without them is passed over, and so is a brace behind which no
    JSON follows; one that is cut off at the payload's end hides what stands in it.
    """
    tree = _tree(nodes)
    out: list[Rows] = []
    searches = {t: _Search(p, m.start()) for t, p in enumerate(payloads) if (m := _OPENER.search(p))}
    while searches:
        asked = [(t, cut) for t, search in searches.items() for cut in search.candidates()]
        index = Index([payloads[t][cut:cut + searches[t].window] if searches[t].window else payloads[t][cut:] for t, cut in asked])
        read = index.read()
        at, n = np.arange(len(index.kind)), len(index.kind)
        # Of a broken record what stands before the fault is sound, and may hold the true one.
        to = np.where(read.state == WHOLE, read.last, np.where(read.state == BROKEN, read.error - 1, -1))
        live = (at >= read.first[index.text]) & (at <= to[index.text]) if n else np.zeros(0, bool)
        walk = Walk(index, read, live)
        holds = np.zeros(len(asked), bool)
        whole = np.flatnonzero(read.state == WHOLE)
        holds[whole] = walk.holds(read.first[whole], tree)
        records = []
        for w, (t, cut) in enumerate(asked):
            search = searches.get(t)
            if search is None or search.settled or not search.open(cut):
                continue
            if holds[w]:
                records.append(w)
                search.settled = True
            elif read.state[w] == WHOLE:
                search.at = cut + int(index.end[read.last[w]] - index.starts[w])
            elif read.state[w] != BROKEN and search.window and cut + search.window < len(search.text):
                search.widen(cut)
            elif read.state[w] != BROKEN:
                search.settled = True  # cut off
            else:
                # Objects that are open at the fault break there too; of the closed ones those
                # without wanted arrays are no record either.
                low, high = np.searchsorted(index.text, [w, w + 1])
                inner = low + np.flatnonzero(live[low:high] & (index.kind[low:high] == OPEN_O))
                closed = (read.partner[inner] >= 0) & (read.partner[inner] < read.error[w])
                if closed.any():
                    closed[closed] = walk.holds(inner[closed], tree)
                search.dead |= set((index.begin[inner[~closed]] - index.starts[w] + cut).tolist())
                search.at = cut + 1
        found = np.array(records, np.int64)
        walk.objects(read.first[found], np.full(len(found), -1, np.int64), tree)
        source = np.array([t for t, _ in asked], np.int64)
        out += [r._replace(text=source[r.text]) for r in walk.rows]
        for t in list(searches):
            if searches[t].settled or not searches[t].again():
                del searches[t]
    return out


class _Search:
    """Where in one text a record is looked for next: the first brace alone, with all that
    follows; then more and more braces at a time, each with a short window that grows."""

    def __init__(self, text: bytes, at: int):
        self.text, self.at = text, at
        self.window, self.many, self.widest = 0, 1, None
        self.dead: set[int] = set()
        self.settled = False

    def candidates(self) -> list[int]:
        if self.widest is not None:
            return [self.widest]
        found = (m.start() for m in _OPENER.finditer(self.text, self.at) if m.start() not in self.dead)
        return list(islice(found, self.many))

    def open(self, cut: int) -> bool:
        """Is the brace still to be judged?  One being widened keeps those behind it waiting."""
        return cut >= self.at and cut not in self.dead and (self.widest is None or self.widest == cut)

    def widen(self, cut: int) -> None:
        self.at, self.widest = cut, cut

    def again(self) -> bool:
        """Get ready for another round; false if no brace is left."""
        if self.widest is not None:
            self.window *= 8
            if self.widest == self.at:
                return True
            self.widest = None
        self.window, self.many = WINDOW, min(self.many * 4, 256)
        return any(m.start() not in self.dead for m in _OPENER.finditer(self.text, self.at))


def _texts(rows: list[Rows]) -> pa.Array:
    """The elements' JSON texts, gathered from the byte arrays."""
    parts, lengths = [], []
    for r in rows:
        many = r.end - r.begin
        lengths.append(many)
        parts.append(r.data[np.repeat(r.begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64) if lengths else np.zeros(1, np.int64)
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _partition(nodes: tuple[str, ...], key_type: pa.DataType, texts: bool):
    names = ["record_id", "node", "parent_ix", "child_ix"] + (["element"] if texts else [])

    def emit(keys: list, payloads: list[bytes]) -> pa.RecordBatch:
        rows = shred(payloads, nodes)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        columns = [
            pa.array(keys, key_type).take(pa.array(join([r.text for r in rows], np.int64))),
            pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(rows)), [len(r.text) for r in rows]).astype(np.int32)), pa.array([r.node for r in rows], pa.string())).cast(pa.string()),
            pa.array(join([r.parent for r in rows], np.int64).astype(np.int32)),
            pa.array(join([r.child for r in rows], np.int64).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns + ([_texts(rows)] if texts else []), names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, payloads, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                raw = text.as_buffer().to_pybytes()
                keys.append(key)
                payloads.append(raw)
                size += len(raw)
                if size >= SLAB_BYTES:
                    yield emit(keys, payloads)
                    keys, payloads, size = [], [], 0
            if keys:
                yield emit(keys, payloads)

    return run


def flatten_payloads(df: DataFrame, key: str, payload: str, nodes: tuple[str, ...] = NODES, texts: bool = True) -> DataFrame:
    """One row per non-null array element: ``record_id, node, parent_ix, child_ix`` and, with
    ``texts``, ``element``.

    ``element`` is the element's JSON text, ``parent_ix`` the position of the enclosing
    element (-1: the record).  A single object in place of an array is its element 0, an
    array given as JSON text is read as the array, nulls count in the positions.  Null,
    empty, broken and incomplete payloads have no rows; text around the record does not
    matter, whatever quotes and braces stand in it.  Of equal keys in one object the last
    holds.  Repeated input rows give repeated rows.
    """
    narrow = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(payload).alias("payload"))
    return narrow.mapInArrow(_partition(nodes, pa.int64(), texts), "record_id bigint, node string, parent_ix int, child_ix int" + (", element string" if texts else ""))


def explode_items(df: DataFrame, key: str, items: str) -> DataFrame:
    """A typed array of structs as rows: ``record_id, child_ix`` and the struct's fields.

    Null elements are counted in the position and left out; null and empty arrays have no
    rows.
    """
    return (
        df.select(F.col(key).alias("record_id"), F.posexplode(items).alias("child_ix", "_item"))
        .where(F.col("_item").isNotNull())
        .select("record_id", "child_ix", "_item.*")
    )
