"""Leaked passages against brute force."""

import math
import random
from collections import Counter

import numpy as np

from paperloom.llm.leaks import Hasher, Windows, find_leaks, find_similar, fingerprints, ideographs_of, shingles, weighted_similarity, words_of

WORDS = [f"w{i}" for i in range(400)]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id bigint"), spark.createDataFrame(items, "item_id bigint, text string, lang string")


def test_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40)), "en") for i in range(6)] + [(6, "", "en"), (7, None, "en"), (8, "too short to leak", "en")]
    items += [(9, items[0][1], None), (10, "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(50)), "zh")]
    docs = []
    for d in range(120):
        words = [rng.choice(WORDS) for _ in range(30)]
        item, n = rng.choice(items[:6]), rng.randrange(6, 20)
        at = rng.randrange(40 - n)
        passage = " ".join(item[1].split()[at:at + n])
        passage = rng.choice([passage, passage.upper(), passage.replace(" ", "\n> "), passage.replace(" ", ", "), passage.replace(" ", " <b>"), passage.replace(" ", "[/i] ")])
        docs.append((d, " ".join(words[:15]) + " " + passage + " " + " ".join(words[15:]), 0))
    zh = items[-1][1]
    docs += [(200, zh[3:25], 0), (201, "，".join(zh[3:25]), 0), (202, zh[3:21], 0), (203, "", 0), (204, None, 0), (None, items[0][1], 0), (205, items[1][1] + " x" * 60_000, 0), (205, items[1][1] + " x" * 60_000, 0)]
    left, right = frames(spark, docs, items)
    want = set()
    for d, text, _ in docs:
        if d is None or not text:
            continue
        for i, t, lang in items:
            units, width = (ideographs_of, 20) if lang == "zh" else (words_of, 12)
            mine, theirs = units(text), units(t or "")
            grams = {tuple(theirs[k:k + width]) for k in range(len(theirs) - width + 1)}
            if any(tuple(mine[k:k + width]) in grams for k in range(len(mine) - width + 1)):
                want.add((d, i))
    rows = find_leaks(left, right).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert find_leaks(left.limit(0), right).count() == 0 and find_leaks(left, right.limit(0)).count() == 0


def test_multi_index_misses_nothing_within_the_radius():
    rng = np.random.default_rng(1)
    hasher = Hasher()
    units = [str(rng.choice(WORDS)) for _ in range(500)]
    for radius, width in ((3, 12), (7, 48)):
        index = Windows([(0, units)], width, hasher, radius)
        for _ in range(300):
            k = int(rng.integers(len(index.print)))
            near = index.print[k]
            for bit in rng.choice(64, radius, replace=False):
                near ^= np.uint64(1) << np.uint64(bit)
            assert k in index.candidates(np.array([near], np.uint64))[1]
    assert len(fingerprints(hasher(units[:5]), 12)) == 0
    long = hasher(units * 200)  # sums beyond 16 bits
    votes = np.unpackbits(long[-12:].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert fingerprints(long, 12)[-1] == np.packbits(votes > 6, bitorder="little").view("<u8")[0]


def test_similar_against_brute_force(spark):
    """Items with a word changed in forty are found with their similarity, other texts are not."""
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(48, 70))), "en") for i in range(30)] + [(98, "short", "en"), (99, None, None)]
    docs = []
    for d in range(600):
        words = rng.choice(items[:30])[1].split()
        for _ in range(d % 4):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
        docs.append((d, " ".join([rng.choice(WORDS) for _ in range(d % 7)] + words + ["end"] * (d % 5)), 0))
    docs += [(700, None, 0), (701, "", 0), (None, items[0][1], 0)]
    left, right = frames(spark, docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in find_similar(left, right).collect()}
    spread = Counter(s for _, t, _ in items[:31] for s in set(shingles(words_of(t))))
    weight = lambda s: 1 + math.log(32 / (1 + spread[s]))
    want = {}
    for d, text, _ in docs[:600]:
        mine = words_of(text)
        for i, t, _ in items[:30]:
            theirs = words_of(t)
            starts = sorted({*range(0, len(theirs) - 47, 6), len(theirs) - 48})
            if len(set(mine) & set(theirs)) < 30:
                continue
            most = max((weighted_similarity(shingles(mine[a:a + 48]), shingles(theirs[b:b + 48]), weight) for a in range(len(mine) - 47) for b in starts), default=0)
            if most >= 0.8:
                want[d, i] = most
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert sum(abs(got[p] - want[p]) < 1e-9 for p in got) >= 0.97 * len(got)
    assert {d for d, _ in got} >= {d for d in range(600) if d % 4 == 0}
    assert sum(d % 4 == 1 for d, _ in got) >= 120
    assert find_similar(left.limit(0), right).count() == 0 and find_similar(left, right.limit(0)).count() == 0
