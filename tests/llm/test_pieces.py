"""Pieces: bounds, overlap, whole text, natural boundaries."""

import random

from paperloom.llm.pieces import Cutter, cut_texts, possible_cuts


def test_invariants():
    rng = random.Random(6)
    for _ in range(150):
        text = "".join(rng.choice(["word ", "Term. ", "line\n", "\n\n", "号。", "longerword", " "]) for _ in range(rng.randrange(400)))
        budget, overlap = rng.randrange(1, 300), rng.randrange(-2, 320)
        pieces = Cutter(text).pieces(budget, overlap)
        shared = min(max(overlap, 0), budget - 1)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        if len(text) > budget:
            assert len(pieces) > 1 and all(0 < b - a <= budget for a, b in pieces)
            assert all(nxt[0] == cur[1] - shared for cur, nxt in zip(pieces, pieces[1:]))


def test_natural_boundaries_win():
    text = "aaa bbb. ccc ddd\n\neee fff. ggg hhh"
    assert Cutter(text).pieces(26, 0)[0] == (0, 18)
    assert Cutter("x" * 100).pieces(40, 0) == [(0, 40), (40, 80), (80, 100)]
    topics = "cats purr and meow. cats sleep and meow. cats purr all day. " * 3 + "stocks fell on markets. bonds and stocks rose. markets trade bonds. " * 3
    cut = Cutter(topics).pieces(300, 0)[0][1]
    assert abs(cut - topics.index("stocks")) <= 70
    assert set(possible_cuts("a b\nc. d\n\ne")[1].tolist()) == {2, 3, 4, 5}


def test_frame(spark):
    texts = spark.createDataFrame([(1, "one two three four five", "p"), (2, None, "p"), (3, "", "p"), (4, "ab " * 50_000, "p")], "inspection_id bigint, full_text string, piece string")
    demands = spark.createDataFrame([(10, 1, 8, 2), (11, 1, None, None), (12, 1, 0, 3), (13, 1, 100, 1), (14, 2, 5, 1), (15, 3, 5, 1), (16, 9, 5, 1), (17, None, 5, 1), (18, 4, 1000, 10), (19, 1, 4, 9)], "arm_id bigint, inspection_id bigint, budget int, overlap int")
    got = cut_texts(texts, demands, "inspection_id", "full_text", "arm_id", "budget", "overlap")
    counts = {r.arm_id: r.n for r in got.groupBy("arm_id").agg({"pieces": "max"}).withColumnRenamed("max(pieces)", "n").collect()}
    assert set(counts) == {10, 11, 12, 13, 15, 18, 19} and counts[11] == counts[12] == counts[13] == counts[15] == 1
    assert counts[18] > 100 and got.where("arm_id = 10 and length(piece) > 8").count() == 0
    assert cut_texts(texts.limit(0), demands, "inspection_id", "full_text", "arm_id", "budget", "overlap").count() == 0


def test_deepest_valley_before_kind():
    """The topic changes at a sentence end; an empty line inside a topic is no better place."""
    rng = random.Random(2)
    topics = [["river", "water", "boat", "fish", "shore", "flood", "canal"], ["ledger", "credit", "audit", "budget", "invoice", "profit", "tax"]]
    say = lambda words: " ".join(rng.choice(words) for _ in range(8)).capitalize() + "."
    for _ in range(10):
        first, second = [say(topics[0]) for _ in range(20)], [say(topics[1]) for _ in range(20)]
        text = " ".join(first[:16]) + "\n\n" + " ".join(first[16:]) + " " + " ".join(second)
        change = text.index(second[0])
        (begin, end), *rest = Cutter(text).pieces(change + 120, 10)
        assert (begin, end) == (0, change) and rest[0][0] == change - 10
