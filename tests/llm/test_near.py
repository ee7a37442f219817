"""Keys that nearly agree, words with two confusions, and lines of any length."""

import random
import time

from paperloom.llm.scans import MARGIN, Decoder, Tree, _close, _Near, furniture, page_number


def test_first_near_key_against_all_pairs():
    rng = random.Random(5)
    keys = []
    for _ in range(1500):
        key = "".join(rng.choice("abcde") for _ in range(rng.randrange(7, 45))) if not keys or rng.random() < 0.4 else rng.choice(keys)
        key = list(key)
        for _ in range(rng.randrange(7)):
            at = rng.randrange(len(key) + 1)
            key[at:at + rng.randrange(2)] = rng.choice(["", "a", "b", "c"])
        if len(key) >= 7:
            keys.append("".join(key))
    near, held = _Near(), []
    for key in dict.fromkeys(keys):
        want = next((n for n, other in enumerate(held) if abs(len(other) - len(key)) <= 3 and _close(other, key)), None)
        assert near.first(key) == want
        if want is None:
            near.add(key)
            held.append(key)
    assert 50 < len(held) < 1200


def test_many_titles_end_soon():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, 11))).title() for _ in range(3000)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 7))) for _ in range(100_000)]
    began = time.time()
    assert furniture(lines[:2] + ["Annual Report of the House"] * 2 + lines)[2] == "running"
    assert time.time() - began < 120


def test_two_confusions_against_all_variants():
    rng = random.Random(7)
    lexicon = {"".join(rng.choice("acdehilmnrtu") for _ in range(rng.randrange(4, 9))): 400 for _ in range(3000)}
    decoder, tree = Decoder(lexicon), Tree(lexicon)
    for word in rng.sample(sorted(lexicon), 60):
        prints = [(p, k) for p, k in decoder._variants(word)]
        for first, kind_a in rng.sample(prints, min(4, len(prints))):
            for second, kind_b in decoder._variants(first):
                if second in lexicon and second != word:
                    found = dict(tree.twice(word))
                    apart = sum(a != b for a, b in zip(word, second)) == 2 and len(word) == len(second) == len(first)
                    assert second in found or not apart
                    assert second not in found or MARGIN[found[second][0]] * MARGIN[found[second][1]] > 0


def test_long_words_and_lines():
    """Nothing depends on how long a word or a line is."""
    decoder = Decoder({"donaudampfschifffahrtsgesellschaft": 50})
    assert decoder.corrected("donaudampfschifffahrtsgese11schaft")[0] == "donaudampfschifffahrtsgesellschaft"
    title = "Proceedings Of The Annual General Meeting Of The Society For The Advancement Of Very Long Running Headlines"
    assert len(title) > 100 and set(furniture([title, "a line of text", title, "more text here"]).values()) == {"running"}
    assert page_number("-" * 30 + " 12 " + "-" * 30) is not None
