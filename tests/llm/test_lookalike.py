"""One form for equal-looking text."""

import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.lookalike import add_canonical, canonical_array, lookalike_pairs

SAME = [("Ａｂｃ　１２３", "Abc 123"), ("café", "café"), ("ệ", "ệ"), ("Zoﬁa", "Zofia"), ("a​b­c⁠", "abc"), ("x y", "x y"), ("1993‐11‑07", "1993-11-07"), ("Рaypal", "Paypal"), ("ΖED", "ZED"), ("한글", unicodedata.normalize("NFD", "한글")), ("Ӧst", "Öst")]
OTHER = [("O", "0"), ("a", "A"), ("e", "é"), ("a  b", "a b"), ("a-b", "a–b"), ("x²", "x2"), ("ſ", "s"), ("rn", "m"), ("①", "1")]


def one(text):
    return canonical_array(pa.array([text])).to_pylist()[0]


def test_same_and_other():
    for a, b in SAME:
        assert one(a) == one(b), (a, b)
    for a, b in OTHER:
        assert one(a) != one(b), (a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aeoAZ ȩ̣́́̈ạǘ한각क़"), max_size=12), max_size=6))
def test_is_nfc_where_nothing_else_applies(texts):
    assert canonical_array(pa.array(texts, pa.string())).to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_stable_and_batched_alike():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aｂ́‌Е -‐ﬁ") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", None, "ｘ" * 200_000]
    whole = canonical_array(pa.array(texts)).to_pylist()
    assert whole == [None if t is None else one(t) for t in texts]
    assert canonical_array(pa.array(whole)).to_pylist() == whole


def test_frame(spark):
    df = spark.createDataFrame([(1, "Ａ", "old"), (2, None, None), (3, "", "x")], "id int, text string, form string")
    assert [tuple(r) for r in add_canonical(df, {"text": "form"}).orderBy("id").collect()] == [(1, "Ａ", "A"), (2, None, None), (3, "", "")]
    assert add_canonical(df.limit(0), {"text": "form"}).count() == 0


def test_pairs(spark):
    rows = [(1, 7, "Ab"), (2, 7, "Ａb"), (3, 7, "Ab"), (4, 8, "Ab"), (5, 7, None), (None, 7, "Аb"), (6, None, "Ab"), (7, 7, ""), (8, 7, "​"), (9, 7, "ab")]
    df = spark.createDataFrame(rows, "block_id bigint, scope bigint, text string")
    got = lookalike_pairs(df, "block_id", "scope", "text").select("id_a", "id_b").orderBy("id_a", "id_b").collect()
    assert [tuple(r) for r in got] == [(1, 2), (2, 3), (7, 8)]
    assert lookalike_pairs(df.limit(0), "block_id", "scope", "text").count() == 0


def test_many_copies_of_two_forms(spark):
    rows = [(i, 1, "same") for i in range(2000)] + [(5000, 1, "ѕame")]
    assert lookalike_pairs(spark.createDataFrame(rows, "id bigint, s bigint, t string"), "id", "s", "t").count() == 2000
