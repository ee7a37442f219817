"""Sentence boundaries on cases of ten languages and hostile texts."""

import time
from collections import Counter

from paperloom.llm.sentences import Model, boundaries, candidates, observe, sentence_units, train

CASES = [
    ["Dr. Smith paid $ 3.50 at 5 p.m. near St. John.", "It works."], ["I left at 5 a.m. Nobody saw me."[:16], "Nobody saw me."], ["And then... silence.", "What a mess!", "No, really?!"], ['"Unplug it. Wait. Do it again!" was all they said.', "Hm."], ['He asked, "Is it safe?" and left.', "Fine."],
    ["J. R. Hill came (Prof. Lee too, etc.) and sat."], ["Das ist ca. 3,5 m lang, d. h. zu lang.", "So ein Ärger!"], ["M. Dupont m'a dit : « C'est fini. Partez ! » avant de raccrocher.", "Merci."], ["¿Quién es?", "¡Qué desastre!", "El Sr. Paz dijo: «No. Nunca.» y se marchó."],
    ["«Не трогай. Жди!» — сказал мастер.", "В 2005 г. он ушёл."], ["店員は「少し待って。すぐ直ります！」と言いました。", "ありがとう。"], ["客服说：“请等一下。马上就好！”然后挂了。", "真糟糕！"], ["मेरा कैमरा आया।", "कितनी बुरी बात है!"], ["يا لها من فوضى!", "هل جرب أحد الكاميرا؟"],
]


def test_cases():
    seen = Counter()
    for sentences in CASES * 30:
        text = ("" if sentences[0][0] > "⿿" else " ").join(sentences)
        observe(text, seen)
        observe("\n\n".join(sentences), seen)
    counts: dict = {}
    for (kind, key, what), n in seen.items():
        counts.setdefault((kind, key), {})[what] = n
    model = Model(counts)
    for sentences in CASES:
        glue = "" if sentences[0][0] > "⿿" else " "
        text, ends, at = glue.join(sentences), [], 0
        for s in sentences:
            ends.append(at + len(s))
            at += len(s) + len(glue)
        assert boundaries(text, model) == ends, text


def test_breaks_and_blanks():
    model = Model({("script", "Thai"): {"N": 5}})
    assert boundaries("One line\ngoes on. \nNext\n\nlast bit", model) == [17, 23, 33]
    assert boundaries("ราคา368.70บาท ขอบคุณมาก", model) == [13, 23]
    assert boundaries("", model) == [] and boundaries(" \n\n \n", model) == [] and boundaries("...", model) == [3]


def test_frame(spark):
    rows = [(1, "One. Two.", "a"), (1, "One. Two.", "a"), (2, None, "b"), (3, "", "c"), (4, "word " * 40_000, "d"), (5, "x." * 5000, "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sent_end string")
    model = train(df)
    got = sentence_units(df, model)
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {1: 4, 4: 1, 5: 1}
    assert {r.sentence for r in got.where("doc_id = 1").collect()} == {"One.", "Two."}
    assert sentence_units(df.limit(0), train(df.limit(0))).count() == 0


def test_no_count_is_cut(spark):
    # Over a million counts, most of them filler; 'gear' ends two paragraphs and 60 sentences.
    filler = ("x. " * 6 + "x.\n\n") * 2500
    rows = [(n, filler) for n in range(24)] + [(100 + n, "The gear. Then on.") for n in range(60)] + [(200 + n, "A gear.\n\nOn.") for n in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    model = train(df)
    assert not model.abbreviation("gear")
    assert boundaries("He saw the gear. Then he left.", model) == [16, 30]


def test_model_of_telling_keys(spark):
    # What stays in Spark changes no boundary: the model of all counts finds the same ones.
    glued = ["".join(" " + s for s in case) for case in CASES]
    texts = (glued + ["\n\n".join(case) for case in CASES]) * 30
    model = train(spark.createDataFrame([(t,) for t in texts], "text string"))
    seen: Counter = Counter()
    for text in texts:
        observe(text, seen)
    counts: dict = {}
    for (kind, key, what), n in seen.items():
        counts.setdefault((kind, key), {})[what] = n
    assert all(model.counts[k] == counts[k] for k in model.counts) and len(model.counts) < len(counts)
    assert all(boundaries(t, model) == boundaries(t, Model(counts)) for t in set(texts))


def test_chain_against_single_thresholds():
    """Decoding couples the tags of a quotation: its inner stops would be boundaries alone."""
    model = Model({})
    text = '"Unplug it. Wait. Do it again!" was all they said. "Go on. Wait." Then he left.'
    marks = [m for m in candidates(text, 0, len(text))]
    alone = [m[1] for m in marks if model.emission(text, 0, len(text), m) > 0]
    assert alone == [11, 17, 50, 58, 65, 79]
    assert boundaries(text, model) == [50, 58, 65, 79]


def test_transitions_decide():
    """A weak stop right behind one that ended nothing is a boundary if the corpus has it so."""
    text = "Siehe bzw. 3. Mai und so fort."
    counts = {("left", "bzw"): {"L": 500}, ("right", "Mai"): {"A": 7}}
    pairs = {("pair", "Ld2"): {"E": 500, "L": 2}, ("pair", "Ed5"): {"E": 400, "L": 400}, ("pair", "Ld5"): {"E": 300, "L": 300}}
    mark = candidates(text, 0, len(text))[1]
    assert -0.9 < Model(counts | pairs).emission(text, 0, len(text), mark) < 0
    assert boundaries(text, Model(counts)) == [30]
    assert boundaries(text, Model(counts | pairs)) == [13, 30]
    assert Model(counts | pairs).turns[0, 1, "d2"] > 0 > Model(counts | pairs).turns[0, 0, "d2"]


def test_blanks_learned_from_stripped_text():
    """Scripts with stops of their own go by them; the others by blanks, as stripped text has it."""
    burmese = "ကောင်းသည် ဟု သူပြောသည်။ ထို့နောက် သူသွားသည်။"
    assert boundaries(burmese, Model({})) == [burmese.index("။") + 1, len(burmese)]
    seen: Counter = Counter()
    for _ in range(5):
        observe("他来了。她走了。你好 吗！", seen)
    assert seen["blank", "", "E"] == 10 and seen["blank", "", "L"] == 5
    assert Model({("blank", ""): {"E": 90, "L": 1}}).blank > 3 > 0 > Model({("blank", ""): {"E": 1, "L": 90}}).blank


def test_long_quotation_is_linear():
    began = time.time()
    text = '"' + "He came. She left. " * 10_000 + 'Done." was all.'
    assert boundaries(text, Model({})) == [len(text)]
    assert time.time() - began < 20
