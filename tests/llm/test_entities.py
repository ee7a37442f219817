"""Names linked to a register, with distractors and hostile rows."""

import random

import numpy as np

from paperloom.llm.entities import AT_SIMILARITY, BAND_ROWS, RECALL, Vocabulary, abbreviates, bands_for, damerau, link_names, monge_elkan, signature

REGISTER = [(1, "organisation", "Tuvvimmberg Laboratories Co", "Norrhamn"), (2, "organisation", "Nystiphurst Manufacturing Co", "Valbrise"), (3, "organisation", "Nystiphurst Foods SARL", "Oxenvale"), (4, "person", "Nathaniel Josephine Haskebbbury", "Tilbrook"), (5, "person", "Elizabeth Wendipmann", "Tilbrook"), (6, "organisation", "Kerpeffdale Department Store plc", "Tilbrook")]
VARIANTS = [
    ("Tuvvimmberg Laboratories Co", 1), ("TUVVIMMBERG LABS CO (BRANCH 35)", 1), ("Tuvvinmberg Laboratories Company", 1), ("Laboratories (Tuvvimmberg) Co", 1), ("Tuvvimm berg Lab. Co #0869", 1), ("tuvvimmberg co - norrhamn 7", 1), ("Nystiphurst Mfg Co", 2), ("Nysitphurst Manuf. Co.", 2), ("nystiphurst fds s.a.r.l.", 3),
    ("Nystiphurst", None), ("nystiphurst valbrise", 2), ("Nystiphurst Pharmacy Co", None), ("Haskebbbury, Nate", 4), ("Haskebbury, N. J.", 4), ("Liz Wendipmann", 5), ("Beth Wendipman", 5), ("Margaret Wendipmann", None), ("Wendipmann", 5), ("Kerpeffdale Dept. St. PLC", 6), ("Kerpeffdale De", 6), ("Zimpundofield Trading Ltd", None), ("unknown", None), ("n/a", None), ("", None), (None, None), ("x" * 5000, None),
]


def test_links(spark):
    rows = [(i, name, "clash", want) for i, (name, want) in enumerate(VARIANTS)] + [(0, VARIANTS[0][0], "again", 1)]
    records = spark.createDataFrame(rows, "record_id bigint, written string, town string, want bigint")
    register = spark.createDataFrame(REGISTER + [REGISTER[0], (None, "person", "No One", "x")], "org_id bigint, org_kind string, registered_name string, town string")
    got = link_names(records, "written", register).collect()
    assert len(got) == len(rows)
    wrong = [(r.written, r.org_id, r.want) for r in got if r.org_id != r.want and r.written != "Wendipmann"]
    assert wrong == []
    assert link_names(records.limit(0), "written", register).count() == 0
    assert link_names(records, "written", register.limit(0)).where("org_id is not null").count() == 0


def test_common_spelling_is_its_own_centre(spark):
    register = spark.createDataFrame(REGISTER[:1], "org_id bigint, org_kind string, registered_name string, town string")
    rows = [(i, "Tuvvimmbarg Laboratories Co") for i in range(5)] + [(9, "Tuvvimmberk Laboratories Co")] + [(20 + i, "Tuvvimmberg Laboratories Co") for i in range(8)]
    got = {r.record_id: r.org_id for r in link_names(spark.createDataFrame(rows, "record_id bigint, written string"), "written", register).collect()}
    assert got[0] is None and got[9] == 1 and got[20] == 1


def test_collision_curve():
    bands = bands_for()
    assert 1 - (1 - AT_SIMILARITY**BAND_ROWS) ** bands >= RECALL > 1 - (1 - AT_SIMILARITY**BAND_ROWS) ** (bands - 1)
    rng, met, tried = random.Random(3), 0, 0
    for _ in range(300):
        key = "".join(rng.choice("abcdefghijklmnop") for _ in range(11))
        at = rng.randrange(11)
        typo = key[:at] + rng.choice("qrstuv") + key[at + 1:]
        a, b = signature(key)[: bands * BAND_ROWS].reshape(bands, -1), signature(typo)[: bands * BAND_ROWS].reshape(bands, -1)
        tried += 1
        met += bool(np.any(np.all(a == b, axis=1)))
    assert met / tried >= 0.9


def test_parts():
    words = Vocabulary(REGISTER)
    assert words.parse("LABORATORIES (TUV VIMMBERG) G.m.b.H. #12")[:4] == ("tuvvimmberg", "", "laboratories", "gmbh")
    assert abbreviates("mfg", "manufacturing") and abbreviates("labs", "laboratories") and not abbreviates("mur", "manufacturing")
    assert damerau("abcd", "abdc") == 1 and damerau("a", "abcdef", 2) == 3
    assert monge_elkan(words.parse("Tuvvimmberg Foods"), words.parse("Tuvvimmberg Laboratories Co")) == 0


def test_far_misspellings_meet():
    # Keys with two swaps are accepted by their edits and must meet in some band.
    rng, met, bands = random.Random(5), 0, bands_for()
    for _ in range(400):
        key = "".join(rng.sample("abcdefghijklmnoprstuvw", 11))
        typo = key[1] + key[0] + key[2:7] + key[8] + key[7] + key[9:]
        a, b = (signature(k)[: bands * BAND_ROWS].reshape(bands, -1) for k in (key, typo))
        met += bool((a == b).all(axis=1).any())
    assert met >= 0.95 * 400
