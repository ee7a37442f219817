"""Personal information: held-out mentions, exact redaction, hostile rows."""

import random

from pyspark.sql import functions as F

from paperloom.llm.personal import candidates, find_personal, mask_of, redact

GIVEN, FAMILY = ["Anna", "Oskar", "Noor", "Zofia", "Pavel", "Ilse"], ["Vessham", "Tarnoe", "Quarley", "Darvik", "Holvarte", "Imrello", "Bexlin", "Mardoux"]


def corpus(n=120):
    rng = random.Random(9)
    rows, truth = [], []
    for i in range(n):
        name = f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}"
        phone = rng.choice([f"+44 1632 96{rng.randrange(1000, 9999)}", f"(415) 555-{rng.randrange(1000, 9999)}", f"0{rng.randrange(10, 99)}/23125-{rng.randrange(100, 999)}"])
        number = rng.choice([f"K{rng.randrange(10**7, 10**8)}", f"9{rng.randrange(10, 99)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"])
        street = f"{rng.randrange(1, 99)} Millgate Street, Apt {rng.randrange(1, 9)}, Pennywick, ZZ {rng.randrange(10000, 99999)}"
        text = f"The parcel was signed for by {name} at\n{street}. Order 955-020-{rng.randrange(1000, 9999)} was closed. Call {phone} after six.\nIdentity verified against {number} on the day.\nWrite to {name.split()[0].lower()}.x@example.com today. The Northern Terminal is open."
        rows.append((i, text, "clash"))
        truth += [(i, "person", name), (i, "phone", phone), (i, "id_number", number), (i, "address", street), (i, "email", f"{name.split()[0].lower()}.x@example.com")]
    return rows, truth


def test_found(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows + [(500, None, ""), (501, "", ""), (None, rows[0][1], "")], "inspection_id bigint, full_text string, kind string")
    names = spark.createDataFrame([(f"{g} {f}",) for g in GIVEN for f in FAMILY[:5]] + [(None,)], "seed string")
    numbers = spark.createDataFrame([(t[2],) for t in truth if t[1] == "id_number"][::2] + [("",)], "seed string")
    mentions = find_personal(df, "inspection_id", "full_text", names, numbers)
    got = {tuple(r) for r in mentions.select("id", "pii_kind", "surface").distinct().collect()}
    want = set(truth)
    assert len(got & want) >= 0.95 * len(want), sorted(want - got)[:10]
    assert len(got - want) <= 0.02 * len(got), sorted(got - want)[:10]
    whole = {r.inspection_id: r.redacted for r in redact(df.where("inspection_id is not null"), "inspection_id", "full_text", mentions).collect()}
    assert whole[500] is None and whole[501] == "" and "[PERSON]" in whole[0] and "was closed. Call [PHONE] after six." in whole[0]


def test_redaction_is_exact(spark):
    df = spark.createDataFrame([(1, "aé🙂 Bob, x"), (2, "none")], "id bigint, t string")
    spans = spark.createDataFrame([(1, "person", 4, 7), (1, "person", 5, 7)], "id bigint, pii_kind string, begin int, end int")
    assert {r.id: r.redacted for r in redact(df, "id", "t", spans).collect()} == {1: "aé🙂 [PERSON], x", 2: "none"}


def test_grammars_and_empty(spark):
    found = {(k, "Mr DOE, Jane M. at 5 Elm Lane, Town TO12 8QX; x [at] post [dot] example"[a:b]) for k, a, b in candidates("Mr DOE, Jane M. at 5 Elm Lane, Town TO12 8QX; x [at] post [dot] example", {})}
    assert {("person", "DOE, Jane M."), ("address", "5 Elm Lane, Town TO12 8QX"), ("email", "x [at] post [dot] example")} <= found
    assert mask_of("id_number", "L4N72XY9Z") == "mix9" and mask_of("phone", "+1 22") == "+9 99"
    empty = spark.createDataFrame([], "inspection_id bigint, full_text string")
    seeds = spark.createDataFrame([], "seed string")
    assert find_personal(empty, "inspection_id", "full_text", seeds, seeds).count() == 0
    assert list(candidates("x" * 100_000, {})) == [] and F is not None
