"""Repair of scanned text on a small corpus with known noise."""

import random

from paperloom.llm.queries import p4_found
from paperloom.llm.scans import Decoder, count_lexicon, fold, furniture, page_number, repair, repaired, repairs

SENTENCES = ["The committee considered the comments and recommended approval of the programme.", "The ventilation ducts were cleaned thoroughly and the filters exchanged.", "An up-to-date inspection certificate is included for the control cabinet.", "Transport insurance was arranged by the forwarding department."]


def corpus(n=60):
    rng = random.Random(8)
    return [(i, "\n".join(" ".join(rng.choice(SENTENCES) for _ in range(3)) for _ in range(4)), "x") for i in range(n)]


def noise_of(text, lexicon):
    return set(repair(text, Decoder(lexicon))[1])


def test_noise(spark):
    df = spark.createDataFrame(corpus(), "inspection_id bigint, full_text string, line_no string")
    lexicon = count_lexicon(df, "full_text")
    assert noise_of("The committee considcred the\ncomments and recom-\nmended approval.", lexicon) == {(0, "misread"), (1, "hyphen")}
    assert noise_of("An up-\nto-date inspection certificate", lexicon) == set()
    assert noise_of("the filters ex¬\nchanged and\nthe year 2O19 and 12.5", lexicon) == {(0, "hyphen"), (2, "misread")}
    assert noise_of("cable B52  1 x 105.83\ninvoice for S12 items", lexicon) == set()
    assert noise_of("write to c0mments@example.com or www.c0mmittee.example", lexicon) == set()
    paged = "\n".join(["Acme Works - Annual Survey", "The committee considered the comm-", "Seite 1", "Acme W0rks - Annual Survey", "", "ents and recommended approval.", "Seite 2", "Acme Works - Annual Survey 3", "The filters were cleaned.", "Seite 3"])
    assert noise_of(paged, lexicon) == {(0, "running"), (1, "hyphen"), (2, "page_number"), (3, "running"), (6, "page_number"), (7, "running"), (9, "page_number")}
    paragraphs = repair(paged, Decoder(lexicon))[0]
    assert paragraphs[0].startswith("The committee considered the comments and recommended approval.")
    assert repair("", Decoder(lexicon)) == ([], []) and repair("\n \n", Decoder(lexicon))[1] == []
    assert repair("word " * 20_000, Decoder(lexicon))[1] == [] and repair("only", Decoder({}))[1] == []


def test_page_numbers():
    assert page_number("— 106 —") == ("—", 106) and page_number("Page 4 of 10")[1] == 4 and page_number("l/9")[1] == 1 and page_number("[12]")[1] == 12 and page_number("５")[1] == 5
    assert page_number("Total 1717.06") is None and page_number("(00441632960656).") is None and page_number("") is None
    assert furniture(["a 1 x 2", "607", "Total 5", "text that goes on", "1"]) == {4: "page_number"}
    assert fold("Terms of Carriage") == fold("Tcrms of Carriaqe")


def test_frames(spark):
    rows = corpus(20) + [(100, None, "x"), (101, "", "x"), (None, "text", "x")] + corpus(1)
    df = spark.createDataFrame(rows, "inspection_id bigint, full_text string, noise string")
    lexicon = count_lexicon(df, "full_text")
    assert repairs(df, "inspection_id", "full_text", lexicon).where("inspection_id >= 100").count() == 0
    assert repaired(df, "inspection_id", "full_text", lexicon).select("inspection_id").distinct().count() == 20
    assert repairs(df.limit(0), "inspection_id", "full_text", count_lexicon(df.limit(0), "full_text")).count() == 0


def found_in(spark, path, texts):
    spark.createDataFrame(texts, "inspection_id bigint, full_text string").repartition(4).write.parquet(f"{path}/inspections.parquet")
    return {(r.inspection_id, r.noise) for r in p4_found(spark, str(path)).collect()}


def test_margin_compares_true_counts(spark, tmp_path):
    # Among over a million words 'tines' stands twice: 'fines', seen 20 times, is not 15 times commoner.
    filler = [(n, "word " * 44_000) for n in range(25)]
    texts = filler + [(100 + n, "these are fines here") for n in range(20)] + [(200 + n, "these are tines here") for n in range(2)]
    assert found_in(spark, tmp_path, texts) == set()


def test_redelivered_text_counts_once(spark, tmp_path):
    # Delivered ten times, the misreading would be too common to be one of 'considered'.
    texts = [(n, "they considered it again") for n in range(60)] + [(100, "they considcred it again")] * 10
    assert found_in(spark, tmp_path, texts) == {(100, "misread")}
