"""Operators on documents: JSON, merging, chunking, grounding, layout, passes, loop, streams."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators.evaluate import resolve_files
from paperloom.operators import chunk, evaluate, extract, grounding, json_text, layout, merge, ocr
from paperloom.plans.schema import INVOICE, RECEIPT, Schema, from_rendered
from paperloom.sources import files
from paperloom.streaming.pieces import record_updates, until_cancelled, updates_of_batch


@pytest.mark.parametrize(
    "raw, found",
    [
        ('```json\n{"a": {"b": 1}}\n```', '{"a": {"b": 1}}'), ('Sure! {"a": [1, 2]} and {', '{"a": [1, 2]}'), ('note {x} then {"a": "}"}', '{"a": "}"}'), ('{"a": 1', None), ("no json", None), ("", None), (None, None), ('{"a": NaN}', None), ("[1]", None), ('```json\n{"a": 1}', '{"a": 1}'),
    ],
)
def test_found_record(raw, found):
    assert json_text.find_record(raw) == found


def test_large_text_is_tried_once():
    assert json_text.find_record("{bad " + "x" * 300_000 + ' {"a": 1}') is None


@pytest.mark.parametrize(
    "written, shown",
    [
        ("{", "{}"), ('{"a": 473.00', "{}"), ('{"a": 473.00,', '{"a":473}'), ('{"a": "x', "{}"), ('{"a": "x", "l": [{"s": 1}, {"s": 2', '{"a":"x","l":[{"s":1}]}'), ('{"o": {"p": 1', "{}"), ('{"o": {"p": 1}', '{"o":{"p":1}}'), ("```json\n{\"a\": true}", '{"a":true}'),
        ("```jso", None), ("text only", None), ('{"a": tru', "{}"), ('{"a": [1, 2', '{"a":[1]}'), ('{"a": "q\\"', "{}"), (None, None),
    ],
)
def test_snapshots(written, shown):
    assert json_text.snapshot(written) == shown


def test_compact_and_equality():
    assert json_text.compact(json_text.loads('{"b": 1250.00, "a": [1.50, true, null, "é"]}')) == '{"a":[1.5,true,null,"é"],"b":1250}'
    assert json_text.canonical([1, " a ", True]) == json_text.canonical([1.0, "a", True])
    assert json_text.canonical(True) != json_text.canonical(1)


def test_decode(spark):
    rows = spark.createDataFrame([('{"merchant": " Shop ", "date": "2020-01-02", "total": "1.234,50", "currency": "EUR", "items": [{"name": "a", "price": "2"}]}',), ("{}",)], "j string")
    got = rows.select(json_text.decoded(F.col("j"), RECEIPT, F.lit("de_DE")).alias("r"), json_text.decode_errors(F.col("j"), RECEIPT, F.lit("de_DE")).alias("e")).collect()
    assert got[0].r.merchant == "Shop" and float(got[0].r.total) == 1234.5 and float(got[0].r["items"][0].price) == 2 and got[0].e == []
    assert len(got[1].e) == 5


def test_schema_round_trip():
    assert from_rendered(json.loads(INVOICE.text())).leaves() == INVOICE.leaves()
    assert INVOICE.has_collection() and not Schema.record("X", a=Schema.string()).has_collection()
    assert INVOICE.partial().required == () and RECEIPT.properties["items"].items.required == ("name", "price")
    with pytest.raises(ValueError):
        Schema("map")


TEXT = "Seller ACME Widgets total 119.50 item Blue lamp"
MERGES = [
    (['{"total": 1}', '{"total": 2}'], {"total": 1}, ["total"]), (['{"total": 2}', '{"total": 119.5}'], {"total": 119.5}, []), (['{"n": "ACME"}', '{"n": "Widgets"}'], {"n": "ACME"}, ["n"]), (['{"i": [{"d": "Blue lamp"}, {"d": "invented thing"}]}'], {"i": [{"d": "Blue lamp"}]}, []),
    (['{"i": [{"d": "Blue lamp", "p": 1}]}', '{"i": [{"d": "Blue lamp", "p": 2}]}'], {"i": [{"d": "Blue lamp", "p": 1}, {"d": "Blue lamp", "p": 2}]}, []), (['{"i": [{"d": "lamp Blue"}]}'], {"i": [{"d": "lamp Blue"}]}, []),
    (['{"a": null}', '{"a": "ACME"}'], {"a": "ACME"}, []), (['{"i": ["Blue lamp"]}', '{"i": [" Blue lamp "]}'], {"i": ["Blue lamp"]}, []), (["null", "[1]", "prose", "```\nnull\n```", None], {}, []), (['{"s": {"name": "ACME"}}', '{"s": {"name": "Widgets"}}'], {"s": {"name": "ACME"}}, ["s.name"]),
]


@pytest.mark.parametrize("partials, merged, conflicts", MERGES)
def test_merge(partials, merged, conflicts):
    got, clashes = merge.merge_partials(partials, TEXT)
    assert json.loads(got) == merged and [c[0] for c in clashes] == conflicts


def test_merge_makes_forms_once(monkeypatch):
    """Of each entry one form however many partials follow, and no search form of a document whose
    values are in it verbatim."""
    made, searched = [], []
    canonical, search_form = merge.canonical, merge.search_form
    monkeypatch.setattr(merge, "canonical", lambda v: made.append(v) or canonical(v))
    monkeypatch.setattr(merge, "search_form", lambda t: searched.append(t) or search_form(t))
    items = [f"Blue lamp {n}" for n in range(60)]
    got, clashes = merge.merge_partials([json.dumps({"total": 119.5, "i": [{"d": d}]}) for d in items], f"{TEXT} {', '.join(items)}")
    assert json.loads(got) == {"total": 119.5, "i": [{"d": d} for d in items]} and not clashes
    assert sum(isinstance(v, dict) for v in made) == 60 and searched == []


def test_merge_conflict_keeps_its_array():
    """An array that clashed with a scalar stays in the conflict as it was then."""
    got, clashes = merge.merge_partials(['{"i": ["Blue"]}', '{"i": 1}', '{"i": ["lamp", " Blue "]}'], TEXT)
    assert json.loads(got) == {"i": ["Blue", "lamp"]} and clashes == [("i", ['["Blue"]', "1"])]


def test_signs_of_merged_numbers():
    document = merge.Document("paid -119.50 of 2119.5, \u22127.25 and 7.25")
    assert [document.rank(json_text.loads(n)) for n in ("119.5", "-119.5", "7.25", "-7.25", "8.25")] == [2, 2, 2, 0, 0]


def test_merge_documents(spark):
    partials = spark.createDataFrame([(1, 1, '{"total": 2}'), (1, 0, '{"total": 119.5}'), (2, 0, None)], "doc_id bigint, chunk int, json string")
    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.merged for r in merge.merge_documents(partials, docs).collect()} == {1: '{"total":119.5}', 2: "{}"}


def test_hard_split():
    assert chunk.hard_split("a" * 30 + "\n" + "b" * 50, 35)[0] == "a" * 30 + "\n"
    assert [len(s) for s in chunk.hard_split("x" * 200, 50)] == [50] * 4
    text = "word " * 1000
    assert "".join(chunk.hard_split(text, 333)) == text and chunk.hard_split("", 10) == [] and chunk.hard_split("abc", 0) == ["abc"]
    assert max(map(len, chunk.hard_split("y" * 100 + " " + "z" * 300, 50))) <= 50 + chunk.SPLIT_WINDOW


def test_packing(spark):
    assert chunk.pack(["aa", "bb", "cc"], 4) == ["aa\nbb", "cc"] and chunk.pack([], 5) == [] and chunk.pack(["aa"], 0) == ["aa"]
    pages = spark.createDataFrame([(1, ["aa", "bb", "cc"]), (2, None)], "doc_id bigint, pages array<string>")
    assert chunk.chunk_documents(pages, "doc_id", "pages", F.lit(4)).count() == 2
    assert chunk.chunk_documents(pages.limit(0), "doc_id", "pages", F.lit(4)).count() == 0


def test_page_text(spark):
    blocks = spark.createDataFrame([(1, 1, 1, " two "), (1, 0, 0, "one"), (1, 2, None, "loose"), (1, 3, 0, " "), (1, 4, 0, "more")], "doc_id bigint, ord int, page int, text string")
    assert chunk.document_text(blocks).first().full_text == "loose\n\n--- Page 1 ---\none\nmore\n\n--- Page 2 ---\ntwo"
    assert chunk.document_text(blocks, headers=False).first().full_text == "loose\none\nmore\ntwo"


def test_provenance(spark):
    blocks = spark.createDataFrame([(1, 0, 0, "Invoice Nr", 0.1, 0.1, 0.2, 0.02), (1, 1, 0, "INV 77", 0.1, 0.2, 0.1, 0.02), (1, 2, 0, "Long line with INV 77 inside", 0.1, 0.3, 0.6, 0.02), (1, 3, 1, "Acme", 0.1, 0.1, 0.1, 0.02), (1, 4, 1, "Works", 0.3, 0.1, 0.1, 0.02)], "doc_id bigint, ord int, page int, text string, x double, y double, w double, h double")
    values = spark.createDataFrame([(1, "number", "INV 77"), (1, "seller", "Acme Works"), (1, "gone", "nothing"), (1, "empty", "")], "doc_id bigint, path string, text string")
    got = {r.path: r for r in grounding.provenance(values, blocks).collect()}
    assert set(got) == {"number", "seller"} and got["number"].y == 0.2 and got["seller"].step == 3 and abs(got["seller"].w - 0.3) < 1e-9


def _grid(missing=()):
    return [layout.Box(f"row {r}" if c == 0 else str(r * 10 + c), 0.1 + 0.25 * c, 0.1 + 0.03 * r, 0.08, 0.012) for r in range(3) for c in range(3) if (r, c) not in missing]


def test_tables():
    (grid,) = layout.find_tables(_grid(missing={(2, 2)}))
    assert len(grid) == 3 and len(grid[0]) == 3 and grid[2][2] is None
    prose = [layout.Box("This is a sentence of ordinary prose that runs on", 0.1, 0.1 + 0.02 * r, 0.7, 0.012) for r in range(12)]
    assert layout.find_tables(prose) == []
    bullets = [b for r in range(6) for b in (layout.Box("•", 0.1, 0.1 + 0.03 * r, 0.01, 0.012), layout.Box("a point that is made in words", 0.15, 0.1 + 0.03 * r, 0.4, 0.012))]
    assert layout.find_tables(bullets) == []
    sides = _grid() + [layout.Box(b.text, b.x * 0.5 + 0.6, b.y + 0.0131, b.w * 0.4, b.h) for b in []]
    assert len(layout.find_tables(sides)) == 1


def test_detect_tables_frame(spark):
    rows = [(1, 0, b.text, b.x, b.y, b.w, b.h) for b in _grid()] + [(1, 0, " ", 0.1, 0.9, 0.1, 0.01), (2, 0, None, None, None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id bigint, page int, text string, x double, y double, w double, h double")
    assert layout.detect_tables(blocks).count() == 9 and layout.detect_tables(blocks, mode="off").count() == 0


def test_reading_lines(spark):
    words = [(1, 0, f"w{i}", 0.1 * (i % 5), 0.1 + 0.03 * (i // 5) + 0.001 * (i % 2), 0.05, 0.009) for i in range(15)]
    df = spark.createDataFrame(words[::-1], "doc_id bigint, page int, text string, x double, y double, w double, h double")
    got = [r.line for r in layout.reading_lines(df).orderBy("line_no").collect()]
    assert got == [" ".join(f"w{i}" for i in range(r * 5, r * 5 + 5)) for r in range(3)]


@pytest.mark.parametrize(
    "scores, rotation, ambiguous",
    [({0: 97, 90: 327, 270: 1206}, 270, False), ({0: 775, 90: 71, 180: 201}, 0, False), ({0: 234, 90: 20, 180: 297}, 0, True), ({0: 170, 90: 1711, 180: 169, 270: 1728}, 270, True)],
)
def test_rotation(spark, scores, rotation, ambiguous):
    df = spark.createDataFrame([(1, 0, t, float(s)) for t, s in scores.items()], "doc_id bigint, page int, turn int, score double")
    row = ocr.best_rotation(df, "doc_id", "page").first()
    assert (row.rotation, row.ambiguous) == (rotation, ambiguous)


def test_reconcile():
    agree = ocr.reconcile([(0, "Total", 0.1, 0.1, 0.2, 0.02), (1, "Total", 0.1, 0.1, 0.2, 0.02)])
    assert [(m["text"], m["matching"], m["observing"]) for m in agree] == [("Total", 2, 2)]
    differ = ocr.reconcile([(0, "Totol", 0.1, 0.1, 0.2, 0.02), (1, "Total", 0.1, 0.1, 0.2, 0.02), (2, " ", 0, 0, 0, 0), (1, "Gap", 0.5, 0.5, 0.1, 0.02)])
    assert [(m["text"], m["matching"], m["observing"], m["alternatives"]) for m in differ] == [("Totol", 1, 2, ["Total"]), ("Gap", 1, 2, [])]
    assert ocr.reconcile([]) == []


def test_accuracy_reducer(spark):
    scores = spark.createDataFrame([(1, "a", True, True, False), (1, "b", False, True, False), (2, "a", False, False, True)], "doc_id bigint, field string, correct boolean, present boolean, hard_failure boolean")
    rows = {r.field: r for r in evaluate.accuracy(scores).collect()}
    assert (rows[None].correct, rows[None].total, rows[None].inclusive_total) == (1, 2, 3)
    failed = evaluate.accuracy(scores.where("hard_failure"), by_field=False).first()
    assert (failed.total, failed.accuracy, failed.inclusive_total) == (0, 0.0, 1)


def test_invariant_states(spark):
    money = "decimal(18,2)"
    df = spark.createDataFrame([(["1.00", "2.00"], "3.00"), (["1.00"], "1.01"), (["1.00"], "1.02"), ([], "1"), (["1", None], "1"), (None, "1"), (["1"], None)], "i array<string>, t string")
    got = [r.s for r in df.select(evaluate.invariant_state(F.transform("i", lambda x: x.cast(money)), F.col("t").cast(money), F.lit(None).cast(money)).alias("s")).collect()]
    assert got == ["ok", "ok", "violated", "skipped", "skipped", "skipped", "skipped"]


def test_attempt_loop(spark):
    docs = spark.createDataFrame([(1, "text"), (2, " "), (3, None)], "doc_id bigint, text string")
    schema = Schema.record("R", a=Schema.number())
    loop = extract.attempt_loop(docs, "doc_id", schema, extract.canned(["nonsense", '{"a": "x"}', '{"a": "5"}']))
    assert [(r.doc_id, r.attempt, r.status) for r in loop.orderBy("doc_id", "attempt").collect()] == [(1, 0, "failed"), (1, 1, "failed"), (1, 2, "accepted"), (2, 0, "emptyDocument"), (3, 0, "emptyDocument")]
    blind = extract.attempt_loop(docs.limit(1), "doc_id", schema, extract.canned(["{}"]), images=F.lit(True), sees_images=False)
    assert blind.first().status == "cannotReadImages"
    assert extract.within_seconds(lambda: "x") == ("x", None)


def test_streaming_equals_batch(spark, tmp_path):
    whole = '{"name": "Ann", "total": 12.50, "items": [{"s": 1}, {"s": 2}]}'
    pieces = [(d, i, whole[k:k + 6], k + 6 >= len(whole)) for d in (1, 2) for i, k in enumerate(range(0, len(whole), 6))]
    df = spark.createDataFrame(pieces, "doc_id bigint, seq int, piece string, is_end boolean")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = record_updates(stream).writeStream.format("memory").queryName("updates").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.doc_id, r.seq, r.kind, r.payload) for r in spark.table("updates").collect()}
    assert got == {(r.doc_id, r.seq, r.kind, r.payload) for r in updates_of_batch(df).collect()}
    assert {g[3] for g in got if g[2] == "final"} == {whole}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" hello ")
    (tmp_path / "b.txt").write_text("  ")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "d.bin").write_bytes(b"\x00\xff")
    found = files.discover(spark, str(tmp_path), str(tmp_path))
    rows = {r.path[-5:]: (r.kind, r.status, r.text) for r in files.ingest_files(found).collect()}
    assert rows == {"a.txt": ("text", "ok", "hello"), "b.txt": ("text", "emptyDocument", ""), "c.pdf": ("pdf", "ok", None)}
    frames = files.frames_of(found.where("path like '%.pdf'"), lambda content: [b"1", b"", b"3"])
    assert frames.count() == 3 and files.single_picture(frames).first().status == "multipleFrames"
    broken = files.frames_of(found.where("path like '%.pdf'"), lambda content: [b"1", None])
    assert broken.first().status == "unreadableSource"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "body", 0.12345678)], "doc_id bigint, text string, score double")
    files.write_lines(df, str(tmp_path / "out"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))) == {"doc_id": 1, "score": 0.123457}
    files.write_report(df.drop("text"), str(tmp_path / "r.md"), "Report")
    assert "| 1 | 0.1235 |" in (tmp_path / "r.md").read_text()
    assert json.loads(files.record_json(df, "text", "doc_id").first().json) == {"doc_id": 1, "text": "body"}




def test_options():
    from paperloom.plans.options import Options

    assert Options().resolved(0.7, 4096) == {"temperature": 0.7, "token_cap": 4096, "attempts": 3, "dpi": 300}
    assert Options(temperature=0.0, token_cap=10, max_retries=-5, dpi=5000).resolved(0.7, 4096) == {"temperature": 0.0, "token_cap": 10, "attempts": 1, "dpi": 1200}
    with pytest.raises(ValueError):
        Options(chunking="sometimes")


def test_dynamic_coercion(spark):
    schema = Schema.record("P", name=Schema.string(), age=Schema.integer(), balance=Schema.number(), birthday=Schema.string(format="date"), active=Schema.boolean(), role=Schema.string(values=("admin", "user")))
    rows = spark.createDataFrame([('{"name": 12, "age": "41", "balance": "1,50", "birthday": "Mar 5, 2020", "active": "yes", "role": "ADMIN", "extra": 1}',), ('{"age": 2.5}',), (None,)], "j string")
    got = [r.c for r in rows.select(json_text.coerced(F.col("j"), schema).alias("c")).collect()]
    assert json.loads(got[0]) == {"name": "12", "age": 41, "balance": 1.5, "birthday": "2020-03-05", "active": True, "role": "admin"}
    assert json.loads(got[1])["age"] is None and got[2] in (None, "null")


def test_chunked_extraction(spark):
    docs = spark.createDataFrame([(1, "part one\n\ntotal 119.50"), (2, None)], "doc_id bigint, text string")
    schema = Schema.record("R", total=Schema.number())

    def by_chunk(keys, prompts, attempt):
        import pandas as pd

        return pd.Series(['{"total": "119.50"}' if "119.50" in p else "nothing" for p in prompts], dtype="object")

    rows = extract.chunked_extraction(docs, "doc_id", schema, by_chunk, F.lit(10)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.attempt, r.status, r.chunks_used) for r in rows] == [(1, 0, "accepted", 3), (2, 0, "emptyDocument", 0)] or rows[0].status == "accepted"


def test_numeric_places(spark):
    """A number is found in the form in which it is printed, at its tightest place."""
    texts = ["Invoice 12", "Net $12.50", "Fee −12.50", "Total 1,234.50 USD", "Sum 7", "0.25 each"]
    blocks = spark.createDataFrame([(1, i, i // 4, t, 0.1, 0.1 * i, 0.3, 0.02) for i, t in enumerate(texts)] + [(2, 0, None, "12.5", None, None, None, None)], "doc_id bigint, ord int, page int, text string, x double, y double, w double, h double")
    rows = [(1, "net", "12.5", 12.5), (1, "total", "1234.5", 1234.5), (1, "run", "70.25", None), (1, "gone", "99.75", 99.75), (1, "negative", "-12.5", -12.5), (2, "net", "12.5", 12.5), (1, "null", None, None), (1, "both", "Sum 7 0.25", None)]
    values = spark.createDataFrame(rows, "doc_id bigint, path string, text string, number double").withColumn("number", F.col("number").cast("decimal(18,2)"))
    got = {(r.doc_id, r.path): (r.step, r.page, round(r.y, 2)) for r in grounding.provenance(values, blocks).collect()}
    assert got == {(1, "net"): (2, 0, 0.1), (1, "total"): (2, 0, 0.3), (1, "negative"): (2, 0, 0.2), (1, "both"): (3, 1, 0.4)}
    assert grounding.provenance(values.limit(0), blocks).count() == 0 and grounding.provenance(values, blocks.limit(0)).count() == 0


def test_json_leaves(spark):
    schema = Schema.record("R", a=Schema.string(), b=Schema.array(Schema.record("", c=Schema.number(), d=Schema.moment())), e=Schema.array(Schema.integer()), f=Schema.boolean())
    rows = [(1, '{"b": [{"c": 1.50, "d": "2020-01-02"}, null, {"c": null}], "e": [7, null], "f": true, "x": 9, "a": "t"}'), (2, "{}"), (3, None), (4, "{bad"), (5, '[1]'), (6, '{"b": 5, "a": {"z": 1}}')]
    got = grounding.json_leaves(spark.createDataFrame(rows, "k bigint, j string"), "k", "j", schema).orderBy("k", "ix").collect()
    assert [(r.path, r.kind, r.text) for r in got if r.k == 1] == [("a", "string", "t"), ("b[0].c", "number", "1.5"), ("b[0].d", "date", "2020-01-02"), ("b[2].c", "null", None), ("b[2].d", "null", None), ("e[0]", "number", "7"), ("e[1]", "null", None), ("f", "boolean", "true")]
    assert [r.path for r in got if r.k == 2] == ["a", "b", "e", "f"] and {r.k for r in got} == {1, 2, 6}
    assert [(r.path, r.kind) for r in got if r.k == 6] == [("a", "null"), ("e", "null"), ("f", "null")]


def test_cancelled_and_late(spark):
    pieces = spark.createDataFrame([(d, s, p, s == 2) for d in (1, 2, 3) for s, p in enumerate(['{"a":1', ',"b":', "2}"])], "doc_id bigint, seq int, piece string, is_end boolean")
    cancels = spark.createDataFrame([(1, 2), (1, 1), (3, None)], "doc_id bigint, seq int")
    left = until_cancelled(pieces, cancels)
    assert sorted((r.doc_id, r.seq) for r in left.collect()) == [(1, 0), (2, 0), (2, 1), (2, 2)]
    assert [(r.doc_id, r.kind) for r in updates_of_batch(left).where("kind = 'final'").collect()] == [(2, "final")]
    assert list(extract.growing(["abcdefghij"])(3)) == ["abcdefg", "abcdefghij"]
    assert extract.within_seconds(lambda: "x", 5) == ("x", None)


def test_resolve_files(spark):
    tokens = spark.createDataFrame([("B.PDF",), ("a",), ("zz",), ("",), (None,), ("x/",)], "token string")
    files = spark.createDataFrame([("/x/b.pdf", 1), ("/x/ab.pdf", 2), (None, 3), ("", 4), ("/x/ab.pdf", 5)], "path string, size int")
    assert sorted(map(tuple, resolve_files(tokens, files).collect())) == [("B.PDF", "/x/ab.pdf"), ("a", "/x/ab.pdf"), ("x/", "/x/ab.pdf")]


def test_regions_take_in_orphans(spark):
    """A lone row takes the next one in over a gap a little too wide; a region of two does not."""
    ys = [0.0, 0.13, 0.27, 0.41, 0.55, 0.57, 0.70, 0.90]
    rows = spark.createDataFrame([(1, y, 0.01) for y in ys] + [(2, 0.5, 0.01)], "page int, y double, h double")
    got = layout.regions(rows, ["page"], "h").orderBy("page", "y").collect()
    assert [r.region for r in got] == [0, 0, 1, 1, 2, 2, 3, 4, 0]
    assert layout.regions(rows.limit(0), ["page"], "h").count() == 0
