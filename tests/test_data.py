"""Nested records and timestamps: brute force, edge cases, hostile tables."""

import datetime as dt
import json
import random
import time
import zoneinfo

import pytest
from pyspark.sql import functions as F

from paperloom.operators.nested import NODES, explode_items, flatten_payloads, shred
from paperloom.operators.timestamps import to_moments
from paperloom.tables import delivered_once


def elements(texts):
    """What shred() finds, as tuples (text, node, parent, child)."""
    return [x for r in shred([t.encode() for t in texts]) for x in zip(r.text.tolist(), [r.node] * len(r.text), r.parent.tolist(), r.child.tolist())]


def has_arrays(record):
    inside = lambda x, *names: isinstance(x, dict) and any(isinstance(x.get(n), (list, dict, str)) for n in names)
    return inside(record.get("value"), "items", "lineItems") or inside(record.get("signals"), "fields", "mergeConflicts") or inside(record, "tables")


def brute(text):
    decoder, record, i = json.JSONDecoder(), None, 0
    while (i := text.find("{", i)) >= 0:
        try:
            made, end = decoder.raw_decode(text, i)
        except ValueError:
            i += 1
            continue
        if has_arrays(made):
            record = made
            break
        i = end
    out = []

    def array(value):
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                return []
            return value if isinstance(value, list) else []
        return [value] if isinstance(value, dict) else value if isinstance(value, list) else []

    def emit(node, value, parent, below=None):
        for i, x in enumerate(array(value)):
            if x is not None:
                out.append((node, parent, i))
                if below and isinstance(x, dict):
                    emit(f"{node}.{below}", x.get(below), i)

    if isinstance(record, dict):
        value, signals = record.get("value"), record.get("signals")
        if isinstance(value, dict):
            emit("value.lineItems", value.get("lineItems"), -1)
            emit("value.items", value.get("items"), -1)
        if isinstance(signals, dict):
            emit("signals.fields", signals.get("fields"), -1)
            emit("signals.mergeConflicts", signals.get("mergeConflicts"), -1, "values")
        emit("tables", record.get("tables"), -1, "cells")
    return sorted(out)


def _random(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind == 0:
        return None
    if kind == 1:
        return rng.choice([True, False, 0, -1.5, 1e9])
    if kind in (2, 3, 4):
        return rng.choice(["", "a", 'q"q', "b\\", "{[", "}]", "\\\"", "é\n\t", ",:", "[1]"])
    if kind in (5, 6):
        return [_random(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["path", "values", "cells", "x"]): _random(rng, depth + 1) for _ in range(rng.randrange(3))}


def test_shred_against_brute_force():
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        record = {"value": {"items": _random(rng), "lineItems": [_random(rng) for _ in range(3)]}, "signals": {"fields": _random(rng), "mergeConflicts": [{"values": _random(rng)}, None, _random(rng)]}, "tables": [{"cells": [_random(rng), None]}]}
        if rng.random() < 0.3:
            record["tables"] = json.dumps(record["tables"])
        text = json.dumps(record, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        text = rng.choice(["", "Here: ", "```json\n", 'a 5" display: ', "see {} : ", 'it is {"x" or so} ', '{"a": 1} "then" ', "set {1, 2} of {", 'a "{" and ', '{"n": {"value": 3}} ']) + text + rng.choice(["", "\nDone.", " }", ' 5" {"'])
        texts.append(text if rng.random() < 0.8 else text[: rng.randrange(len(text))])
    got = {}
    for t, node, parent, child in elements(texts):
        got.setdefault(t, []).append((node, parent, child))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == brute(text), text


@pytest.mark.parametrize("text", ["", "{}", "[]", "null", '{"value":{"items":[1,]}}', '{"value":{"items":[1 2]}}', '{"value" {"items":[1]}}', '{"value":{"items":[01]}}', '{"value":{"items":[NaN]}}', '{"value":{"items":[1]}', '"', "{", "}{"])
def test_broken_payloads(text):
    assert elements([text]) == []


RECORD = '{"value":{"items":[{"a":1},null,{"a":2}]}}'


@pytest.mark.parametrize("lead", ["", 'a 5" display: ', "see {} : ", 'it is {"x" or so} ', '{"a":[1,2]} ', '{"a":{"value":{"x":1}} so ', "{" * 50, '"{', '{"b', '{"n":{"items":[{"c":5}]}} ' * 3])
def test_record_in_prose(lead):
    assert elements([lead + RECORD + " }"]) == [(0, "value.items", -1, 0), (0, "value.items", -1, 2)] or lead == '{"b'


@pytest.mark.parametrize("lead", ['{"result": ', '{"a": 1, "b": [', '{"c": "'])
def test_record_cut_off(lead):
    """An object that is cut off at the end of its payload is no complete one, nor what it holds."""
    assert elements([lead + (RECORD if lead[-1] != '"' else RECORD.replace('"', "'"))]) == []


def test_many_braces():
    """Neither stray openers nor broken records with many objects are searched over and over."""
    began = time.time()
    texts = ["{" * 200_000 + RECORD, '{"' * 100_000, '{"a":' * 50_000 + "oops", '{"b": [' + '{"value": 1},' * 20_000 + " oops " + RECORD]
    assert sorted(elements(texts)) == [(t, "value.items", -1, i) for t in (0, 3) for i in (0, 2)]
    assert time.time() - began < 30


def test_element_texts(spark):
    df = spark.createDataFrame([(1, 'x {"value":{"items":[{"ä":"é\\n"}, 5, "{"]},"tables":"[{\\"cells\\":[[1]]}]"}')], "record_id bigint, payload string")
    got = {(r.node, r.parent_ix, r.child_ix): r.element for r in flatten_payloads(df, "record_id", "payload").collect()}
    assert got == {("value.items", -1, 0): '{"ä":"é\\n"}', ("value.items", -1, 1): "5", ("value.items", -1, 2): '"{"', ("tables", -1, 0): '{"cells":[[1]]}', ("tables.cells", 0, 0): "[1]"}


def test_flatten_hostile_table(spark):
    rows = [(1, '{"value": {"items": [1, null]}}', "x"), (1, '{"value": {"items": [1, null]}}', "x"), (2, None, "y"), (None, '{"tables": [{}]}', "z"), (3, "", "w"), (4, "{" * 2000, "v"), (5, '{"value": {"items": [' + ",".join(["1"] * 20000) + "]}}", "u")]
    df = spark.createDataFrame(rows, "record_id bigint, payload string, node string")
    got = flatten_payloads(delivered_once(df, "record_id", "payload"), "record_id", "payload")
    assert got.groupBy("record_id").count().orderBy("record_id").collect() == [(1, 1), (5, 20000)]
    assert flatten_payloads(df.limit(0), "record_id", "payload").count() == 0
    assert flatten_payloads(df.where("record_id is null"), "record_id", "payload", NODES).select("node", "parent_ix", "child_ix").collect() == [("tables", -1, 0)]


def test_explode_items(spark):
    df = spark.createDataFrame([(1, [("a", 1), None, ("b", None)]), (2, []), (3, None)], "id bigint, items array<struct<name string, n int>>")
    assert [tuple(r) for r in explode_items(df, "id", "items").collect()] == [(1, 0, "a", 1), (1, 2, "b", None)]


UTC = dt.timezone.utc


def at(*parts, zone=None):
    return int(dt.datetime(*parts, tzinfo=zoneinfo.ZoneInfo(zone) if zone else UTC).timestamp())


CASES = [
    ("2024-01-12T22:15:53.908Z", "en_GB", "Europe/London", at(2024, 1, 12, 22, 15, 53), "absolute"), ("6. Dezember 2019 23:34", "de_DE", "Europe/Berlin", at(2019, 12, 6, 23, 34, zone="Europe/Berlin"), "exact"), ("15/03/21 02:42", "es_ES", "Europe/Madrid", at(2021, 3, 15, 2, 42, zone="Europe/Madrid"), "exact"),
    ("2023-07-07 19:01:47 JST", "en_GB", "Europe/London", at(2023, 7, 7, 10, 1, 47), "absolute"), ("1628686760", "fr_FR", None, 1628686760, "absolute"), ("1697275720118", "de_DE", None, 1697275720, "absolute"), ("20200508T065835Z", None, None, at(2020, 5, 8, 6, 58, 35), "absolute"), ("20200508", None, None, at(2020, 5, 8), "absolute"),
    ("2023年3月18日 13:23", "ja_JP", "Asia/Tokyo", at(2023, 3, 18, 13, 23, zone="Asia/Tokyo"), "exact"), ("11 de noviembre de 2019", "es_ES", "Europe/Madrid", at(2019, 11, 11), "absolute"), ("14 MAI 2019", "fr_FR", None, at(2019, 5, 14), "absolute"), ("27 Mar 2024 18:20:37 -0400", "en_US", None, at(2024, 3, 27, 22, 20, 37), "absolute"),
    ("9/23/25 03:15 AM", "en_US", "America/Los_Angeles", at(2025, 9, 23, 3, 15, zone="America/Los_Angeles"), "exact"), ("12/31/2020 12:05 AM", "en_US", "UTC", at(2020, 12, 31, 0, 5), "exact"), ("25. Oktober 2020 02:32", "de_DE", "Europe/Berlin", at(2020, 10, 25, 0, 32), "ambiguous"), ("29. März 2020 02:52", "de_DE", "Europe/Berlin", at(2020, 3, 29, 1, 52), "nonexistent"),
    ("1950-01-01T00:00:00.500Z", None, None, at(1950, 1, 1), "absolute"), ("2019-02-30", "en_AU", None, None, None), ("2020-13-20", "en_US", None, None, None), ("00/00/0000", "en_US", None, None, None), ("TBD", "en_US", None, None, None), ("", None, None, None, None), (None, None, None, None, None), ("2021-01-05 25:00:00", "en_GB", "Europe/London", None, None),
    ("2021-01-05 10:00:00", "en_GB", None, None, None), ("2021-01-05 10:00:00", "en_GB", "Nowhere/Town", None, None), ("2021-01-05 10:00:00 XYZ", "en_GB", "Europe/London", None, None), ("x" * 50_000, "en_GB", "Europe/London", None, None), ("<<<<<<", None, None, None, None), ("13:45", "en_GB", "Europe/London", None, None), ("9/2/2024", None, None, None, None), ("25/2/2024", None, None, at(2024, 2, 25), "absolute"),
]


def test_moments(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)] + [(0, *CASES[0])], "tz bigint, w string, l string, z string, want bigint, how string")
    rows = to_moments(df, "w", "l", "z").collect()
    assert len(rows) == len(CASES) + 1
    for row in rows:
        assert (row.epoch_s, row.reading) == (row.want, row.how), row
    assert to_moments(df.limit(0), "w", "l", "z").count() == 0


def test_local_times_against_zoneinfo(spark):
    rng = random.Random(5)
    zones = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "Africa/Casablanca", "America/St_Johns"]
    rows = []
    for i in range(600):
        zone = rng.choice(zones)
        local = dt.datetime(1975, 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 365 * 60))
        rows.append((i, local.strftime("%Y-%m-%d %H:%M"), zone, int(local.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0).timestamp())))
    df = spark.createDataFrame(rows, "i int, w string, z string, want bigint").withColumn("l", F.lit("en_GB"))
    assert to_moments(df, "w", "l", "z").where("epoch_s is distinct from want").count() == 0


def test_far_years_against_the_zone_rules(spark):
    """Years beyond the listed ones go by the zones' last rules, early ones by local mean time."""
    rng = random.Random(6)
    zones = ["Europe/Berlin", "America/New_York", "Australia/Sydney", "America/Santiago", "Africa/Casablanca", "Asia/Tokyo"]
    rows = []
    for i in range(400):
        zone = rng.choice(zones)
        local = dt.datetime(rng.choice([1500, 1799, 1850, 1895, 2099, 2101, 2128, 2129, 2150, 2400, 3000, 9998]), 1, 1) + dt.timedelta(minutes=rng.randrange(60 * 24 * 365))
        rows.append((i, local.strftime("%Y-%m-%d %H:%M").zfill(16), zone, int(local.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0).timestamp())))
    df = spark.createDataFrame(rows, "i int, w string, z string, want bigint").withColumn("l", F.lit("en_GB"))
    wrong = to_moments(df, "w", "l", "z").where("epoch_s is distinct from want").collect()
    assert not wrong, wrong[:5]
