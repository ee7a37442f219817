"""Queries of the scalar functions, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import coerce, dates, mrz, numbers, quality, text
from paperloom.tables import table


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "organisations").select("org_id", F.concat_ws(" - ", "registered_name", "town").alias("t"))
    return rows.select("org_id", text.for_search(F.col("t")).alias("search_form"), text.for_scoring(F.col("t")).alias("scoring_form"), text.for_zone(F.col("t")).alias("zone_form"))


def parse_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    plain, english = price.cast("string"), F.format_number(price, 2)
    german = F.translate(english, ",.", ".,")
    form = F.pmod("l_orderkey", F.lit(9))
    written = (
        F.when(form == 0, plain).when(form == 1, F.concat(F.lit("USD "), english)).when(form == 2, F.concat(german, F.lit(" €"))).when(form == 3, F.concat(F.lit("("), plain, F.lit(")")))
        .when(form == 4, F.concat(plain, F.lit(" -"))).when(form == 5, F.concat(F.lit("--"), plain)).when(form == 6, F.concat(F.lit("−"), plain)).when(form == 7, F.lit("n/a")).otherwise(F.translate(plain, ".", ","))
    )
    rows = table(spark, sf_dir, "lineitem").withColumn("written", written)
    value = numbers.parse_decimal(F.col("written")).cast("decimal(18,2)")
    return rows.select("l_orderkey", "l_linenumber", "written", value.alias("value")).groupBy("written", "value").agg(F.count("*").alias("n"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    form = F.pmod("o_orderkey", F.lit(7))
    at = F.col("o_orderdate")
    written = (
        F.when(form == 0, F.date_format(at, "yyyy-MM-dd")).when(form == 1, F.date_format(at, "MM/dd/yyyy")).when(form == 2, F.date_format(at, "d MMM yyyy")).when(form == 3, F.date_format(at, "MMMM d, yyyy"))
        .when(form == 4, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(form == 5, F.concat(F.date_format(at, "yyyy"), F.lit("-02-31"))).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    )
    return o.withColumn("written", written).select("o_orderkey", "written", dates.parse_moment(F.col("written")).cast("date").alias("day"))


def epoch_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    number = F.when(F.col("event_id") % 2 == 0, F.floor(seconds).cast("double")).otherwise(F.floor(seconds * 1000).cast("double"))
    moment = dates.from_epoch(number)
    return e.select("event_id", F.unix_millis(moment).alias("epoch_ms"))


def bool_enum_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["true", " YES", "n", "0", "2", "maybe", "False ", ""]
    e = table(spark, sf_dir, "events").withColumn("word", F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("event_id") % 8 + 1).cast("int")))
    e = e.withColumn("kind", F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return e.select("event_id", coerce.to_boolean(F.col("word")).alias("flag"), coerce.to_enum(F.col("kind"), ["view", "click", "purchase"]).alias("kind"))


def integers_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("l_quantity") * F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(1.5)).cast("decimal(18,2)")
    rows = table(spark, sf_dir, "lineitem").select(v.alias("v"), numbers.as_integer(v).alias("whole"), numbers.compact_number(v).alias("compact"), numbers.distinctive_number(numbers.compact_number(v)).alias("distinctive"), F.array_join(numbers.search_candidates(v), " ").alias("candidates"))
    return rows.groupBy("v", "whole", "compact", "distinctive", "candidates").agg(F.count("*").alias("n"))


def lookalike_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("written", F.translate("p_name", "aeopcxy", "аеорсху"))
    return p.select("p_partkey", text.latin_repair(F.col("written")).alias("repaired"), text.latin_only(F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("en-US"), F.lit("de"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("en"), F.lit("ru"))).otherwise(F.array().cast("array<string>"))).alias("latin"))


def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(x) for x in ("• ", "1. ", "(a) ", "- ", "", "12) ")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_list_marker(F.concat(lead, F.col("p_name"))).alias("stripped"), text.is_list_marker(F.trim(lead)).alias("marker"))


def table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.element_at(F.array(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)), F.concat(F.lit("EUR "), F.col("p_retailprice").cast("string")), F.col("p_name"), F.concat(F.col("p_size").cast("string"), F.lit(" %")), F.lit("-")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.table_numeric(shown).alias("numeric"))


def skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Net - "), F.format_number(F.col("c_acctbal"), 2), F.lit(" EUR (-"), F.col("c_custkey").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.numeric_skeleton(t).alias("skeleton"))


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as two-line zones; every tenth has its birth digit wrong."""
    c = table(spark, sf_dir, "customer")
    name = F.rpad(F.concat(F.lit("CUSTOMER<<"), F.translate(F.upper("c_mktsegment"), " ", "<")), 39, "<")
    number = F.rpad(F.concat(F.lit("L"), F.col("c_custkey").cast("string")), 9, "<")
    birth = F.concat(F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("0612"))
    expiry = F.concat(F.lpad(((F.col("c_custkey") + 30) % 100).cast("string"), 2, "0"), F.lit("1231"))
    digit = lambda f: mrz.check_digit(f).cast("string")
    wrong = F.when(F.col("doc_id") % 10 == 0, F.pmod(mrz.check_digit(F.col("b")) + 1, F.lit(10)).cast("string")).otherwise(digit(F.col("b")))
    made = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("P<UTO"), name).alias("line1"), number.alias("n"), birth.alias("b"), expiry.alias("e"))
    made = made.select("doc_id", "line1", "n", "b", "e", digit(F.col("n")).alias("nd"), wrong.alias("bd"), digit(F.col("e")).alias("ed"))
    front = F.concat("n", "nd", F.lit("UTO"), "b", "bd", F.lit("F"), "e", "ed", F.lit("<" * 14), F.lit("0"))
    made = made.withColumn("front", front)
    total = digit(F.concat(F.substring("front", 1, 10), F.substring("front", 14, 7), F.substring("front", 22, 22)))
    return made.select("doc_id", "line1", F.concat("front", total).alias("line2"))


def mrz_checkdigit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mrz.check_digit(F.rpad(F.concat(F.lit("L"), F.col("c_custkey").cast("string")), 9, "<")).alias("digit"))


def mrz_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _zones(spark, sf_dir)
    lines = z.select("doc_id", F.posexplode(F.array(F.lit("Specimen of a page"), F.col("line1"), F.lit(""), F.col("line2"))).alias("ord", "text"))
    read = mrz.parse_zones(lines, F.to_date(F.lit("2026-07-27")))
    return read.select("doc_id", "kind", F.col("zone.document_number").alias("document_number"), F.col("zone.names.surname").alias("surname"), F.col("zone.names.given_names").alias("given_names"), F.col("zone.date_of_birth").alias("date_of_birth"), F.col("zone.expiry_date").alias("expiry_date"), F.col("zone.birth_ok").alias("birth_ok"), F.col("zone.all_ok").alias("all_ok"))


def mrz_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "mrz_comparisons").select("comparison_id", "mrz_value", "extracted_value").distinct()
    agrees = text.for_zone(F.coalesce("mrz_value", F.lit(""))) == text.for_zone(F.coalesce("extracted_value", F.lit("")))
    return rows.select("comparison_id", agrees.alias("agrees"))


def text_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = docs.withColumn("score", quality.text_quality(F.coalesce("text", F.lit(""))))
    return score.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") < quality.THRESHOLD).alias("needs_ocr"))


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "inspections").select("inspection_id", F.concat(F.lit("--- Page 1 ---\n"), F.coalesce("full_text", F.lit("-")), F.lit("\n\n--- Page 2 ---\nlast")).alias("t")).distinct()
    return i.select("inspection_id", F.size(text.pages_of(F.col("t"))).alias("pages"), text.page_count(F.col("t")).alias("marks"))


def token_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").withColumn("at", (F.col("p_partkey") % 9 + 1).cast("int"))
    return d.select("p_partkey", text.cut_inside_token(F.concat_ws(" ", "p_name", "p_brand"), F.col("at")).alias("inside"))


def zone_centuries(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("0228"))
    day = F.to_date(F.lit("2026-07-27"))
    return table(spark, sf_dir, "customer").select("c_custkey", dates.zone_date(raw, day, True).alias("birth"), dates.zone_date(raw, day, False).alias("expiry"))


QUERIES = {f.__name__: f for f in (normalize_names, parse_decimals, parse_dates, epoch_heuristic, bool_enum_coerce, integers_and_numbers, lookalike_fix, list_markers, table_numbers, skeletons, mrz_checkdigit, mrz_fields, mrz_crosscheck, text_quality_gate, page_split, token_cut, zone_centuries)}

_DIGIT = "list_reduce(list_prepend(0, list_transform(range(1, length({f}) + 1), lambda i: (case when substr({f}, i, 1) = '<' then 0 when substr({f}, i, 1) between '0' and '9' then substr({f}, i, 1)::int else ascii(substr({f}, i, 1)) - 55 end) * [7, 3, 1][((i - 1) % 3) + 1])), lambda a, b: a + b) % 10"

_CJK = quality._CJK
_BARE = "regexp_replace(p, '^[\\p{P}\\p{S}]+|[\\p{P}\\p{S}]+$', '', 'g')"
_FLAT = f"lower(strip_accents({_BARE}))"
_SINGLE = " or ".join(f"regexp_matches({_BARE}, '^[{block}\\p{{M}}\\p{{Nd}}''’.\\-]+$')" for block in quality.SCRIPTS.values())
#: Is a token p well formed: a number, two digits, or letters that could be a word?
_WELL = (
    f"(regexp_matches({_BARE}, '^[+-]?\\d+([.,]\\d+)*%?$') or len(regexp_extract_all({_BARE}, '\\p{{Nd}}')) >= 2 or len(regexp_extract_all({_BARE}, '[\\p{{L}}\\p{{M}}]')) >= greatest(2, length({_BARE}) - 1) and ("
    f"regexp_matches({_FLAT}, '[a-z]') and (regexp_matches({_FLAT}, '[aeiouyøœæ]') or length({_BARE}) <= 3 and regexp_matches({_BARE}, '^\\p{{Lu}}+$')) or {_SINGLE} or regexp_matches({_BARE}, '^[CJK]+$')))"
)

SQL = {
    "text_quality_gate": r"""
        with c as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\p{Cf}', '', 'g'), '^B+|B+$', '', 'g') as clean from documents),
        t as (select *, regexp_replace(clean, 'B+', '', 'g') as solid, list_filter(regexp_split_to_array(clean, 'B+'), lambda x: x <> '') as tokens from c),
        w as (select *, list_transform(tokens, lambda x: case when regexp_matches(x, '[CJK]') then list_filter(string_split(regexp_replace(x, '([CJK]+)', ' \1 ', 'g'), ' '), lambda p: regexp_matches(p, '[\p{L}\p{N}]')) else [x] end) as parts from t),
        g as (select *, list_transform(tokens, lambda x: regexp_matches(x, '[CJK]')) as han, list_transform(parts, lambda ps: list_transform(ps, lambda p: WELL)) as good from w),
        m as (select *, list_transform(range(1, len(tokens) + 1), lambda i: case when not han[i] then case when good[i][1] then 1.0 else 0.0 end when len(parts[i]) = 0 then 0.0 else
            len(list_filter(range(1, len(parts[i]) + 1), lambda k: regexp_matches(parts[i][k], '^[CJK]+$') or good[i][k] or length(parts[i][k]) = 1))::double / len(parts[i]) end) as shares from g),
        s as (select *, 0.5::double * len(regexp_extract_all(solid, '[\p{L}\p{M}\p{N}]')) / nullif(length(solid), 0) + 0.5::double * list_sum(shares)::double / nullif(len(tokens), 0) as raw from m),
        r as (select doc_id, case when solid = '' then 0.0::double else least(greatest(case when regexp_matches(clean, '[\x{FFFD}\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}]') then least(raw, 0.3) else raw end, 0), 1) end as score from s)
        select doc_id, round(score, 6)::double as score, score < 0.85 as needs_ocr from r""".replace("WELL", _WELL).replace("CJK", _CJK).replace("B+", "[\\s\\x0b\\p{Z}\\x{85}]+"),
    "normalize_names": """
        with t as (select org_id, registered_name || ' - ' || town as t from organisations)
        select org_id, trim(regexp_replace(lower(strip_accents(t)), '[^\\p{L}\\p{M}\\p{N}]+', ' ', 'g')) as search_form, regexp_replace(lower(trim(t)), '\\s+', ' ', 'g') as scoring_form,
            trim(regexp_replace(upper(strip_accents(replace(t, '<', ' '))), '\\s+', ' ', 'g')) as zone_form from t""",
    "parse_decimals": """
        with s as (select l_orderkey % 9 as form, l_extendedprice::decimal(18,2) as p from lineitem),
        w as (select form, p, case form when 0 then p::varchar when 1 then 'USD ' || format('{:,.2f}', p::double) when 2 then translate(format('{:,.2f}', p::double), ',.', '.,') || ' €' when 3 then '(' || p || ')'
            when 4 then p || ' -' when 5 then '--' || p when 6 then '−' || p when 7 then 'n/a' else translate(p::varchar, '.', ',') end as written from s)
        select written, case when form in (0, 1, 2, 8) then p when form in (3, 4, 6) then -p end::decimal(18,2) as value, count(*) as n from w group by all""",
    "parse_dates": """
        with w as (select o_orderkey, case o_orderkey % 7 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%m/%d/%Y') when 2 then strftime(o_orderdate, '%-d %b %Y') when 3 then strftime(o_orderdate, '%B %-d, %Y')
            when 4 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') when 5 then strftime(o_orderdate, '%Y') || '-02-31' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as written from orders)
        select o_orderkey, written, coalesce(try_strptime(written, '%Y-%m-%d'), try_strptime(written, '%m/%d/%Y'), try_strptime(written, '%d %b %Y'), try_strptime(written, '%B %d, %Y'), try_strptime(written, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(written, '%Y-%m-%d %H:%M:%S'))::date as day from w""",
    "epoch_heuristic": """
        select event_id, case when event_id % 2 = 0 then epoch_us(ts) // 1000000 * 1000 else epoch_us(ts) // 1000 end::bigint as epoch_ms from events""",
    "bool_enum_coerce": """
        with w as (select event_id, lower(trim(['true', ' YES', 'n', '0', '2', 'maybe', 'False ', ''][event_id % 8 + 1])) as s, case when event_id % 3 = 0 then upper(event_type) else event_type end as k from events)
        select event_id, case when s in ('true', 'yes', 'y', '1') then true when s in ('false', 'no', 'n', '0') then false when try_cast(s as double) is not null then try_cast(s as double)::bigint <> 0 end as flag,
            case when lower(k) in ('view', 'click', 'purchase') then lower(k) end as kind from w""",
    "integers_and_numbers": """
        with w as (select (l_quantity * case when l_linenumber % 2 = 0 then 1 else 1.5 end)::decimal(18,2) as v from lineitem),
        c as (select v, regexp_replace(regexp_replace(v::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') as compact from w)
        select v, case when round(v, 0) = v then v::bigint end as whole, compact, (length(regexp_replace(compact, '[^0-9]', '', 'g')) >= 3 or contains(compact, '.')) as distinctive,
            case when round(v, 0) = v then compact || ' ' || v else case when compact = v::decimal(18,1)::varchar then compact || ' ' || v else compact || ' ' || v::decimal(18,1) end end as candidates, count(*) as n from c group by all""",
    "lookalike_fix": """
        select p_partkey, p_name as repaired, p_partkey % 3 = 0 as latin from part""",
    "list_markers": """
        select p_partkey, p_name as stripped, p_partkey % 6 <> 4 as marker from part""",
    "table_numbers": """
        select p_partkey, p_partkey % 5 in (0, 1, 3) as "numeric" from part""",
    "skeletons": """
        with t as (select c_custkey, 'Net - ' || format('{:,.2f}', c_acctbal) || ' EUR (-' || c_custkey || ')' as t from customer)
        select c_custkey, trim(regexp_replace(regexp_replace(replace(t, ',', ''), '-([^0-9]|$)', ' \\1', 'g'), '[^0-9.\\-]+', ' ', 'g')) as skeleton from t""",
    "mrz_checkdigit": f"""
        with t as (select c_custkey, rpad('L' || c_custkey, 9, '<') as f from customer)
        select c_custkey, ({_DIGIT.format(f="f")})::int as digit from t""",
    "mrz_fields": """
        select c_custkey as doc_id, 'TD3' as kind, 'L' || c_custkey as document_number, 'CUSTOMER' as surname, replace(upper(c_mktsegment), '<', ' ') as given_names,
            make_date(case when c_custkey % 100 <= 26 then 2000 + c_custkey % 100 else 1900 + c_custkey % 100 end::int, 6, 12) as date_of_birth,
            make_date(case when abs(2000 + (c_custkey + 30) % 100 - 2026) <= 50 then 2000 + (c_custkey + 30) % 100 else 1900 + (c_custkey + 30) % 100 end::int, 12, 31) as expiry_date,
            c_custkey % 10 <> 0 as birth_ok, c_custkey % 10 <> 0 as all_ok from customer""",
    "mrz_crosscheck": """
        with r as (select distinct comparison_id, coalesce(mrz_value, '') as a, coalesce(extracted_value, '') as b from mrz_comparisons),
        n as (select comparison_id, trim(regexp_replace(upper(strip_accents(replace(replace(a, '<', ' '), 'ﬁ', 'fi'))), '[\\s\\p{Z}]+', ' ', 'g')) as a, trim(regexp_replace(upper(strip_accents(replace(replace(b, '<', ' '), 'ﬁ', 'fi'))), '[\\s\\p{Z}]+', ' ', 'g')) as b from r)
        select comparison_id, a = b as agrees from n""",
    "page_split": """
        select distinct inspection_id, case when regexp_full_match(coalesce(full_text, '-'), '\\s*') then 1 else 2 end as pages, 2 as marks from inspections""",
    "token_cut": """
        with t as (select p_partkey, substr(p_name || ' ' || p_brand, (p_partkey % 9 + 1)::int, 2) as c from part)
        select p_partkey, regexp_full_match(c, '\\p{L}{2}|\\p{Nd}{2}') as inside from t""",
    "zone_centuries": """
        select c_custkey, make_date(case when c_custkey % 100 <= 26 then 2000 + c_custkey % 100 else 1900 + c_custkey % 100 end::int, 2, 28) as birth,
            make_date(case when abs(2000 + c_custkey % 100 - 2026) <= 50 then 2000 + c_custkey % 100 else 1900 + c_custkey % 100 end::int, 2, 28) as expiry from customer""",
}
