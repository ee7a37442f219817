"""Model output as JSON: finding the record in it, canonical forms, snapshots of a stream.

Scanning for balanced brackets has no built-in equal (Spark's parsers accept trailing
junk), so these are Arrow batch functions; reading typed records out of the found JSON is
``from_json`` and the lenient column expressions.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from json.encoder import encode_basestring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom.functions.coerce import coerce_leaf, to_boolean, to_enum
from paperloom.functions.dates import from_epoch, parse_moment
from paperloom.functions.numbers import as_integer, parse_decimal
from paperloom.functions.text import trimmed
from paperloom.plans.schema import Schema

#: Openers tried in one text, and the size beyond which only the first is.
OPENERS, LARGE = 64, 256_000
_FENCE_OPEN = re.compile(r"^\s*```[^\n]*\n")
_FENCE_CLOSE = re.compile(r"\n?```\s*$")


_OBJECT, _ARRAY, _EITHER = re.compile(r"\{"), re.compile(r"\["), re.compile(r"[{\[]")


def _refuse(word: str):
    raise ValueError(word)


_DECODER = json.JSONDecoder(parse_float=Decimal, parse_constant=_refuse)


def loads(text: str):
    """Strict JSON with exact numbers; NaN and the like are refused."""

    return json.loads(text, parse_float=Decimal, parse_constant=_refuse)


def balanced_end(text: str, begin: int) -> int:
    """Offset behind the bracket that closes the one at ``begin``, or -1."""
    depth, inside, at = 0, False, begin
    while at < len(text):
        c = text[at]
        if inside:
            if c == "\\":
                at += 1
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return at + 1
        at += 1
    return -1


def find_record(text: str | None, root: str = "object") -> str | None:
    """The first balanced container of the root's kind that is valid JSON, fences aside."""
    found = _first_record(text, root)
    return None if found is None else found[0]


def read_record(text: str | None, root: str = "object"):
    """What ``find_record`` finds, read; None where it finds nothing."""
    found = _first_record(text, root)
    return None if found is None else found[1]


def _first_record(text: str | None, root: str) -> tuple[str, dict | list] | None:
    """The found container as text and read, in one pass: an opener from which the decoder reads
    a whole value is one whose balanced container is valid JSON, and the other way round."""
    if text is None:
        return None
    bare = (_FENCE_CLOSE.sub("", _FENCE_OPEN.sub("", text)) if "```" in text else text).strip()
    openers = {"object": _OBJECT, "array": _ARRAY}.get(root, _EITHER)
    tries, most = 0, 1 if len(bare) * 4 > LARGE and len(bare.encode("utf-8", "surrogatepass")) > LARGE else OPENERS
    for m in openers.finditer(bare):
        tries += 1
        if tries > most:
            return None
        try:
            value, end = _DECODER.raw_decode(bare, m.start())
            return bare[m.start():end], value
        except (ValueError, RecursionError):
            continue
    return None


def number_text(value) -> str:
    """Integers without a point, others in their shortest form."""
    if isinstance(value, int):
        return str(value)
    if type(value) is Decimal:
        text = str(value)
        if "E" not in text and len(text) <= 28:  # nothing that normalize() would round
            return text.rstrip("0").rstrip(".") if "." in text else text
    exact = Decimal(value).normalize()
    return format(exact, "f") if exact == exact.to_integral_value() or abs(exact.adjusted()) < 16 else str(exact)


def compact(value) -> str:
    """Canonical text of a JSON value: sorted keys, no blanks, numbers re-written."""
    kind = type(value)
    if kind is str:
        return encode_basestring(value)
    if kind is Decimal:
        return number_text(value)
    if kind is dict:
        return "{" + ",".join([f"{encode_basestring(k)}:{compact(value[k])}" for k in sorted(value)]) + "}"
    if isinstance(value, list):
        return "[" + ",".join([compact(v) for v in value]) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return number_text(value) if isinstance(value, (int, float)) else json.dumps(value, ensure_ascii=False)


def canonical(value):
    """A form in which structurally equal values are equal: strings trimmed, numbers by
    value, booleans no numbers."""
    kind = type(value)
    if kind is str:
        return ("s", value.strip())
    if kind is Decimal:
        return ("n", value.normalize())
    if kind is dict:
        return ("o", tuple([(k, canonical(value[k])) for k in sorted(value)]))
    if isinstance(value, list):
        return ("a", tuple([canonical(v) for v in value]))
    if isinstance(value, bool):
        return ("b", value)
    return ("n", Decimal(str(value)).normalize()) if isinstance(value, (int, float)) else ("z",)


def alike(a, b) -> bool:
    """Are the canonical forms equal?  They are not made where less shows it."""
    kind, other = type(a), type(b)
    if kind is str or other is str:
        return kind is other and (a == b or a.strip() == b.strip())
    if kind is Decimal and other is Decimal:
        return a == b or a.normalize() == b.normalize()
    if kind is dict and other is dict:
        return a.keys() == b.keys() and all([alike(v, b[k]) for k, v in a.items()])
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(alike, a, b))
    return canonical(a) == canonical(b)


def snapshot(text: str | None, root: str = "object") -> str | None:
    """The finished part of a JSON text that is still being written.

    Only finished tokens show: a string at its closing quote, a number behind which
    something follows, a nested object when closed; arrays grow element by element.  The
    first unfinished property ends its object.  A scalar root shows nothing.
    """
    if text is None:
        return None
    lead = text.lstrip()
    if lead.startswith("```"):
        line = lead.find("\n")
        if line < 0:
            return None
        lead = lead[line + 1:]
    opener = {"object": "{", "array": "["}[root]
    at = lead.find(opener)
    if at < 0:
        return None
    value, _ = _grown(lead, at, True)
    return None if value is _OPEN else compact(value)


_OPEN = object()
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in " \t\r\n":
        at += 1
    return at


def _grown(text: str, at: int, root: bool = False):
    """(value or _OPEN, offset behind it) of what is finished from ``at`` on."""
    at = _skip(text, at)
    if at >= len(text):
        return _OPEN, at
    c = text[at]
    if c == '"':
        end = at + 1
        while end < len(text) and text[end] != '"':
            end += 2 if text[end] == "\\" else 1
        if end >= len(text):
            return _OPEN, end
        try:
            return json.loads(text[at:end + 1]), end + 1
        except ValueError:
            return _OPEN, len(text)
    if c == "{":
        made: dict = {}
        at = _skip(text, at + 1)
        while True:
            if at < len(text) and text[at] == "}":
                return made, at + 1
            key, at = _grown(text, at)
            at = _skip(text, at)
            if key is _OPEN or not isinstance(key, str) or at >= len(text) or text[at] != ":":
                return (made if root else _OPEN), len(text)
            value, at = _grown(text, at + 1)
            if value is _OPEN:
                return (made if root else _OPEN), len(text)
            if isinstance(value, _Partial):
                made[key] = list(value)
                return (made if root else _OPEN), len(text)
            made[key] = value
            at = _skip(text, at)
            if at < len(text) and text[at] == ",":
                at = _skip(text, at + 1)
            elif at < len(text) and text[at] == "}":
                continue
            else:
                return (made if root else _OPEN), len(text)
    if c == "[":
        grown = _Partial()
        at = _skip(text, at + 1)
        while True:
            if at < len(text) and text[at] == "]":
                return list(grown), at + 1
            value, at = _grown(text, at)
            if value is _OPEN or isinstance(value, _Partial):
                return grown, len(text)
            grown.append(value)
            at = _skip(text, at)
            if at < len(text) and text[at] == ",":
                at = _skip(text, at + 1)
            elif not (at < len(text) and text[at] == "]"):
                return grown, len(text)
    m = _SCALAR.match(text, at)
    if not m or m.end() >= len(text) or text[m.end()] not in ",}] \t\r\n":
        return _OPEN, len(text)
    return loads(m[0]), m.end()


class _Partial(list):
    """An array that has not been closed yet."""


@F.pandas_udf(StringType())
def found_object(texts: pd.Series) -> pd.Series:
    return texts.map(find_record)


@F.pandas_udf(StringType())
def found_array(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: find_record(t, "array"))


@F.pandas_udf(StringType())
def object_snapshot(texts: pd.Series) -> pd.Series:
    return texts.map(snapshot)


@F.pandas_udf(StringType())
def compact_json(texts: pd.Series) -> pd.Series:
    def made(text):
        try:
            return None if text is None else compact(loads(text))
        except (ValueError, RecursionError):
            return None

    return texts.map(made)


def partial_record(text: Column) -> Column:
    """A chunk's record; whatever is no object contributes an empty one."""
    return F.coalesce(found_object(text), F.lit("{}"))


def same_json(a: Column, b: Column) -> Column:
    return compact_json(a).eqNullSafe(compact_json(b))


def decoded(json_column: Column, schema: Schema, locale: Column | None = None) -> Column:
    """A typed record read leniently from valid JSON text; what cannot be read is null."""
    raw = F.from_json(json_column, schema.raw_type())
    return _typed(raw, schema, locale)


def _typed(raw: Column, node: Schema, locale: Column | None) -> Column:
    if node.kind == "object":
        return F.struct(*[_typed(raw[name], below, locale).alias(name) for name, below in node.properties.items()])
    if node.kind == "array":
        return F.transform(raw, lambda x: _typed(x, node.items, locale))
    if node.kind == "number":
        return parse_decimal(raw, locale)
    if node.kind == "integer":
        return as_integer(parse_decimal(raw, locale))
    if node.kind == "boolean":
        return to_boolean(raw)
    if node.format:
        moment = F.coalesce(F.when(trimmed(raw).rlike(r"^-?\d+(\.\d+)?$"), from_epoch(trimmed(raw).try_cast("double"))), parse_moment(raw, locale))
        return moment if node.format == "date-time" else F.to_date(moment)
    return to_enum(raw, list(node.values)) if node.values else trimmed(raw)


def coerced(json_column: Column, schema: Schema, locale: Column | None = None) -> Column:
    """A dynamic record brought to its schema, as JSON text: keys that are not in it dropped,
    numbers as strings where a string is wanted and the other way round, dates as
    ``yyyy-MM-dd`` or ISO, enumerations in their own spelling; what cannot be is null."""
    return F.to_json(_coerced(F.from_json(json_column, schema.raw_type()), schema, locale), {"ignoreNullFields": "false"})


def _coerced(raw: Column, node: Schema, locale: Column | None) -> Column:
    if node.kind == "object":
        return F.when(raw.isNotNull(), F.struct(*[_coerced(raw[name], below, locale).alias(name) for name, below in node.properties.items()]))
    if node.kind == "array":
        return F.transform(raw, lambda x: _coerced(x, node.items, locale))
    kind = "enum" if node.values else node.format or node.kind
    leaf = coerce_leaf(raw, kind, locale, list(node.values))
    return leaf.try_cast(node.spark_type()) if node.kind in ("number", "integer", "boolean") else leaf


def decode_errors(json_column: Column, schema: Schema, locale: Column | None = None) -> Column:
    """Messages for the top-level scalars of a record that are missing or unreadable."""
    raw = F.from_json(json_column, schema.raw_type())
    messages = []
    for name, node in schema.properties.items():
        if node.kind in ("object", "array"):
            value = readable = raw[name]
        else:
            value, readable = raw[name], _typed(raw[name], node, locale)
        if name in schema.required:
            messages.append(F.when(value.isNull(), F.lit(f"field `{name}`: missing required value")))
        if node.kind not in ("object", "array"):
            messages.append(F.when(value.isNotNull() & readable.isNull(), F.format_string(f"field `{name}`: expected {node.format or node.kind}, got %s", value)))
    return F.array_compact(F.array(*messages))


def variant_at(json_column: Column, path: str, kind: str = "string") -> Column:
    """A member by path (``a.b[0]``), null where absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(json_column), f"$.{path}", kind)
