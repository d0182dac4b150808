"""Extended JSON of BSON documents: seventeen types, read from and written to JSON text, and BSON bytes.

Values in Python: None, int (32 or 64 bits by size), ``Int64``, bool, float, str, bytes, ``Stamp``, datetime, ``ObjectId``, Decimal, ``Regex``, ``MAX``, ``MIN``, dict, list and ``Uuid``.
Frames use ``encode`` and ``decode``, which work on Arrow batches.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tree import ObjectId, Uuid

EPOCH = dt.datetime(1970, 1, 1)


class Int64(int):
    """A whole number of 64 bits whatever its size."""


@dataclass(frozen=True)
class Stamp:
    """Seconds and a counter, as databases number their own operations."""

    seconds: int
    increment: int


@dataclass(frozen=True)
class Regex:
    pattern: str
    options: str = ""


@dataclass(frozen=True)
class Edge:
    """Above or below all other values."""

    name: str


MAX, MIN = Edge("maxKey"), Edge("minKey")


# -- JSON text


def to_plain(v: Any) -> Any:
    """A value as JSON data, with a wrapper where JSON has no such type."""
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, int):
        return {"$numberLong": str(int(v))} if isinstance(v, Int64) or not -(1 << 31) <= v < 1 << 31 else {"$numberInt": str(v)}
    if isinstance(v, float):
        return {"$numberDouble": "NaN" if v != v else ("Infinity" if v > 0 else "-Infinity") if math.isinf(v) else repr(v)}
    if isinstance(v, Decimal):
        return {"$numberDecimal": "NaN" if v.is_nan() else str(v)}
    if isinstance(v, bytes):
        return {"$binary": {"base64": base64.b64encode(v).decode(), "subType": "00"}}
    if isinstance(v, Uuid):
        return {"$binary": {"base64": base64.b64encode(bytes.fromhex(v.value.replace("-", ""))).decode(), "subType": "04"}}
    if isinstance(v, dt.datetime):
        return {"$date": {"$numberLong": str((v.replace(tzinfo=None) - EPOCH) // dt.timedelta(milliseconds=1))}}
    if isinstance(v, Stamp):
        return {"$timestamp": {"t": v.seconds, "i": v.increment}}
    if isinstance(v, ObjectId):
        return {"$oid": v.value}
    if isinstance(v, Regex):
        return {"$regularExpression": {"pattern": v.pattern, "options": v.options}}
    if isinstance(v, Edge):
        return {f"${v.name}": 1}
    if isinstance(v, (list, tuple)):
        return [to_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: to_plain(x) for k, x in v.items()}
    raise ValueError(f"no Extended JSON for {type(v).__name__}")


def from_plain(v: Any) -> Any:
    """What JSON data stands for."""
    if isinstance(v, list):
        return [from_plain(x) for x in v]
    if not isinstance(v, dict):
        return v
    if len(v) == 1:
        (k, x), = v.items()
        if k == "$numberInt":
            return int(x)
        if k == "$numberLong":
            return Int64(x)
        if k == "$numberDouble":
            return float(x)
        if k == "$numberDecimal":
            return Decimal(x)
        if k == "$binary":
            raw = base64.b64decode(x["base64"])
            return Uuid("-".join((h := raw.hex())[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))) if x["subType"] in ("04", "4") and len(raw) == 16 else raw
        if k == "$uuid":
            return Uuid(x)
        if k == "$date":
            millis = int(x["$numberLong"]) if isinstance(x, dict) else x if isinstance(x, int) else dt.datetime.fromisoformat(x)
            return EPOCH + dt.timedelta(milliseconds=millis) if isinstance(millis, int) else millis.astimezone(dt.timezone.utc).replace(tzinfo=None)
        if k == "$timestamp":
            return Stamp(x["t"], x["i"])
        if k == "$oid":
            return ObjectId(x)
        if k == "$regularExpression":
            return Regex(x["pattern"], x.get("options", ""))
        if k in ("$maxKey", "$minKey"):
            return MAX if k == "$maxKey" else MIN
    return {k: from_plain(x) for k, x in v.items()}


def dumps(v: Any) -> str:
    return json.dumps(to_plain(v), ensure_ascii=False, separators=(",", ":"))


def loads(text: str) -> Any:
    return from_plain(json.loads(text))


# -- BSON bytes; type bytes are fixed values of the format

CODES = {"double": 0x01, "string": 0x02, "document": 0x03, "array": 0x04, "binary": 0x05, "objectId": 0x07, "bool": 0x08, "date": 0x09, "null": 0x0A, "regex": 0x0B, "int": 0x10, "timestamp": 0x11, "long": 0x12, "decimal": 0x13, "minKey": 0xFF, "maxKey": 0x7F}
NAMES = {v: k for k, v in CODES.items()}
BIAS = 6176  # of a decimal's exponent


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<i", len(raw) + 1) + raw + b"\0"


def _decimal(v: Decimal) -> bytes:
    if v.is_nan():
        return (0x7C << 120).to_bytes(16, "little")
    if v.is_infinite():
        return ((0xF8 if v < 0 else 0x78) << 120).to_bytes(16, "little")
    sign, digits, exponent = v.as_tuple()
    n = int("".join(map(str, digits)) or "0")
    if n >= 10**34 or not -BIAS <= exponent < 12288 - BIAS:
        raise ValueError(f"{v} has no 128-bit decimal form")
    return (sign << 127 | (exponent + BIAS) << 113 | n).to_bytes(16, "little")


def _from_decimal(raw: bytes) -> Decimal:
    n = int.from_bytes(raw, "little")
    top = n >> 120
    if top & 0x7C == 0x7C:
        return Decimal("NaN")
    if top & 0x7C == 0x78:
        return Decimal("-Infinity" if top & 0x80 else "Infinity")
    return Decimal((n >> 127, tuple(map(int, str(n & ((1 << 113) - 1)))), (n >> 113 & 0x3FFF) - BIAS))


def _element(name: str, v: Any) -> bytes:
    def of(kind: str, body: bytes = b"") -> bytes:
        return bytes([CODES[kind]]) + name.encode() + b"\0" + body

    if v is None:
        return of("null")
    if isinstance(v, bool):
        return of("bool", bytes([v]))
    if isinstance(v, int):
        return of("long", struct.pack("<q", v)) if isinstance(v, Int64) or not -(1 << 31) <= v < 1 << 31 else of("int", struct.pack("<i", v))
    if isinstance(v, float):
        return of("double", struct.pack("<d", v))
    if isinstance(v, str):
        return of("string", _text(v))
    if isinstance(v, bytes):
        return of("binary", struct.pack("<iB", len(v), 0) + v)
    if isinstance(v, Uuid):
        return of("binary", struct.pack("<iB", 16, 4) + bytes.fromhex(v.value.replace("-", "")))
    if isinstance(v, dt.datetime):
        return of("date", struct.pack("<q", (v.replace(tzinfo=None) - EPOCH) // dt.timedelta(milliseconds=1)))
    if isinstance(v, Stamp):
        return of("timestamp", struct.pack("<II", v.increment, v.seconds))
    if isinstance(v, ObjectId):
        return of("objectId", bytes.fromhex(v.value))
    if isinstance(v, Decimal):
        return of("decimal", _decimal(v))
    if isinstance(v, Regex):
        return of("regex", v.pattern.encode() + b"\0" + v.options.encode() + b"\0")
    if isinstance(v, Edge):
        return of(v.name)
    if isinstance(v, dict):
        return of("document", to_bytes(v))
    if isinstance(v, (list, tuple)):
        return of("array", to_bytes({str(i): x for i, x in enumerate(v)}))
    raise ValueError(f"no BSON for {type(v).__name__}")


def to_bytes(document: dict) -> bytes:
    body = b"".join(_element(k, v) for k, v in document.items()) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


def from_bytes(raw: bytes) -> dict:
    """The document of BSON bytes; anything else raises ``ValueError``."""
    try:
        out, end = _document(raw, 0)
    except (ArithmeticError, IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError("not a BSON document") from e
    if end != len(raw):
        raise ValueError("bytes after the document")
    return out


def _document(raw: bytes, at: int) -> tuple[dict, int]:
    (size,) = struct.unpack_from("<i", raw, at)
    end, at, out = at + size, at + 4, {}
    if size < 5 or end > len(raw):
        raise ValueError("a document's length is wrong")
    while raw[at]:
        kind, stop = raw[at], raw.index(0, at + 1)
        name = raw[at + 1 : stop].decode()
        out[name], at = _value(raw, stop + 1, NAMES.get(kind, ""))
    if at + 1 != end:
        raise ValueError("a document's length is wrong")
    return out, end


def _value(raw: bytes, at: int, kind: str) -> tuple[Any, int]:
    def take(form: str) -> tuple:
        return struct.unpack_from("<" + form, raw, at)

    if kind in ("document", "array"):
        out, end = _document(raw, at)
        return (out if kind == "document" else list(out.values())), end
    if kind == "null":
        return None, at
    if kind in ("minKey", "maxKey"):
        return (MIN if kind == "minKey" else MAX), at
    if kind == "bool":
        return bool(take("B")[0]), at + 1
    if kind == "int":
        return take("i")[0], at + 4
    if kind == "long":
        return Int64(take("q")[0]), at + 8
    if kind == "double":
        return take("d")[0], at + 8
    if kind == "date":
        return EPOCH + dt.timedelta(milliseconds=take("q")[0]), at + 8
    if kind == "timestamp":
        i, t = take("II")
        return Stamp(t, i), at + 8
    if kind == "objectId":
        return ObjectId(raw[at : at + 12].hex()), at + 12
    if kind == "decimal":
        return _from_decimal(raw[at : at + 16]), at + 16
    if kind == "string":
        n = take("i")[0]
        if n < 1 or at + 4 + n > len(raw):
            raise ValueError("a string's length is wrong")
        return raw[at + 4 : at + 3 + n].decode(), at + 4 + n
    if kind == "binary":
        n, sub = take("iB")
        if n < 0 or at + 5 + n > len(raw):
            raise ValueError("a binary's length is wrong")
        body = raw[at + 5 : at + 5 + n]
        return from_plain({"$binary": {"base64": base64.b64encode(body).decode(), "subType": f"{sub:02x}"}}), at + 5 + n
    if kind == "regex":
        mid = raw.index(0, at)
        end = raw.index(0, mid + 1)
        return Regex(raw[at:mid].decode(), raw[mid + 1 : end].decode()), end + 1
    raise ValueError("an element of no known type")


# -- frames


def _mapped(df: DataFrame, column: str, into: str, kind: str, fn) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    src = df.withColumn(into, F.lit(None).cast(kind))
    schema = to_arrow_schema(src.schema)
    at, where = df.columns.index(column), src.columns.index(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.cast(f.type) for c, f in zip(batch.columns, schema)]
            cols[where] = pa.array([None if v is None else fn(v) for v in batch.column(at).to_pylist()], schema.field(where).type)
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return src.mapInArrow(run, src.schema)


def encode(df: DataFrame, column: str, into: str = "bson") -> DataFrame:
    """Extended JSON text of documents as BSON bytes; null stays null, what is no document fails."""
    return _mapped(df, column, into, "binary", lambda t: to_bytes(loads(t)))


def decode(df: DataFrame, column: str, into: str = "json") -> DataFrame:
    """BSON bytes as Extended JSON text; null stays null."""
    return _mapped(df, column, into, "string", lambda b: dumps(from_bytes(bytes(b))))
