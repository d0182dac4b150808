"""CSV in, JSON in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values


def import_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool | None = None, sample: float = 1.0, empty_is_null: bool = True) -> DataFrame:
    """Quoted fields and line breaks in them are kept. Types are Bool, Int, Float/Double or String, the narrowest that holds all
    of a column's values; without ``header`` the first row is a header if none of its fields is a number and some field below one is.
    """
    options = {"multiLine": True, "escape": '"', "nullValue": "" if empty_is_null else "\0", "mode": "PERMISSIVE"}
    reader = spark.read.options(**options)
    if header is None:
        head = [list(r) for r in reader.option("header", False).csv(path).limit(2).collect()]
        number = lambda v: v is not None and v.strip().lstrip("+-").replace(".", "", 1).isdigit()
        header = bool(head) and not any(map(number, head[0])) and (len(head) < 2 or any(map(number, head[1])))
    reader = reader.option("header", header)
    if schema:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).option("samplingRatio", sample).option("preferDate", False).csv(path)
    wide = [F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.LongType)) else F.col(f"`{f.name}`") if isinstance(f.dataType, (T.DoubleType, T.BooleanType, T.StringType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema]
    return df.select(*wide)


def to_json(df: DataFrame, mode: str = "json", links: dict[str, str] | None = None) -> DataFrame:
    """One JSON text a row, column ``json``. Modes: json (plain), xjson (types kept by wrappers), xjson_plus (also links marked).

    ``links``: link columns and the class each leads to.
    """
    if mode == "json":
        return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        text = _wrapped(c, f.dataType)
        if mode == "xjson_plus" and links and f.name in links:
            text = F.concat(F.lit('{"$link":{"table":"' + links[f.name] + '","key":'), text, F.lit("}}"))
        parts.append(F.concat(F.lit(f'"{f.name}":'), F.when(c.isNull(), F.lit("null")).otherwise(text)))
    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("json"))


def _wrapped(c: Column, kind: T.DataType) -> Column:
    s = lambda before, x, after: F.concat(F.lit(before), x, F.lit(after))
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return s('{"$numberLong":"', c.cast("string"), '"}')
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return s('{"$numberDouble":"', c.cast("string"), '"}')
    if isinstance(kind, T.DecimalType):
        return s('{"$numberDecimal":"', c.cast("string"), '"}')
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return s('{"$date":{"$numberLong":"', F.unix_millis(c.cast("timestamp")).cast("string"), '"}}')
    if isinstance(kind, T.BinaryType):
        return s('{"$binary":{"base64":"', F.base64(c), '","subType":"00"}}')
    if isinstance(kind, T.BooleanType):
        return c.cast("string")
    if isinstance(kind, T.ArrayType):
        return s("[", F.array_join(F.transform(c, lambda x: F.when(x.isNull(), F.lit("null")).otherwise(_wrapped(x, kind.elementType))), ","), "]")
    if isinstance(kind, T.MapType):
        return s("{", F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.when(e["value"].isNull(), F.lit("null")).otherwise(_wrapped(e["value"], kind.valueType)))), ","), "}")
    if isinstance(kind, T.StructType):
        return s("{", F.concat_ws(",", *[F.concat(F.lit(f'"{f.name}":'), F.when(c[f.name].isNull(), F.lit("null")).otherwise(_wrapped(c[f.name], f.dataType))) for f in kind]), "}")
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return _quoted(c)


def _quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def from_json(df: DataFrame, column: str, into: str = "value") -> DataFrame:
    """JSON text as a dynamic value; what doesn't parse is null. Wrappers of xjson are read by ``unwrapped``."""
    return df.withColumn(into, F.try_parse_json(F.col(column)))


def unwrapped(v: Column, kind: str) -> Column:
    """The value of an xjson wrapper, or a plain one, as ``kind``."""
    wrappers = ("$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$oid", "$uuid")
    inner = F.coalesce(*[F.try_variant_get(v, f"$['{w}']", "string") for w in wrappers])
    millis = F.try_variant_get(v, "$['$date']['$numberLong']", "string").cast("bigint")
    if kind.startswith("timestamp"):
        return F.timestamp_millis(millis)
    if kind == "binary":
        return F.unbase64(F.try_variant_get(v, "$['$binary']['base64']", "string"))
    return F.coalesce(inner.try_cast(kind), F.try_variant_get(v, "$", kind)) if kind in values.INT | values.REAL or kind == "string" else F.try_variant_get(v, "$", kind)
