"""Declared shapes of tables: conforming rows, profiles of JSON and of columns, and drift between profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _no_errors() -> Column:
    return F.array().cast("array<string>")


def _converted(value: Column, was: T.DataType, to: T.DataType, path: str) -> tuple[Column, Column]:
    """The value in another type, and the paths within it where that failed; both for values that aren't null."""
    if isinstance(was, T.StructType) and isinstance(to, T.StructType):
        fields, errors = [], _no_errors()
        for f in to.fields:
            out, found = _field(value.getField(f.name) if f.name in was.names else None, was[f.name].dataType if f.name in was.names else None, f, f"{path}.{f.name}")
            fields.append(out.alias(f.name))
            errors = F.concat(errors, found)
        return F.struct(*fields), errors
    if isinstance(was, T.ArrayType) and isinstance(to, T.ArrayType):
        item = T.StructField("", to.elementType, to.containsNull)
        out = F.transform(value, lambda x: _field(x, was.elementType, item, f"{path}[]")[0])
        return out, F.flatten(F.transform(value, lambda x: _field(x, was.elementType, item, f"{path}[]")[1]))
    if isinstance(was, T.MapType) and isinstance(to, T.MapType) and was.keyType == to.keyType:
        item = T.StructField("", to.valueType, to.valueContainsNull)
        out = F.transform_values(value, lambda _, x: _field(x, was.valueType, item, f"{path}{{}}")[0])
        return out, F.flatten(F.transform(F.map_values(value), lambda x: _field(x, was.valueType, item, f"{path}{{}}")[1]))
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(was, nested) != isinstance(to, nested) and not isinstance(to, T.StringType) or isinstance(was, nested) and isinstance(to, nested) and type(was) is not type(to):
        return F.lit(None).cast(to), F.array(F.lit(path))
    out = value.try_cast(to)
    return out, F.when(out.isNull(), F.array(F.lit(path))).otherwise(_no_errors())


def _field(value: Column | None, was: T.DataType | None, f: T.StructField, path: str) -> tuple[Column, Column]:
    """A field's value in its declared type, and the paths that failed; a null in a required field is one."""
    missing = _no_errors() if f.nullable else F.array(F.lit(path))
    if value is None or was is None:
        return F.lit(None).cast(f.dataType), missing
    out, errors = _converted(value, was, f.dataType, path)
    return F.when(value.isNotNull(), out), F.when(value.isNull(), missing).otherwise(errors)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema``, in order and type, and ``_cast_errors``.

    Missing columns and fields are null and extra ones are dropped, at any depth
    of structs, arrays and values of maps. A value that cannot be cast becomes
    null and its path is listed once in ``_cast_errors``: ``a.b`` is a field,
    ``a[]`` an element, ``a{}`` a map's value. So is the path of a null in a
    column, field or element that ``schema`` says is never null; nothing is
    asked below a null.
    """
    out, errors = [], _no_errors()
    for f in schema.fields:
        there = f.name in df.columns
        value, found = _field(F.col(f"`{f.name}`") if there else None, df.schema[f.name].dataType if there else None, f, f.name)
        out.append(value.alias(f.name))
        errors = F.concat(errors, found)
    return df.select(*out, F.array_distinct(errors).alias("_cast_errors"))


def json_shape(df: DataFrame, col: str) -> DataFrame:
    """``path, json_type, n``: top-level keys of a JSON column with their types.

    Values that are no JSON object, no JSON, or name a key twice have no keys.
    A whole number beyond 64 bits is a number, not an integer.
    """
    parsed = df.select(F.try_parse_json(F.col(col).cast("string")).alias("_v"))
    keys = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key IS NOT NULL AND schema_of_variant(_v) LIKE 'OBJECT%'")
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0)
    names = {"VOID": "null", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "BOOLEAN": "boolean", "OBJECT": "object", "ARRAY": "array"}
    named = F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[kind], F.lit("string"))
    return keys.groupBy(F.col("key").alias("path"), named.alias("json_type")).agg(F.count(F.lit(1)).alias("n"))


def json_profile(df: DataFrame, col: str) -> DataFrame:
    """``json_shape`` with ``n_rows``, the number of rows of ``df``; no keys give no rows."""
    total = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return json_shape(df, col).crossJoin(F.broadcast(total))


def shape_drift(before: DataFrame, after: DataFrame, factor: float = 0.5) -> DataFrame:
    """Keys whose ``json_profile`` differs: ``path, change`` with added, removed, retyped or frequency.

    ``frequency`` is a key whose share of rows changed by more than ``factor`` of
    the share before; other keys that come or go don't change it.
    """

    def shares(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("json_type")), ",").alias(f"{p}_types"), (F.sum("n") / F.max("n_rows")).alias(f"{p}_share"))

    both = shares(before, "b").join(shares(after, "a"), "path", "full")
    change = (
        F.when(F.col("b_types").isNull(), "added")
        .when(F.col("a_types").isNull(), "removed")
        .when(F.col("b_types") != F.col("a_types"), "retyped")
        .when(F.abs(F.col("a_share") - F.col("b_share")) > factor * F.col("b_share"), "frequency")
    )
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def column_profile(df: DataFrame) -> DataFrame:
    """``column, n_rows, n_nulls, n_distinct`` in one pass; an empty table has zeros.

    Each row becomes a short row for each column, its number and two 64-bit
    digests of the value. Tasks keep the distinct ones with their counts, so
    only those go through the shuffle, and none of the values.
    """
    digests = [F.struct(F.lit(i).alias("i"), *(F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(k), F.col(f"`{c}`"))).alias(f"h{k}") for k in (0, 1))) for i, c in enumerate(df.columns)]
    values = df.select(F.inline(F.array(*digests))).groupBy("i", "h0", "h1").agg(F.count(F.lit(1)).alias("n"))
    counts = values.groupBy("i").agg(F.sum("n").alias("_rows"), F.sum(F.when(F.col("h0").isNull(), F.col("n")).otherwise(0)).alias("_nulls"), F.count("h0").alias("_distinct"))
    names = df.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("column")) for i, c in enumerate(df.columns)))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return names.join(F.broadcast(counts), "i", "left").select("column", zero(F.col("_rows")).alias("n_rows"), zero(F.col("_nulls")).alias("n_nulls"), zero(F.col("_distinct")).alias("n_distinct"))
