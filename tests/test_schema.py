"""Declared shapes and profiles on small tables made by hand."""

from pyspark.sql import types as T

from weirgate.operators import schema as S


def field(name, kind, nullable=True):
    return T.StructField(name, kind, nullable)


def test_conform_nested(spark):
    inner = T.StructType([field("b", T.ArrayType(T.IntegerType(), False)), field("c", T.StructType([field("d", T.IntegerType(), False)])), field("new", T.StringType())])
    schema = T.StructType([field("a", inner), field("m", T.MapType(T.StringType(), T.IntegerType())), field("l", T.ArrayType(T.StructType([field("x", T.DateType())]))), field("id", T.LongType(), False), field("gone", T.DoubleType(), False)])
    rows = [
        ((["1", "x", None], ("7",), "extra"), {"k": "1", "q": "no"}, [("2024-01-01",), ("bad",), None], "5"),
        (([], None, "e"), {}, [], None),
        ((None, (None,), None), None, None, "z"),
        (None, None, None, "1"),
    ]
    df = spark.createDataFrame(rows, "a struct<b: array<string>, c: struct<d: string>, more: string>, m map<string, string>, l array<struct<x: string>>, id string")
    got = S.conform(df, schema)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields[:-1]] == [(f.name, f.dataType.simpleString()) for f in schema.fields]
    rows = got.collect()
    assert [sorted(r["_cast_errors"]) for r in rows] == [["a.b[]", "gone", "l[].x", "m{}"], ["gone", "id"], ["a.c.d", "gone", "id"], ["gone"]]
    a = rows[0]["a"]
    assert (a["b"], a["c"]["d"], a["new"]) == ([1, None, None], 7, None)
    assert rows[0]["m"] == {"k": 1, "q": None} and [x and x["x"] and x["x"].isoformat() for x in rows[0]["l"]] == ["2024-01-01", None, None]
    assert rows[1]["a"]["c"] is None and rows[3]["a"] is None and [r["id"] for r in rows] == [5, None, None, 1]


def test_conform_of_other_shapes(spark):
    df = spark.createDataFrame([((1,), [1], 3)], "s struct<x: int>, l array<int>, `a.b` int")
    got = S.conform(df, T.StructType([field("s", T.IntegerType()), field("l", T.StructType([field("x", T.IntegerType())])), field("a.b", T.StringType())])).collect()[0]
    assert (got["s"], got["l"], got["a.b"], got["_cast_errors"]) == (None, None, "3", ["s", "l"])
    assert S.conform(df.limit(0), T.StructType([field("s", T.IntegerType())])).count() == 0


def test_drift_is_by_rows(spark):
    """Keys that come with others don't make those drift; a key that leaves half of the rows does."""
    shape = lambda rows: S.json_profile(spark.createDataFrame([(x,) for x in rows], "j string"), "j")
    before = shape(['{"a": 1, "b": 1}'] * 4)
    wide = shape(['{"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}'] * 4)
    assert {tuple(r) for r in S.shape_drift(before, wide).collect()} == {(k, "added") for k in "cdef"}
    rare = shape(['{"a": 1}'] * 3 + ['{"a": "x", "b": 1}'])
    assert {tuple(r) for r in S.shape_drift(before, rare).collect()} == {("a", "retyped"), ("b", "frequency")}
    assert {tuple(r) for r in S.shape_drift(before, shape(["[]", None])).collect()} == {("a", "removed"), ("b", "removed")}


def test_profile_of_odd_columns(spark):
    rows = [(1, "a", 0.0, None, [1]), (1, None, -0.0, None, [1, 2]), (2, "", float("nan"), None, None), (None, "a", float("nan"), None, [1])]
    df = spark.createDataFrame(rows, "i int, `s.t` string, d double, n string, l array<int>")
    got = {r["column"]: (r["n_rows"], r["n_nulls"], r["n_distinct"]) for r in S.column_profile(df).collect()}
    assert got == {"i": (4, 1, 2), "s.t": (4, 1, 2), "d": (4, 0, 2), "n": (4, 4, 0), "l": (4, 1, 2)}
    assert {tuple(r)[1:] for r in S.column_profile(df.limit(0)).collect()} == {(0, 0, 0)}
    plan = S.column_profile(df.select("i", "d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
