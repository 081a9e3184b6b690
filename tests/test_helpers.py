from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpact.codecs import CONSERVATIVE, STANDARD, Profile, literal_union
from sparkpact.contracts.lattice import Bounds, combine_admission, meet, non_null, nullable, union, unknown
from sparkpact.functions import json_text, null_rows, ranges


def test_lattice():
    n, u, x = non_null("a"), unknown("b"), nullable("c")
    assert union([n, u, x]).kind == "nullable" and union([n, u]).kind == "unknown" and union([n, n]).kind == "nonNull" and union([]).kind == "unknown"
    assert meet([x, n]).kind == "nonNull" and meet([x, x]).kind == "nullable" and meet([x, u]).kind == "unknown"
    assert combine_admission(["accepts", "unknown"]) == "unknown" and combine_admission(["unknown", "rejects"]) == "rejects"
    assert [Bounds(*b, "").cardinality for b in ((0, 0), (1, 1), (0, 1), (0, None), (2, 2))] == ["none", "one", "optional", "many", "many"]


def test_codecs():
    assert STANDARD.result_type(T.ArrayType(T.LongType())) == "list[int | None]"
    assert STANDARD.result_type(T.MapType(T.StringType(), T.DoubleType(), False)) == "dict[str, float]"
    assert CONSERVATIVE.result_type(T.LongType()) == "object"
    hooked = Profile("own", (lambda kind, rest: "Money" if isinstance(kind, T.DecimalType) else None,))
    assert hooked.result_type(T.ArrayType(T.DecimalType(10, 2), False)) == "list[Money]" and hooked.result_type(T.LongType()) == "int"
    assert literal_union(("a", "b")) == "Literal['a', 'b']"


def test_ranges(spark):
    r = lambda a, b, **k: ranges.make_range(F.lit(a).cast("int"), F.lit(b).cast("int"), **k)
    row = spark.range(1).select(
        ranges.overlaps(r(1, 5), r(5, 9)).alias("touch"), ranges.overlaps(r(1, 5, upper_inc=True), r(5, 9)).alias("meet"), ranges.adjacent(r(1, 5), r(5, 9)).alias("adjacent"),
        ranges.is_empty(r(3, 3)).alias("empty"), ranges.lower_infinite(r(None, 3)).alias("inf"), ranges.contains_value(r(None, 3), F.lit(-9)).alias("has"),
        ranges.lower_bound(ranges.intersection(r(1, 5), r(3, None))).alias("low"), ranges.upper_bound(ranges.intersection(r(1, 5), r(3, None))).alias("high"),
        ranges.contains_range(r(1, 9), r(2, 9)).alias("within"), ranges.contains_range(r(1, 9), r(2, 9, upper_inc=True)).alias("beyond"), ranges.strictly_left(r(1, 2), r(2, 3)).alias("before"),
        ranges.is_empty(ranges.intersection(r(1, 2), r(4, 5))).alias("apart"),
    ).first()
    assert row.asDict() == {"touch": False, "meet": True, "adjacent": True, "empty": True, "inf": True, "has": True, "low": 3, "high": 5, "within": True, "beyond": False, "before": True, "apart": True}


def test_json_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, "a"), (2, None)], "k int, v string")
    assert df.select(json_text.json_object(v=F.col("v")).alias("j")).first().j == '{"v":null}'
    got = {r.k: r.j for r in df.groupBy("k").agg(json_text.json_array_agg(F.col("v")).alias("j")).collect()}
    assert got == {1: '[null,"a"]', 2: "[null]"}


def test_row_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, None), (1, 2)], "a int, b int").withColumn("r", F.struct("a", "b"))
    got = df.select(null_rows.row_is_null(F.col("r"), ["a", "b"]).alias("n"), null_rows.row_is_not_null(F.col("r"), ["a", "b"]).alias("m")).collect()
    assert [(x.n, x.m) for x in got] == [(False, False), (True, False), (False, True)]
