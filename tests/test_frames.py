import pytest
from pyspark.sql import functions as F

from hinterland.functions import (
    academic_year_code, area_code, interval_text, inv_logit, lenient, month_number, number_text,
    paste, parenthesise, recode_sentinel, round_even, round_large, zero_pad,
)
from hinterland.operators.frame import (
    apply_to_columns, cols_between, cols_like, lower_names, one_hot, select_as, split_col,
    stack_rows, to_long, to_wide,
)
from hinterland.operators.joins import (
    attach_row, join_renamed, keyed_join, left_chain, lookup, members, natural_left_join,
)
from hinterland.operators.windows import (
    dense_index, first_per_key, running_total, with_group_mean,
)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("column, want", [
    (lambda: round_even(F.lit(2.5)), 2.0),
    (lambda: round_even(F.lit(3.5)), 4.0),
    (lambda: round_large(F.lit(12.6)), 13.0),
    (lambda: round_large(F.lit(0.126)), 0.13),
    (lambda: zero_pad(F.lit(1001), 5), "01001"),
    (lambda: zero_pad(F.lit(1234567), 5), "1234567"),
    (lambda: lenient(F.lit("(X)")), None),
    (lambda: lenient(F.lit("4.5")), 4.5),
    (lambda: paste(F.lit("01"), F.lit("003")), "01003"),
    (lambda: paste(F.lit("a"), F.lit(None), sep="_", null_text="NA"), "a_NA"),
    (lambda: paste(F.lit("a"), F.lit(None)), None),
    (lambda: academic_year_code(F.lit(2012)), "1112"),
    (lambda: month_number(F.lit("June")), 6),
    (lambda: month_number(F.lit("DECEMBER")), 12),
    (lambda: month_number(F.lit("x")), None),
    (lambda: area_code(F.lit("010030001002003"), "county"), "01003"),
    (lambda: number_text(F.lit(0.5)), "0.5"),
    (lambda: number_text(F.lit(-0.0001)), "0"),
    (lambda: number_text(F.lit(10.0)), "10"),
    (lambda: interval_text(F.lit(-1.25), F.lit(0.0)), "[-1.25,0]"),
    (lambda: parenthesise(F.lit("0.2")), "(0.2)"),
    (lambda: inv_logit(F.lit(0.0)), 0.5),
    (lambda: recode_sentinel(F.lit(2), {2: 0}), 0),
    (lambda: recode_sentinel(F.lit(1), {2: 0}), 1),
    (lambda: recode_sentinel(F.lit(-1), {2: 0}), None),
    (lambda: recode_sentinel(F.lit(-1), {2: 0}, negative_to_null=False), -1),
])
def test_scalar(spark, column, want):
    assert value(spark, column()) == want


def test_selection_and_reshape(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "ID int, p2012 int, p2013 int, Z int")
    low = lower_names(df)
    assert low.columns == ["id", "p2012", "p2013", "z"]
    assert cols_between(low, "p2012", "z") == ["p2012", "p2013", "z"]
    assert cols_like(low, r"^p\d") == ["p2012", "p2013"]
    long = to_long(low, ["id"], ["p2012", "p2013"], "year", "pop", r"(\d{4})$", "int")
    assert sorted(map(tuple, long.collect())) == [(1, 2012, 2), (1, 2013, 3)]
    wide = to_wide(long, ["id"], "year", "pop", [2012, 2013, 2014]).first()
    assert (wide["2012"], wide["2013"], wide["2014"]) == (2, 3, None)
    parts = split_col(spark.createDataFrame([("a_b_c",), ("d",)], "k string"), "k", ["x", "y"])
    assert sorted(map(tuple, parts.collect())) == [("a", "b"), ("d", None)]
    hot = one_hot(spark.createDataFrame([(2,), (None,)], "r int"), "r", [2, 3]).collect()
    assert [(r["r_2"], r["r_3"]) for r in hot] == [(1, 0), (None, None)]
    assert apply_to_columns(low, ["id", "z"], lambda c: c * 10).first()["z"] == 40
    assert select_as(low, {"unit": "id", "w": F.col("z") + 1}).first()["w"] == 5
    assert stack_rows(low.select("id"), low.select("z")).columns == ["id", "z"]


def test_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, b string")
    plain = {r["a"]: r["b"] for r in keyed_join(a, b, ["k"]).collect()}
    safe = {r["a"]: r["b"] for r in keyed_join(a, b, ["k"], null_safe=True).collect()}
    assert plain == {"x": "p", "y": None} and safe == {"x": "p", "y": "q"}
    right = keyed_join(a.where("a = 'x'"), b, ["k"], "right", null_safe=True)
    assert {(r["k"], r["b"]) for r in right.collect()} == {(1, "p"), (None, "q")}


def test_joins(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, g int")
    b = spark.createDataFrame([(1, "b1")], "k int, b string")
    c = spark.createDataFrame([(20, "c20")], "g int, c string")
    assert natural_left_join(a, b, c).columns == ["k", "g", "b", "c"]
    with pytest.raises(ValueError):
        natural_left_join(b, c)
    assert left_chain(a, [b, b.withColumnRenamed("b", "b2")], "k").count() == 2
    assert join_renamed(a, b.withColumnRenamed("k", "other"), {"k": "other"}).count() == 2
    assert members(a, c, "g").count() == 1
    assert attach_row(a, c, ["c"]).first()["c"] == "c20"
    twice = spark.createDataFrame([(1, "u"), (1, "v")], "k int, b string")
    with pytest.raises(ValueError):
        lookup(a, twice, "k", check=True)


def test_running_total_across_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = running_total(df, ["id"], F.lit(1), "upto", ["g"]).collect()
    assert all(r["upto"] == r["id"] // 3 + 1 for r in got) and len(got) == 1000
    nulls = spark.createDataFrame([(None, 1), (None, 2), (5, 3)], "g int, id int")
    got = {(r["g"], r["id"]): r["upto"] for r in
           running_total(nulls, ["id"], F.lit(1), "upto", ["g"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (5, 3): 1}


def test_index_has_no_gap_after_filter(spark):
    df = spark.createDataFrame([("01",), ("05",), ("05",), ("12",), (None,)], "stfips string")
    index = {r["stfips"]: r["n"] for r in
             dense_index(df.where("stfips is null or stfips <> '05'"), "stfips", "n").collect()}
    assert index == {"01": 1, "12": 2}


def test_first_per_key_and_group_mean(spark):
    df = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), ("b", 5, "w")],
        "k string, o int, v string")
    first = {r["k"]: r["v"] for r in first_per_key(df, ["k"], ["o"]).collect()}
    last = {r["k"]: r["v"] for r in first_per_key(df, ["k"], ["o"], nulls="last").collect()}
    assert first == {"a": "y", "b": "z"} and last == {"a": "y", "b": "w"}
    assert first_per_key(df, ["k"], ["o"]).columns == df.columns
    mean = with_group_mean(df, ["k"], ["o"], digits=2)
    assert {r["k"]: r["o_p"] for r in mean.collect()} == {"a": 1.5, "b": 5.0}
