import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hinterland.operators.aggregates import (
    key_value, order_key,
    describe, histogram, kde, merge_rollups, propmiss, quantiles, ratio_range, rollup,
    weighted_mean,
)

RAW = "fips string, frn string, down string, up string"
MEANS = {"download": "down", "upload": "up"}


def test_rollup_nulls_and_blanks(spark):
    raw = spark.createDataFrame(
        [("0100100", "p", "4", ""), ("0100111", "p", "", ""), ("0200100", "q", None, "3")], RAW)
    got = {r["fips"]: r for r in rollup(raw, "fips", 5, "frn", MEANS).collect()}
    assert (got["01001"]["mcount"], got["01001"]["pcount"]) == (2, 1)
    assert got["01001"]["download"] == 4.0 and got["01001"]["upload"] is None
    zero = rollup(raw, "fips", 5, "frn", MEANS, blank_as_zero=True)
    got = {r["fips"]: r for r in zero.collect()}
    assert got["01001"]["download"] == 2.0 and got["02001"]["download"] is None


def test_merge_of_split_equals_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{i % 7:05d}", str(i % 5), str(int(v)), str(int(u)), i % 2)
            for i, (v, u) in enumerate(rng.integers(1, 12, (500, 2)))]
    raw = spark.createDataFrame(rows, RAW + ", src int")
    parts = [rollup(raw.where(F.col("src") == s), "fips", 5, "frn", MEANS, digits=None)
             for s in (0, 1)]
    merged = {r["fips"]: r for r in merge_rollups(parts, "fips", digits=None).collect()}
    whole = {r["fips"]: r for r in rollup(raw, "fips", 5, "frn", MEANS, digits=None).collect()}
    for k, w in whole.items():
        assert merged[k]["mcount"] == w["mcount"]
        assert merged[k]["download"] == pytest.approx(w["download"])


def test_merge_counts_only_rows_with_a_value(spark):
    part = spark.createDataFrame(
        [("a", 2, 1, 3.0, None), ("a", 1, 1, None, 4.0)],
        "fips string, mcount int, pcount int, download double, upload double")
    got = merge_rollups([part], "fips").first()
    assert (got["mcount"], got["download"], got["upload"]) == (3, 3.0, 4.0)
    ints = spark.createDataFrame(
        [("a", 2, 1, 3.0, 1.0), ("a", 1, 1, 4.0, 1.0)],
        "fips string, mcount int, pcount int, download double, upload double")
    assert merge_rollups([ints], "fips").first()["download"] == 3.333


def test_weighted_mean_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", None, 5), ("b", 3.0, 0)],
                               "g string, x double, w int")
    skip = {r["g"]: r["x"] for r in weighted_mean(df, ["x"], "w", ["g"]).collect()}
    assert skip == {"a": 1.0, "b": None}
    na = weighted_mean(df, ["x"], "w", ["g"], na_propagate=True)
    assert {r["g"]: r["x"] for r in na.collect()} == {"a": None, "b": None}


def test_single_row_deviation_is_null(spark):
    got = describe(spark.createDataFrame([(1.0,)], "x double"), ["x"]).first()
    assert (got["x_mean"], got["x_sd"]) == (1.0, None)


def test_propmiss_order(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 3)], "a int, b int, c int")
    got = [(r["variable"], r["nmiss"], r["propmiss"]) for r in propmiss(df).collect()]
    assert got == [("a", 0, 0.0), ("c", 1, 0.5), ("b", 2, 1.0)]


def test_histogram_integrates_to_one(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1.2, 5, 10.999, 11, 12, 0.5]], "v double")
    rows = histogram(df, "v", bins=30).collect()
    assert len(rows) == 30 and sum(r["n"] for r in rows) == 5
    assert sum(r["density"] * (r["right"] - r["left"]) for r in rows) == pytest.approx(1)


def test_kde_matches_formula(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(5, 2, 300).round(1)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    q1, q3 = np.quantile(v, [0.25, 0.75])
    h = 0.9 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
    for r in kde(df, "v", [3.0, 5.0]).collect():
        want = np.exp(-0.5 * ((v - r["x"]) / h) ** 2).mean() / (h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want)


@pytest.mark.parametrize("values, h", [([3.0] * 5, 0.9 * 3 * 5**-0.2),
                                       ([0.0] * 4, 0.9 * 4**-0.2),
                                       ([1.0] * 9 + [5.0], None)])
def test_kde_without_spread_in_the_middle(spark, values, h):
    df = spark.createDataFrame([(x,) for x in values], "v double")
    v = np.array(values)
    h = h or 0.9 * v.std(ddof=1) * len(v) ** -0.2
    want = np.exp(-0.5 * ((v - 2.0) / h) ** 2).mean() / (h * np.sqrt(2 * np.pi))
    assert kde(df, "v", [2.0]).first()["density"] == pytest.approx(want)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"hot": rng.integers(0, 40, 3000).astype(float), "one": np.array([7.5]),
              None: rng.normal(size=11)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.025, 0.5, 0.975]
    got = quantiles(df, "x", probs, ["g"], ["lo", "med", "hi"],
                    means={"mean": lambda v: v}).collect()
    assert len(got) == 3
    for r in got:
        want = np.quantile(values[r["g"]], probs)
        assert [r["lo"], r["med"], r["hi"]] == pytest.approx(list(want))
        assert r["mean"] == pytest.approx(values[r["g"]].mean())


def test_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    row = quantiles(df, "x", [0.5, 0.333], means={"above": lambda v: (v > 50).cast("int")}).first()
    assert row["q0.5"] == 50 and row["q0.333"] == pytest.approx(33.3) and row["above"] == pytest.approx(50 / 101)


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.9999999999999999,
         1.0000000000000002, -1.0, 1.7976931348623157e308, -1.7976931348623157e308, 4.0, 3.9999999999999996, 8.0,
         1e22, 1e-22, float("inf"), float("-inf")]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, width=64) | st.sampled_from(EDGES), min_size=1, max_size=60))
def test_keys_order_doubles_and_come_back(spark, values):
    df = spark.createDataFrame([(v,) for v in values + EDGES], "x double").select("x", order_key(F.col("x")).alias("k"))
    rows = sorted((r.k, r.x, r.back) for r in df.withColumn("back", key_value(F.col("k"))).collect())
    assert [x for _, x, _ in rows] == sorted(values + EDGES)
    assert all(x == back for _, x, back in rows)
    assert all((a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(rows, rows[1:]))
    nan = spark.range(1).select(F.lit(float("nan")).alias("x")).select(order_key(F.col("x")).alias("k"))
    r = nan.select("k", key_value(F.col("k")).alias("x")).first()
    assert r.k > rows[-1][0] and r.x != r.x


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.floats(-1e9, 1e9)), min_size=1, max_size=80),
       st.lists(st.floats(0, 1), min_size=1, max_size=4, unique=True))
def test_quantiles_of_any_groups(spark, rows, probs):
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in quantiles(df, "x", probs, ["g"], [f"p{i}" for i in range(len(probs))]).collect()}
    assert got.keys() == {g for g, _ in rows}
    for g, r in got.items():
        want = np.quantile([x for k, x in rows if k == g], probs)
        assert [r[f"p{i}"] for i in range(len(probs))] == pytest.approx(list(want), rel=1e-12, abs=1e-12)


def test_quantiles_never_order_the_rows_of_a_group(spark):
    """Rows are only counted by (group, digits); windows run over counts."""
    df = spark.range(50_000).select((F.col("id") % 2).alias("g"), F.sin("id").alias("x"))
    out = quantiles(df, "x", [0.5], ["g"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "percentile" not in plan
    x = np.sin(np.arange(50_000))
    got = {r.g: r["q0.5"] for r in out.collect()}
    assert got == pytest.approx({0: np.median(x[::2]), 1: np.median(x[1::2])}, abs=1e-12)


def test_ratio_range(spark):
    df = spark.createDataFrame([(1.0, 2.0), (4.0, 4.0)], "u double, d double")
    got = {r["i"]: r["y"] for r in ratio_range(df, "u", "d", [0.0, 1.0, 2.0]).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.75, 2: 2.0})


def test_pairs_of_merged_sources_are_hashed_once(spark, tables):
    """A task holds one table of (area, provider) pairs, not one a source and more for their union."""
    from hinterland.catalogue import QUERIES

    plan = QUERIES["merge_distinct_exact"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.split("Initial Plan")[0].splitlines() if "Aggregate(keys=[" in line and "frn" in line.split("]")[0]]
    assert len(keyed) == 2  # before and after the shuffle
