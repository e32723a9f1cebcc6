"""Roll-ups, weighted means, profiles and distributions."""

from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables, query, rounded, sql_half_up
from hinterland.functions import area_code, zero_pad
from hinterland.operators.aggregates import (
    describe, descriptive_table, histogram, kde, measures_by_year, merge_rollups, propmiss,
    provider_pairs, quantiles, ratio_range, rollup, share_positive, threshold_share, weighted_mean,
)
from hinterland.operators.frame import apply_to_columns

RAW_SQL = """
SELECT lpad(CAST(l_orderkey AS VARCHAR), 15, '0') AS fips, l_suppkey AS frn,
       CAST(l_quantity AS INTEGER) AS down, CAST(round(l_tax * 100) AS INTEGER) AS up,
       l_linestatus FROM lineitem
"""
ROLLUP_SQL = """
SELECT substr(fips, 1, 14) AS fips, count(*) AS mcount, count(DISTINCT frn) AS pcount,
       round(avg(down), 3) AS download, round(avg(up), 3) AS upload
"""


def raw(t: Tables):
    """Line items as measurement rows: block code, provider, two integer speed tiers."""
    return t.lineitem.select(
        zero_pad("l_orderkey", 15).alias("fips"), F.col("l_suppkey").alias("frn"),
        F.col("l_quantity").cast("int").cast("string").alias("down"),
        F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("up"),
        F.lit(1).alias("transtech"), "l_linestatus",
    )


MEANS = {"download": "down", "upload": "up"}


@query("rollup_prefix", f"{ROLLUP_SQL} FROM ({RAW_SQL}) GROUP BY 1")
def rollup_prefix(t: Tables):
    return rollup(raw(t), "fips", 14, "frn", MEANS)


@query("merge_two_sources", f"""
WITH p AS (
  {ROLLUP_SQL} FROM ({RAW_SQL}) WHERE l_linestatus = 'O' GROUP BY 1
  UNION ALL {ROLLUP_SQL} FROM ({RAW_SQL}) WHERE l_linestatus = 'F' GROUP BY 1)
SELECT fips, CAST(sum(mcount) AS BIGINT) AS mcount, CAST(sum(pcount) AS BIGINT) AS pcount,
  {sql_half_up('sum(mcount * download) / sum(mcount)', 3)} AS download,
  {sql_half_up('sum(mcount * upload) / sum(mcount)', 3)} AS upload
FROM p GROUP BY fips
""")
def merge_two_sources(t: Tables):
    parts = [
        rollup(raw(t).where(F.col("l_linestatus") == s), "fips", 14, "frn", MEANS)
        for s in ("O", "F")
    ]
    return merge_rollups(parts, "fips").orderBy("fips")


DISTINCT_SQL = f"""
SELECT substr(fips, 1, 12) AS fips, count(*) AS mcount, count(DISTINCT frn) AS pcount FROM ({RAW_SQL}) GROUP BY 1
"""


def _by_status(t: Tables, **options):
    sources = [raw(t).where(F.col("l_linestatus") == s) for s in ("O", "F")]
    return sources, [rollup(s, "fips", 12, "frn", {}, **options) for s in sources]


@query("merge_distinct_exact", DISTINCT_SQL)
def merge_distinct_exact(t: Tables):
    """Providers of two sources, those of both counted once."""
    sources, parts = _by_status(t)
    pairs = [provider_pairs(s, "fips", 12, "frn", distinct=False) for s in sources]
    return merge_rollups(parts, "fips", means=[], pairs=pairs)


@query("merge_distinct_sketch", f"SELECT fips, pcount, TRUE AS within FROM ({DISTINCT_SQL})")
def merge_distinct_sketch(t: Tables):
    """The same from merged sketches: is the estimate within three standard errors, or one?"""
    _, parts = _by_status(t, sketch="providers")
    merged = merge_rollups(parts, "fips", means=[], sketch="providers").withColumnRenamed("pcount", "estimate")
    exact = raw(t).select(F.substring("fips", 1, 12).alias("fips"), "frn").groupBy("fips").agg(
        F.count_distinct("frn").alias("pcount"))
    gap = F.abs(F.col("estimate") - F.col("pcount"))
    return merged.join(exact, "fips").select(
        "fips", "pcount", (gap <= F.greatest(F.lit(1.0), F.col("pcount") * 3 * 1.04 / 64)).alias("within"))


@query("area_hierarchy", f"""
WITH bg AS (SELECT substr(fips, 1, 12) AS fips, count(*) AS mcount,
                   avg(down) AS download FROM ({RAW_SQL}) GROUP BY 1)
SELECT substr(fips, 1, 11) AS tract, CAST(sum(mcount) AS BIGINT) AS mcount,
       round(sum(download * mcount) / sum(mcount), 4) AS download
FROM bg GROUP BY 1
""")
def area_hierarchy(t: Tables):
    """Block to block group to a coarser prefix, means carried by their counts."""
    groups = rollup(raw(t), "fips", 12, "frn", {"download": "down"}, digits=None)
    tract = groups.withColumn("tract", F.substring(area_code("fips", "block_group"), 1, 11))
    merged = merge_rollups([tract], "tract", counts=["mcount"], means=["download"], digits=4)
    return merged


@query("county_wmean", """
SELECT s_nationkey, CAST(year(l_shipdate) AS INTEGER) AS year,
  round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS l_extendedprice,
  round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
""")
def county_wmean(t: Tables):
    rows = t.lineitem.select(
        "l_suppkey", F.year("l_shipdate").alias("year"), "l_extendedprice", "l_discount",
        "l_quantity",
    ).join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    out = weighted_mean(
        rows, ["l_extendedprice", "l_discount"], "l_quantity", ["s_nationkey", "year"]
    )
    return rounded(rounded(out, 4, "l_extendedprice"), 6, "l_discount")


@query("wmean_na_propagate", """
SELECT event_type, CASE WHEN count(v) = count(*) THEN round(sum(v * w) / sum(w), 4) END AS v
FROM (SELECT event_type, 1 + user_id % 9 AS w,
             CASE WHEN event_type <> 'error' OR event_id % 7 <> 0 THEN value END AS v
      FROM events) GROUP BY event_type
""")
def wmean_na_propagate(t: Tables):
    hidden = (F.col("event_type") != "error") | (F.col("event_id") % 7 != 0)
    rows = t.events.select(
        "event_type", (1 + F.col("user_id") % 9).alias("w"),
        F.when(hidden, F.col("value")).alias("v"),
    )
    return rounded(weighted_mean(rows, ["v"], "w", ["event_type"], na_propagate=True), 4, "v")


@query("describe_mean_sd", """
SELECT round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_sd,
  round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_tax), 6) AS l_tax_sd FROM lineitem
""")
def describe_mean_sd(t: Tables):
    out = describe(t.lineitem, ["l_quantity", "l_tax"])
    return apply_to_columns(out, out.columns, lambda c: F.round(c, 6))


@query("describe_by_year", """
WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice / 1e5 AS price,
                  CAST(o_orderstatus = 'F' AS INTEGER) AS done FROM orders),
l AS (
  SELECT 0 AS ord, 'price' AS var, 'mean' AS stat, avg(price) AS v FROM s
  UNION ALL SELECT 0, 'price', 'sd', stddev_samp(price) FROM s
  UNION ALL SELECT 1, 'done', 'mean', avg(done) FROM s
  UNION ALL SELECT 1, 'done', 'sd', stddev_samp(done) FROM s)
SELECT CAST(ord AS INTEGER) AS ord, var, stat,
       CASE WHEN v > 1 THEN round(v, 0) ELSE round(v, 2) END AS value FROM l
UNION ALL SELECT 2, 'N ' || CAST(year AS VARCHAR), 'n', CAST(count(*) AS DOUBLE)
FROM s GROUP BY year
""")
def describe_by_year(t: Tables):
    """Descriptive table: rounded means and SDs, then row counts a year."""
    rows = t.orders.select(
        F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 1e5).alias("price"),
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
    )
    return descriptive_table(rows, ["price", "done"], rounding=F.round)


YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]


@query("measures_by_year", """
WITH s AS (SELECT year(l_shipdate) AS y, l_quantity AS q, l_discount AS d FROM lineitem),
l AS (SELECT 0 AS ord, 'pdw2_q' AS var, 'mean' AS stat, y, avg(q) AS v FROM s GROUP BY y
  UNION ALL SELECT 0, 'pdw2_q', 'sd', y, stddev_samp(q) FROM s GROUP BY y
  UNION ALL SELECT 1, 'pdw2_d', 'mean', y, avg(d) FROM s GROUP BY y
  UNION ALL SELECT 1, 'pdw2_d', 'sd', y, stddev_samp(d) FROM s GROUP BY y)
SELECT CAST(ord AS INTEGER) AS ord, var, stat, """ + ", ".join(
    f"round(max(CASE WHEN y = {y} THEN v END), 4) AS \"{y}\"" for y in YEARS
) + " FROM l GROUP BY ord, var, stat")
def yearly_measures(t: Tables):
    rows = t.lineitem.select(
        F.year("l_shipdate").alias("year"), F.col("l_quantity").alias("pdw2_q"),
        F.col("l_discount").alias("pdw2_d"),
    )
    return measures_by_year(rows, ["pdw2_q", "pdw2_d"], digits=4, rounding=F.round)


@query("unique_and_rows", """
SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY 1
""")
def unique_and_rows(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers")
    )


@query("propmiss", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value,
                  CASE WHEN user_id % 3 <> 0 THEN event_type END AS event_type,
                  CAST(NULL AS VARCHAR) AS nothing FROM events)
SELECT 'event_id' AS variable, count(*) - count(event_id) AS nmiss, count(*) AS n,
       round((count(*) - count(event_id)) / count(*), 6) AS propmiss FROM e
UNION ALL SELECT 'value', count(*) - count(value), count(*),
  round((count(*) - count(value)) / count(*), 6) FROM e
UNION ALL SELECT 'event_type', count(*) - count(event_type), count(*),
  round((count(*) - count(event_type)) / count(*), 6) FROM e
UNION ALL SELECT 'nothing', count(*) - count(nothing), count(*),
  round((count(*) - count(nothing)) / count(*), 6) FROM e
""")
def missing_profile(t: Tables):
    rows = t.events.select(
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("event_type"),
        F.lit(None).cast("string").alias("nothing"),
    )
    return rounded(propmiss(rows), 6, "propmiss")


@query("hist_density", """
WITH v AS (SELECT value, least(CAST(floor((value - 1.0) / (10.0 / 30)) AS INTEGER), 29) AS bin
           FROM events WHERE value BETWEEN 1 AND 11)
SELECT CAST(b.bin AS INTEGER) AS bin, round(1 + b.bin * (10.0 / 30), 6) AS "left",
  round(1 + (b.bin + 1) * (10.0 / 30), 6) AS "right", count(v.value) AS n,
  round(count(v.value) / ((SELECT count(*) FROM v) * (10.0 / 30)), 6) AS density
FROM (SELECT unnest(range(30)) AS bin) b LEFT JOIN v ON v.bin = b.bin GROUP BY b.bin
""")
def hist_density(t: Tables):
    out = histogram(t.events, "value", bins=30, lo=1.0, hi=11.0)
    return rounded(out, 6, "left", "right", "density")


GRID = [float(g) for g in range(1, 52, 2)]


@query("kde_curve", f"""
WITH h AS (SELECT 0.9 * least(stddev_samp(l_quantity),
    (quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) / 1.34)
    * power(count(*), -0.2) AS h FROM lineitem)
SELECT x, round(avg(exp(-0.5 * power((l_quantity - x) / h, 2)) / (h * sqrt(2 * pi()))), 8) AS density
FROM lineitem, h, (SELECT unnest({GRID}) AS x) g GROUP BY x
""")
def kde_curve(t: Tables):
    return rounded(kde(t.lineitem, "l_quantity", GRID), 8, "density")


@query("threshold_share", """
SELECT l_returnflag, round(avg(CAST(l_quantity >= 25 AS INTEGER)), 6) AS old_threshold,
  round(avg(CAST(l_quantity >= 40 AS INTEGER)), 6) AS new_threshold
FROM lineitem GROUP BY 1
""")
def shares_above(t: Tables):
    out = threshold_share(
        t.lineitem, "l_quantity", {"old_threshold": 25, "new_threshold": 40}, ["l_returnflag"]
    )
    return rounded(out, 6, "old_threshold", "new_threshold")


@query("share_signs", """
SELECT c_mktsegment, round(avg(CAST(c_acctbal > 0 AS INTEGER)), 6) AS c_acctbal_gt0,
  round(avg(CAST(c_acctbal < 0 AS INTEGER)), 6) AS c_acctbal_lt0
FROM customer GROUP BY 1
""")
def share_signs(t: Tables):
    out = share_positive(t.customer, ["c_acctbal"], ["c_mktsegment"])
    return rounded(out, 6, "c_acctbal_gt0", "c_acctbal_lt0")


STEPS = [i / 10 for i in range(101)]


@query("ratio_range", """
WITH e AS (SELECT min(l_extendedprice) / min(l_quantity) AS lo,
                  max(l_extendedprice) / max(l_quantity) AS hi FROM lineitem)
SELECT CAST(i AS INTEGER) AS i, i / 10.0 AS x,
       round(i / 10.0 * (lo + (hi - lo) * i / 100.0), 4) AS y
FROM e, (SELECT unnest(range(101)) AS i) g
""")
def ratio_grid(t: Tables):
    return rounded(ratio_range(t.lineitem, "l_extendedprice", "l_quantity", STEPS), 4, "y")


@query("group_quantiles", """
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.025), 4) AS lo,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS med,
  round(quantile_cont(l_extendedprice, 0.975), 4) AS hi,
  round(avg(l_extendedprice), 4) AS mean
FROM lineitem GROUP BY 1, 2
""")
def group_quantiles(t: Tables):
    out = quantiles(
        t.lineitem, "l_extendedprice", [0.025, 0.5, 0.975], ["l_returnflag", "l_linestatus"],
        ["lo", "med", "hi"], means={"mean": lambda v: v},
    )
    return rounded(out, 4, "lo", "med", "hi", "mean")


@query("group_quantiles_sorted", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS q90
FROM lineitem GROUP BY 1
""")
def group_quantiles_sorted(t: Tables):
    out = quantiles(t.lineitem, "l_extendedprice", [0.1, 0.9], ["l_returnflag"], ["q10", "q90"])
    return rounded(out, 4, "q10", "q90")
