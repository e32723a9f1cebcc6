"""Selection, recoding, reshaping and window queries."""

from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables, query, rounded, sql_half_up
from hinterland.functions import (
    academic_year_code, area_code, lenient, month_number, paste, zero_pad,
)
from hinterland.operators.aggregates import counts_by
from hinterland.operators.frame import (
    apply_to_columns, cols_between, cols_like, derive, one_hot, split_col, stack_rows, to_long,
    to_wide,
)
from hinterland.operators.windows import (
    dense_index, first_per_key, with_dense_index, with_group_mean,
)

YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) = {k} AS INTEGER) AS rucc_{k}"
    for k in range(2, 6)) + " FROM orders")
def one_hot_priority(t: Tables):
    coded = t.orders.select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("rucc")
    )
    return one_hot(coded, "rucc", range(2, 6), "rucc_").drop("rucc")


@query("col_range", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem
""")
def col_range(t: Tables):
    return t.lineitem.select(
        "l_orderkey", *cols_between(t.lineitem, "l_linenumber", "l_tax")
    )


@query("col_pattern", "SELECT p_partkey, p_type, p_size, p_name FROM part")
def col_pattern(t: Tables):
    return t.part.select(
        "p_partkey", *cols_like(t.part, "^p_(type|size)$"), *cols_like(t.part, "name$")
    )


@query("apply_cols", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / 7, 4) AS l_extendedprice,
       round(l_quantity / 7, 4) AS l_quantity FROM lineitem
""")
def apply_cols(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return apply_to_columns(
        rows, ["l_extendedprice", "l_quantity"], lambda c: F.round(c / 7, 4)
    )


@query("null_filters", r"""
SELECT event_id, k FROM (
  SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE '' END
                            || regexp_extract(props, ':\s*(\d+)', 1) AS DOUBLE) AS k
  FROM events) WHERE k IS NOT NULL AND k <> 0
""")
def null_filters(t: Tables):
    digits = F.regexp_extract("props", r":\s*(\d+)", 1)
    text = paste(F.when(F.col("event_id") % 7 == 0, "x").otherwise(""), digits)
    rows = t.events.select("event_id", lenient(text).alias("k"))
    return rows.where(F.col("k").isNotNull() & (F.col("k") != 0))


@query("derive_logs", f"""
SELECT o_orderkey, round(ln(o_totalprice), 6) AS lprice, round(ln(1 + o_totalprice), 6) AS l1price,
  round(ln(o_totalprice) * ln(o_totalprice), 6) AS lprice_sq,
  {sql_half_up('o_totalprice / nullif(o_custkey % 10, 0)', 4)} AS per_unit,
  CAST(year(o_orderdate) = 1996 AS INTEGER) AS year96,
  round_even(o_totalprice, 0) AS whole
FROM orders
""")
def derive_logs(t: Tables):
    d = derive(
        t.orders,
        lprice=F.log("o_totalprice"),
        lprice_sq=F.col("lprice") * F.col("lprice"),
        l1price=F.log1p("o_totalprice"),
        per_unit=F.try_divide("o_totalprice", F.nullif(F.col("o_custkey") % 10, F.lit(0))),
        year96=(F.year("o_orderdate") == 1996).cast("int"),
        whole=F.bround("o_totalprice", 0),
    )
    d = rounded(rounded(d, 6, "lprice", "lprice_sq", "l1price"), 4, "per_unit")
    return d.select(
        "o_orderkey", "lprice", "l1price", "lprice_sq", "per_unit", "year96", "whole"
    )


@query("key_index", """
SELECT c_custkey, c_name, CAST(idx AS INTEGER) AS ststan FROM customer JOIN (
  SELECT c_name AS k, row_number() OVER (ORDER BY c_name) AS idx
  FROM (SELECT DISTINCT c_name FROM customer)) ON k = c_name
""")
def key_index(t: Tables):
    """As many keys as rows: the index must not be made in one task."""
    return with_dense_index(t.customer.select("c_custkey", "c_name"), "c_name", "ststan")


@query("reindex_after_filter", """
SELECT s_nationkey, CAST(row_number() OVER (ORDER BY s_nationkey) AS INTEGER) AS ststan
FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey <> 12)
""")
def reindex_after_filter(t: Tables):
    """Positions without a gap once a group is gone."""
    return dense_index(t.supplier.where("s_nationkey <> 12"), "s_nationkey", "ststan")


@query("group_mutate", """
SELECT o_orderkey, o_custkey, round(avg(urgent) OVER w, 4) AS urgent_p,
       round(avg(done) OVER w, 4) AS done_p
FROM (SELECT o_orderkey, o_custkey, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent,
             CAST(o_orderstatus = 'F' AS INTEGER) AS done FROM orders)
WINDOW w AS (PARTITION BY o_custkey)
""")
def group_mutate(t: Tables):
    rows = t.orders.select(
        "o_orderkey", "o_custkey",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
    )
    out = with_group_mean(rows, ["o_custkey"], ["urgent", "done"], digits=4, rounding=F.round)
    return out.drop("urgent", "done")


@query("first_per_key", """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn = 1
""")
def first_order(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return first_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def yearly(t: Tables):
    """One row a customer nation, one column of order totals a year."""
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice",
                           F.year("o_orderdate").alias("year")).join(
        t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    sums = rows.groupBy("c_nationkey", "year").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return to_wide(sums, ["c_nationkey"], "year", "v")


YEARLY_SQL = """
SELECT c_nationkey, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS v
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
"""


@query("pivot_year", "SELECT c_nationkey, " + ", ".join(
    f"max(CASE WHEN year = {y} THEN v END) AS \"{y}\"" for y in YEARS
) + f" FROM ({YEARLY_SQL}) GROUP BY c_nationkey")
def pivot_year(t: Tables):
    return yearly(t)


@query("unpivot_year", f"""
SELECT c_nationkey, y.year, v FROM (SELECT DISTINCT c_nationkey FROM ({YEARLY_SQL})) n
CROSS JOIN (SELECT unnest({YEARS}) AS year) y
LEFT JOIN ({YEARLY_SQL}) s ON s.c_nationkey = n.c_nationkey AND s.year = y.year
""".replace("SELECT c_nationkey, y.year", "SELECT n.c_nationkey, y.year"))
def unpivot_year(t: Tables):
    wide = yearly(t)
    wide = wide.withColumnsRenamed({str(y): f"popestimate{y}" for y in YEARS})
    cols = cols_between(wide, f"popestimate{YEARS[0]}", f"popestimate{YEARS[-1]}")
    return to_long(wide, ["c_nationkey"], cols, "year", "v", r"(\d{4})$", "int")


@query("unpivot_split", """
SELECT l_returnflag, var, stat, round(value, 4) AS value FROM (
  SELECT l_returnflag, 'quantity' AS var, 'mean' AS stat, avg(l_quantity) AS value
  FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'quantity', 'sd', stddev_samp(l_quantity) FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'discount', 'mean', avg(l_discount) FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 'discount', 'sd', stddev_samp(l_discount) FROM lineitem GROUP BY 1)
""")
def unpivot_split(t: Tables):
    stats = t.lineitem.groupBy("l_returnflag").agg(*[
        f(f"l_{c}").alias(f"{c}_{s}")
        for c in ("quantity", "discount") for s, f in (("mean", F.avg), ("sd", F.stddev_samp))
    ])
    long = to_long(stats, ["l_returnflag"], stats.columns[1:])
    return rounded(split_col(long, "key", ["var", "stat"]), 4, "value")


@query("text_functions", r"""
SELECT l_orderkey, l_linenumber,
  substr(lpad(CAST(l_orderkey AS VARCHAR), 15, '0'), 1, 5) AS county,
  substr(lpad(CAST(l_orderkey AS VARCHAR), 15, '0'), 1, 2) AS state,
  lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS fips,
  CAST(year(l_shipdate) AS VARCHAR) || '_' || l_returnflag AS tag,
  printf('%02d', year(l_shipdate) - 1981) || printf('%02d', year(l_shipdate) - 1980) AS academic,
  CAST(month(l_shipdate) AS INTEGER) AS mon,
  '(' || l_linestatus || ')' AS status
FROM lineitem
""")
def text_functions(t: Tables):
    code = zero_pad("l_orderkey", 15)
    year = F.year("l_shipdate")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        area_code(code, "county").alias("county"), area_code(code, "state").alias("state"),
        zero_pad("l_suppkey", 5).alias("fips"),
        paste(year, "l_returnflag", sep="_").alias("tag"),
        academic_year_code(year + 20).alias("academic"),
        month_number(F.date_format("l_shipdate", "MMMM")).alias("mon"),
        F.concat(F.lit("("), F.col("l_linestatus"), F.lit(")")).alias("status"),
    )


@query("append_rows", """
SELECT o_orderpriority AS term, count(*) AS n, NULL AS share FROM orders GROUP BY 1
UNION ALL SELECT 'all', count(*), 1.0 FROM orders
""")
def append_rows(t: Tables):
    parts = counts_by(t.orders.withColumnRenamed("o_orderpriority", "term"), ["term"])
    total = t.orders.agg(F.count("*").alias("n")).select(
        F.lit("all").alias("term"), "n", F.lit(1.0).alias("share")
    )
    return stack_rows(parts, total)
