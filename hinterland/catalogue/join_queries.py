"""Panel joins and their NULL rules."""

from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables, query
from hinterland.operators.frame import derive, select_as
from hinterland.operators.joins import (
    join_renamed, keyed_join, left_chain, lookup, members, natural_left_join,
)


@query("panel_left_chain", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment, n_name, items, late
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS items FROM lineitem WHERE l_returnflag = 'N'
           GROUP BY l_orderkey) a ON a.l_orderkey = o_orderkey
LEFT JOIN (SELECT l_orderkey, count(*) AS late FROM lineitem WHERE l_linestatus = 'F'
           AND l_quantity BETWEEN 10 AND 40 GROUP BY l_orderkey) b ON b.l_orderkey = o_orderkey
""")
def panel_left_chain(t: Tables):
    spine = t.orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                               "c_mktsegment")
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")

    def lines(condition, name):
        return t.lineitem.where(condition).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.count("*").alias(name)
        )

    parts = [
        lines(F.col("l_returnflag") == "N", "items"),
        lines((F.col("l_linestatus") == "F") & F.col("l_quantity").between(10, 40), "late"),
    ]
    joined = left_chain(spine, parts, "o_orderkey")
    joined = lookup(lookup(joined, people, "o_custkey"), nations, "c_nationkey")
    return joined.select("o_orderkey", "year", "c_mktsegment", "n_name", "items", "late")


@query("panel_twice", """
SELECT c_custkey, CAST(yr AS INTEGER) AS year, urgent, low FROM
 (SELECT c_custkey, yr FROM customer,
         (SELECT DISTINCT year(o_orderdate) AS yr FROM orders)) s
LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS urgent FROM orders
           WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2) u ON u.o_custkey = c_custkey AND u.y = yr
LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS low FROM orders
           WHERE o_orderpriority = '5-LOW' GROUP BY 1, 2) l ON l.o_custkey = c_custkey AND l.y = yr
""")
def panel_twice(t: Tables):
    """One table joined twice under different filters, on a two-column key."""
    years = t.orders.agg(F.array_sort(F.collect_set(F.year("o_orderdate"))).alias("y"))
    spine = t.customer.select("c_custkey", F.explode(years.scalar()).alias("year"))

    def orders(priority, name):
        return (
            t.orders.where(F.col("o_orderpriority") == priority)
            .groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
            .agg(F.count("*").alias(name))
        )

    return left_chain(
        spine, [orders("1-URGENT", "urgent"), orders("5-LOW", "low")], ["c_custkey", "year"]
    )


@query("natural_fold", """
SELECT s.nationkey, s.suppkey, o.year, o.n_orders, n.regionkey, r.r_name
FROM (SELECT s_suppkey AS suppkey, s_nationkey AS nationkey FROM supplier) s
LEFT JOIN (SELECT c_nationkey AS nationkey, CAST(year(o_orderdate) AS INTEGER) AS year,
                  count(*) AS n_orders
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) o USING (nationkey)
LEFT JOIN (SELECT n_nationkey AS nationkey, n_regionkey AS regionkey FROM nation) n
  USING (nationkey)
LEFT JOIN (SELECT r_regionkey AS regionkey, r_name FROM region) r USING (regionkey)
""")
def natural_fold(t: Tables):
    suppliers = t.supplier.select(F.col("s_suppkey").alias("suppkey"),
                                  F.col("s_nationkey").alias("nationkey"))
    orders = (
        t.orders.select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
        .join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
        .groupBy(F.col("c_nationkey").alias("nationkey"), "year")
        .agg(F.count("*").alias("n_orders"))
    )
    nations = t.nation.select(F.col("n_nationkey").alias("nationkey"),
                              F.col("n_regionkey").alias("regionkey"))
    regions = t.region.select(F.col("r_regionkey").alias("regionkey"), "r_name")
    return natural_left_join(suppliers, orders, nations, regions)


@query("null_safe_join", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS k
           FROM orders),
c AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END AS k, count(*) AS n
      FROM orders GROUP BY 1)
SELECT o_orderkey, o.k, n FROM o LEFT JOIN c ON o.k IS NOT DISTINCT FROM c.k
""")
def null_safe_join(t: Tables):
    left = t.orders.select(
        "o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).alias("k")
    )
    right = t.orders.groupBy(
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("k")
    ).agg(F.count("*").alias("n"))
    return keyed_join(left, right, ["k"], "left", null_safe=True)


@query("right_join", """
SELECT n_nationkey, n_name, c_custkey
FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0) c
RIGHT JOIN nation ON c_nationkey = n_nationkey
""")
def right_join(t: Tables):
    rich = t.customer.where("c_acctbal > 0").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey")
    )
    return keyed_join(rich, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], "right")


@query("renamed_key_join", """
SELECT l_orderkey, l_linenumber, l_suppkey, s_name, s_acctbal
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
""")
def renamed_key_join(t: Tables):
    return join_renamed(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"),
        t.supplier.select("s_suppkey", "s_name", "s_acctbal"), {"l_suppkey": "s_suppkey"},
    )


@query("inner_outer_filter", """
SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal IS NOT NULL AND c_acctbal > 5000
""")
def inner_outer_filter(t: Tables):
    """A left join whose later filter makes Catalyst plan an inner join."""
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    joined = lookup(t.orders.select("o_orderkey", "o_custkey"), people, "o_custkey")
    return joined.where(F.col("c_acctbal").isNotNull() & (F.col("c_acctbal") > 5000)).select(
        "o_orderkey", "c_acctbal"
    )


@query("semi_members", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
  AND c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')
""")
def semi_members(t: Tables):
    wanted = t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    kept = t.customer.where(~F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"))
    return members(kept, wanted, "c_custkey", "o_custkey").select("c_custkey", "c_mktsegment")


@query("sentinel_flags", """
WITH s AS (SELECT p_partkey, CAST(p_size % 10 AS INTEGER) AS sector,
                  CAST(p_size % 4 - 1 AS INTEGER) AS code FROM part)
SELECT p_partkey, sector,
  CASE WHEN code = 2 THEN 0 WHEN code < 0 THEN NULL ELSE code END AS openadmp,
  CAST(sector > 3 AND sector < 7 AS INTEGER) AS twoyr,
  CAST(sector < 4 AS INTEGER) AS fouryr,
  CAST(sector IN (1, 4, 7) AS INTEGER) AS public,
  CAST(sector IN (2, 5, 8) AS INTEGER) AS privnp,
  CAST(sector IN (3, 6, 9) AS INTEGER) AS privfp,
  CASE WHEN p_partkey = 102 THEN 113 ELSE p_partkey END AS recoded
FROM s WHERE sector <> 0
""")
def sentinel_flags(t: Tables):
    from hinterland.functions import recode_sentinel
    from hinterland.plans.panel import sector_flags

    size = F.col("p_size")
    rows = derive(
        t.part.select("p_partkey", "p_size"),
        sector=(size % 10).cast("int"),
        openadmp=recode_sentinel((size % 4 - 1).cast("int"), {2: 0}),
        recoded=F.when(F.col("p_partkey") == 102, 113).otherwise(F.col("p_partkey")),
    ).where("sector <> 0")
    return select_as(rows, {
        "p_partkey": "p_partkey", "sector": "sector", "openadmp": "openadmp",
        **sector_flags("sector"), "recoded": "recoded",
    })
