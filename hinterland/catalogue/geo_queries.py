"""Distance, neighbourhood and polygon queries."""

from pyspark.sql import functions as F

from hinterland.catalogue.registry import (
    Tables, query, rounded, sql_half_up, sql_metres, sql_point, with_point,
)
from hinterland.functions import distance_weight, great_circle, zero_pad
from hinterland.operators.aggregates import weighted_mean
from hinterland.operators.distance import nearest_join, popdist_weighted_mean
from hinterland.operators.frame import derive
from hinterland.operators.regions import neighbour_set, points_in_polygons, segments, vertex_join
from hinterland.plans.measures import merged_measures

MILES = 0.000621371  # fixed value: miles in a metre

CENTRES_SQL = f"""
WITH centres AS (
  SELECT c_custkey, c_nationkey, c_acctbal, {sql_point('c_custkey')},
         CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 11 AS DOUBLE) END AS download,
         CAST(1 + c_custkey % 7 AS DOUBLE) AS pcount
  FROM customer),
schools AS (SELECT s_suppkey, s_nationkey, {sql_point('s_suppkey')} FROM supplier)
"""


def centres(t: Tables):
    k = F.col("c_custkey")
    return with_point(t.customer, "c_custkey").select(
        "c_custkey", "c_nationkey", "c_acctbal", "lon", "lat", "pop",
        F.when(k % 13 != 0, (k % 11).cast("double")).alias("download"),
        (1 + k % 7).cast("double").alias("pcount"),
    )


def schools(t: Tables):
    return with_point(t.supplier, "s_suppkey").select("s_suppkey", "s_nationkey", "lon", "lat")


@query("pdw_mean", CENTRES_SQL + f"""
SELECT s_suppkey,
  round(sum(c_acctbal * pop * w) / sum(pop * w), 4) AS pdw2_c_acctbal,
  round(sum(download * pop * w) / sum(CASE WHEN download IS NOT NULL THEN pop * w END), 4)
    AS pdw2_download,
  round(sum(pcount * pop * w) / sum(pop * w), 4) AS pdw2_pcount
FROM (SELECT s.s_suppkey, c.*, power(greatest({sql_metres('s', 'c')}, 1.0), -2) AS w
      FROM schools s CROSS JOIN centres c)
GROUP BY s_suppkey
""")
def pdw_mean(t: Tables):
    out = popdist_weighted_mean(
        schools(t), centres(t), ["c_acctbal", "download", "pcount"], "s_suppkey"
    )
    return rounded(out, 4, "pdw2_c_acctbal", "pdw2_download", "pdw2_pcount")


@query("pdw_mean_by_group", CENTRES_SQL + f"""
SELECT nation, s_suppkey,
  round(sum(c_acctbal * pop * w) / sum(pop * w), 4) AS pdw1_c_acctbal,
  round(sum(pcount * pop * w) / sum(pop * w), 4) AS pdw1_pcount
FROM (SELECT s.s_nationkey AS nation, s.s_suppkey, c.*,
             power(greatest({sql_metres('s', 'c')}, 1.0), -1) AS w
      FROM schools s JOIN centres c ON s_nationkey = c_nationkey)
GROUP BY nation, s_suppkey
""")
def pdw_mean_by_group(t: Tables):
    out = popdist_weighted_mean(
        schools(t).withColumnRenamed("s_nationkey", "nation"),
        centres(t).withColumnRenamed("c_nationkey", "nation"),
        ["c_acctbal", "pcount"], "s_suppkey", by=["nation"], decay=1.0,
    )
    return rounded(out, 4, "pdw1_c_acctbal", "pdw1_pcount")


NEAREST_SQL = CENTRES_SQL + f""", nearest AS (
  SELECT nation, c_custkey, pop, s_suppkey, meters FROM (
    SELECT c_nationkey AS nation, c_custkey, c.pop, s_suppkey, {sql_metres('c', 's')} AS meters,
           row_number() OVER (PARTITION BY c_custkey
                              ORDER BY {sql_metres('c', 's')}, s_suppkey) AS rn
    FROM centres c JOIN schools s ON s_nationkey = c_nationkey) WHERE rn = 1)
"""


def nearest(t: Tables, **options):
    return nearest_join(
        centres(t).withColumnRenamed("c_nationkey", "nation"),
        schools(t).withColumnRenamed("s_nationkey", "nation"),
        "c_custkey", "s_suppkey", ["nation"], **options,
    )


@query("nearest_in_group", NEAREST_SQL + """
SELECT nation, c_custkey, s_suppkey, round(meters, 4) AS meters FROM nearest
""")
def nearest_in_group(t: Tables):
    return rounded(nearest(t), 4, "meters")


@query("nearest_large_group", f"""
WITH centres AS (SELECT c_custkey, c_mktsegment, {sql_point('c_custkey')} FROM customer),
places AS (SELECT c_custkey AS near_key, c_mktsegment AS segment, {sql_point('(c_custkey + 7)')}
           FROM customer)
SELECT segment, c_custkey, near_key, round(meters, 4) AS meters FROM (
  SELECT segment, c_custkey, near_key, {sql_metres('c', 'p')} AS meters,
         row_number() OVER (PARTITION BY c_custkey
                            ORDER BY {sql_metres('c', 'p')}, near_key) AS rn
  FROM centres c JOIN places p ON segment = c_mktsegment) WHERE rn = 1
""")
def nearest_large_group(t: Tables):
    """Groups with many ends, which take the walk through nested cells."""
    starts = with_point(t.customer, "c_custkey").withColumnRenamed("c_mktsegment", "segment")
    ends = with_point(
        t.customer.withColumn("k7", F.col("c_custkey") + 7), "k7"
    ).withColumnsRenamed({"c_mktsegment": "segment", "c_custkey": "near_key"})
    return rounded(nearest_join(starts, ends, "c_custkey", "near_key", ["segment"]), 4, "meters")


@query("nearest_wmean", NEAREST_SQL + f"""
SELECT nation, round(sum(meters * pop) / sum(pop) * {MILES}, 5) AS pwm_dist_oa
FROM nearest GROUP BY nation
""")
def nearest_wmean(t: Tables):
    joined = nearest(t).join(centres(t).select("c_custkey", "pop"), "c_custkey")
    mean = weighted_mean(
        joined.withColumnRenamed("meters", "pwm_dist_oa"), ["pwm_dist_oa"], "pop", ["nation"],
        scale=MILES,
    )
    return rounded(mean, 5, "pwm_dist_oa")


@query("distance_weights", f"""
WITH a AS (SELECT l_orderkey, l_linenumber, {sql_point('l_suppkey')} FROM lineitem),
b AS (SELECT o_orderkey, {sql_point('o_custkey')} FROM orders)
SELECT l_orderkey, l_linenumber, round(metres, 3) AS metres,
       round(p * power(greatest(metres, 1.0), -2) * 1e6, 6) AS weight
FROM (SELECT l_orderkey, l_linenumber, b.pop AS p, {sql_metres('a', 'b')} AS metres
      FROM a JOIN b ON l_orderkey = o_orderkey)
""")
def distance_weights(t: Tables):
    a = with_point(t.lineitem, "l_suppkey").select(
        "l_orderkey", "l_linenumber", F.col("lon").alias("lon1"), F.col("lat").alias("lat1")
    )
    b = with_point(t.orders, "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"), "lon", "lat", "pop"
    )
    d = derive(
        a.join(b, "l_orderkey"),
        metres=great_circle("lon1", "lat1", "lon", "lat"),
        weight=distance_weight("pop", "metres") * 1e6,
    )
    return rounded(d, 6, "weight").select(
        "l_orderkey", "l_linenumber", F.round("metres", 3).alias("metres"), "weight"
    )


def sql_rollup(status: str) -> str:
    return f"""
  SELECT substr(lpad(CAST(l_orderkey AS VARCHAR), 15, '0'), 1, 14) AS fips,
    CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS mcount,
    count(DISTINCT l_suppkey) AS pcount,
    {sql_half_up('avg(CAST(l_quantity AS INTEGER))', 3)} AS download,
    {sql_half_up('avg(CAST(round(l_tax * 100) AS INTEGER))', 3)} AS upload
  FROM lineitem WHERE l_linestatus = '{status}' GROUP BY 1, 2"""


@query("measure_pipeline", f"""
WITH p AS ({sql_rollup('O')} UNION ALL {sql_rollup('F')}),
m AS (SELECT fips, year, sum(pcount) AS pcount,
    {sql_half_up('sum(mcount * download) / sum(mcount)', 3)} AS download,
    {sql_half_up('sum(mcount * upload) / sum(mcount)', 3)} AS upload
  FROM p GROUP BY fips, year),
y AS (SELECT *, {sql_point('CAST(fips AS BIGINT)')} FROM m),
x AS (SELECT s_suppkey, {sql_point('s_suppkey')} FROM supplier)
SELECT year, s_suppkey, round(sum(download * pop * w) / sum(pop * w), 4) AS pdw2_download,
  round(sum(upload * pop * w) / sum(pop * w), 4) AS pdw2_upload,
  round(sum(pcount * pop * w) / sum(pop * w), 4) AS pdw2_pcount
FROM (SELECT x.s_suppkey, y.*, power(greatest({sql_metres('x', 'y')}, 1.0), -2) AS w
      FROM x CROSS JOIN y) GROUP BY year, s_suppkey
""")
def measure_pipeline(t: Tables):
    """From raw rows of two sources to yearly weighted measures around each institution."""
    raw = t.lineitem.select(
        zero_pad("l_orderkey", 15).alias("fullfipsid"), F.col("l_suppkey").alias("frn"),
        F.col("l_quantity").cast("int").alias("downloadspeed"),
        F.round(F.col("l_tax") * 100).cast("int").alias("uploadspeed"),
        F.year("l_shipdate").alias("year"), "l_linestatus",
    )
    sources = [raw.where(F.col("l_linestatus") == s) for s in ("O", "F")]
    areas = merged_measures(sources, by=["year"], n_chars=14)
    areas = with_point(areas.withColumn("k", F.col("fips").cast("long")), "k")
    years = raw.agg(F.collect_set("year").alias("y"))  # a handful of years
    places = schools(t).withColumn("year", F.explode(years.scalar()))
    names = ["download", "upload", "pcount"]
    out = popdist_weighted_mean(places, areas, names, "s_suppkey", by=["year"])
    return rounded(out, 4, *[f"pdw2_{n}" for n in names])


# Nations laid out on a 5 by 5 grid over the stand-in coordinates, one shape in each tile.

HALF_WIDTH, HALF_HEIGHT = 4.6437, 2.4961


def shapes(t: Tables, corners: list[tuple[float, float]]):
    k = F.col("n_nationkey")
    x = F.lit(-120) + (k % 5) * 9.3 + 4.65
    y = F.lit(25) + F.floor(k / 5) * 5 + 2.5
    vertices = F.posexplode(F.array(*[
        F.struct((x + dx * HALF_WIDTH).alias("long"), (y + dy * HALF_HEIGHT).alias("lat"))
        for dx, dy in corners
    ])).alias("order", "v")
    return t.nation.select(
        F.col("n_name").alias("polyname"), F.col("n_nationkey").alias("group"), vertices
    ).select("polyname", "group", "order", "v.long", "v.lat")


def locate(t: Tables, corners: list[tuple[float, float]]):
    points = with_point(t.orders.withColumn("k", F.col("o_orderkey") * 3 + F.col("o_custkey")), "k")
    names = t.nation.select(F.col("n_name").alias("polyname"), F.col("n_nationkey").alias("fips"))
    return points_in_polygons(
        points.select("o_orderkey", "lon", "lat"), shapes(t, corners), names=names
    ).select("o_orderkey", "polyname", "fips")


def sql_locate(test: str) -> str:
    return f"""
WITH points AS (SELECT o_orderkey, {sql_point('(o_orderkey * 3 + o_custkey)')} FROM orders),
tiles AS (SELECT n_name, n_nationkey, -120 + (n_nationkey % 5) * 9.3 + 4.65 AS x,
                 25 + (n_nationkey // 5) * 5 + 2.5 AS y FROM nation)
SELECT o_orderkey, n_name AS polyname, n_nationkey AS fips
FROM points LEFT JOIN tiles ON {test}
"""


@query("point_in_box", sql_locate(
    f"abs(lon - x) < {HALF_WIDTH} AND abs(lat - y) < {HALF_HEIGHT}"
))
def point_in_box(t: Tables):
    return locate(t, [(-1, -1), (1, -1), (1, 1), (-1, 1)])


@query("point_in_polygon", sql_locate(
    f"abs(lon - x) / {HALF_WIDTH} + abs(lat - y) / {HALF_HEIGHT} < 1"
))
def point_in_polygon(t: Tables):
    return locate(t, [(-1, 0), (0, -1), (1, 0), (0, 1)])


@query("scalar_attach", f"""
WITH p AS (SELECT c_custkey, {sql_point('c_custkey')} FROM customer),
o AS (SELECT round(avg(lon), 6) AS x, round(avg(lat), 6) AS y
      FROM (SELECT {sql_point('s_suppkey')} FROM supplier))
SELECT c_custkey, pop, round(lon, 3) AS xend, round(lat, 3) AS yend, x, y FROM p, o
""")
def scalar_attach(t: Tables):
    origin = with_point(t.supplier, "s_suppkey").agg(
        F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat")
    )
    places = with_point(t.customer, "c_custkey").select("c_custkey", "pop", "lon", "lat")
    return rounded(segments(origin, places), 3, "xend", "yend")


@query("neighbour_set", f"""
WITH pairs AS (
  SELECT DISTINCT c_nationkey AS orgfips, s_nationkey AS adjfips
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
near AS (SELECT * FROM pairs WHERE orgfips = 7
         UNION ALL SELECT DISTINCT orgfips, orgfips FROM pairs WHERE orgfips = 7),
c AS (SELECT n_nationkey, n_name, {sql_point('n_nationkey')} FROM nation)
SELECT orgfips, adjfips, n_name, round(lon, 3) AS clon, round(lat, 3) AS clat
FROM near LEFT JOIN c ON adjfips = n_nationkey
""")
def neighbours(t: Tables):
    pairs = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .where("c_nationkey <> s_nationkey")
        .select(F.col("c_nationkey").alias("orgfips"), F.col("s_nationkey").alias("adjfips"))
        .distinct()
    )
    centre = with_point(t.nation, "n_nationkey").select(
        F.col("n_nationkey").alias("adjfips"), "n_name",
        F.round("lon", 3).alias("clon"), F.round("lat", 3).alias("clat"),
    )
    return neighbour_set(pairs, 7).join(centre, "adjfips", "left")


@query("vertex_join", f"""
SELECT c_nationkey AS "group", c_custkey AS "order", round(lon, 3) AS long, round(lat, 3) AS lat,
       n
FROM (SELECT c_nationkey, c_custkey, {sql_point('c_custkey')} FROM customer)
LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey)
  ON s_nationkey = c_nationkey
ORDER BY 1, 2
""")
def vertices(t: Tables):
    ring = with_point(t.customer, "c_custkey").select(
        F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("order"),
        F.round("lon", 3).alias("long"), F.round("lat", 3).alias("lat"),
    )
    values = t.supplier.groupBy(F.col("s_nationkey").alias("group")).agg(F.count("*").alias("n"))
    return vertex_join(ring, values, "group")
