"""The survey panel and the covariate tables of the analysis panel."""

from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables, lat, lon, query
from hinterland.functions import paste, zero_pad
from hinterland.operators.frame import stack_rows
from hinterland.plans.analysis import county_population, finance, labour, state_population
from hinterland.plans.panel import institution_panel

#: Line items of a supplier, year and line number: the rows of the survey tables.
SURVEY_SQL = """
SELECT l_suppkey AS unitid, CAST(year(l_shipdate) AS INTEGER) AS year, l_linenumber AS code,
       CAST(count(*) AS INTEGER) AS n, CAST(sum(l_quantity) AS BIGINT) AS q
FROM lineitem GROUP BY 1, 2, 3
"""


def survey(t: Tables):
    return t.lineitem.groupBy(
        F.col("l_suppkey").alias("UNITID"), F.year("l_shipdate").alias("YEAR"),
        F.col("l_linenumber").alias("code"),
    ).agg(F.count("*").cast("int").alias("n"), F.sum("l_quantity").cast("long").alias("q"))


@query("survey_panel", f"""
WITH s AS ({SURVEY_SQL}),
header AS (
  SELECT unitid, year, substr(n_name, 1, 2) AS stabbr, s_nationkey * 1000 + s_suppkey AS fips,
         CASE WHEN s_suppkey % 12 = 11 THEN 99 ELSE s_suppkey % 12 END AS sector,
         -120 + ((s_suppkey * 7919) % 46500) / 1000.0 AS lon, 25 + ((s_suppkey * 104729) % 25000) / 1000.0 AS lat
  FROM (SELECT DISTINCT unitid, year FROM s) JOIN supplier ON s_suppkey = unitid
       JOIN nation ON n_nationkey = s_nationkey)
SELECT h.unitid, h.year, stabbr, fips, lon, lat,
  CASE WHEN c.n % 4 = 2 THEN 0 WHEN c.n % 4 = 3 THEN NULL ELSE c.n % 4 END AS openadmp,
  CASE WHEN c.q % 3 = 2 THEN 0 ELSE c.q % 3 END AS room,
  f.q AS efteug, a.q AS eftotlt, a.q - a.n AS eftotlw, CAST(a.n AS BIGINT) AS efwhitt,
  CASE WHEN p.n > 1 THEN CAST(p.q AS DOUBLE) END AS pttot,
  CASE WHEN o.n > 1 THEN CAST(o.q AS DOUBLE) END AS age25o,
  g.q AS upgrntn, g.n AS upgrntp, a.q AS efdetot, CAST(a.n AS BIGINT) AS efdesom, a.q // 2 AS efdeexc,
  a.q - a.n AS efdenon,
  CASE WHEN sector BETWEEN 4 AND 6 THEN 1 ELSE 0 END AS twoyr, CASE WHEN sector < 4 THEN 1 ELSE 0 END AS fouryr,
  CASE WHEN sector IN (1, 4, 7) THEN 1 ELSE 0 END AS public, CASE WHEN sector IN (2, 5, 8) THEN 1 ELSE 0 END AS privnp,
  CASE WHEN sector IN (3, 6, 9) THEN 1 ELSE 0 END AS privfp
FROM header h
LEFT JOIN s c ON c.unitid = h.unitid AND c.year = h.year AND c.code = 4
LEFT JOIN s f ON f.unitid = h.unitid AND f.year = h.year AND f.code = 3
LEFT JOIN s a ON a.unitid = h.unitid AND a.year = h.year AND a.code = 2
LEFT JOIN s p ON p.unitid = h.unitid AND p.year = h.year AND p.code = 1
LEFT JOIN s o ON o.unitid = h.unitid AND o.year = h.year AND o.code = 7
LEFT JOIN s g ON g.unitid = h.unitid AND g.year = h.year AND g.code = 5
WHERE sector NOT IN (0, 99) AND stabbr IN (SELECT substr(n_name, 1, 2) FROM nation WHERE n_regionkey < 4)
""")
def survey_panel(t: Tables):
    """All survey parts of all years at once; a missing part leaves NULLs, sentinels are recoded."""
    rows = survey(t)
    key = F.col("s_suppkey") % 12
    header = (
        rows.select("UNITID", "YEAR").distinct()
        .join(t.supplier.withColumnRenamed("s_suppkey", "UNITID").withColumn("s_suppkey", F.col("UNITID")), "UNITID")
        .join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
        .select("UNITID", "YEAR", F.substring("n_name", 1, 2).alias("STABBR"),
                (F.col("s_nationkey") * 1000 + F.col("s_suppkey")).alias("COUNTYCD"),
                F.when(key == 11, 99).otherwise(key).alias("SECTOR"),
                lon("s_suppkey").alias("LONGITUD"), lat("s_suppkey").alias("LATITUDE"))
    )

    def part(code: int, **columns):
        return rows.where(F.col("code") == code).select("UNITID", "YEAR", *[
            F.expr(v).alias(k) for k, v in columns.items()])

    text = "if(n > 1, string(q), 'n/a')"
    enrolment = [part(1, EFBAGE="1", LSTUDY="2", EFAGE06=text, EFAGE09="'x'"),
                 part(7, EFBAGE="7", LSTUDY="2", EFAGE06="'x'", EFAGE09=text),
                 part(6, EFBAGE="7", LSTUDY="1", EFAGE06=text, EFAGE09=text)]
    tables = {
        "header": header,
        "characteristics": part(4, OPENADMP="if(n % 4 = 3, -1, n % 4)", ROOM="q % 3"),
        "full_time_equivalent": part(3, EFTEUG="q"),
        "enrolment_a": rows.selectExpr(
            "UNITID", "YEAR", "code AS EFALEVEL", "q AS EFTOTLT", "q - n AS EFTOTLW", "bigint(n) AS EFWHITT"),
        "enrolment_b": stack_rows(*enrolment),
        "aid": part(5, UPGRNTN="q", UPGRNTP="n"),
        "distance": rows.selectExpr(
            "UNITID", "YEAR", "code AS EFDELEV", "q AS EFDETOT", "bigint(n) AS EFDESOM", "q div 2 AS EFDEEXC",
            "q - n AS EFDENON"),
    }
    states = t.nation.where("n_regionkey < 4").select(F.substring("n_name", 1, 2).alias("st"))
    return institution_panel(tables, states)


def population(t: Tables):
    """Suppliers as counties and nations as states, with one column a year."""
    years = range(2010, 2015)
    sold = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = [F.count_if(F.year("l_shipdate") == y - 18).alias(f"POPESTIMATE{y}") for y in years]
    state = zero_pad("s_nationkey", 2).alias("STATE")
    counties = sold.groupBy(F.lit("050").alias("SUMLEV"), state, zero_pad("s_suppkey", 3).alias("COUNTY"),
                            F.col("s_name").alias("CTYNAME")).agg(*counts)
    states = sold.groupBy(F.lit("040").alias("SUMLEV"), state, F.lit("000").alias("COUNTY"),
                          F.lit("all").alias("CTYNAME")).agg(*counts)
    return stack_rows(counties, states)


_POPULATION_SQL = """
SELECT stfips, fips, CASE WHEN fips IS NOT NULL THEN name END AS ctyname, year, CAST(pop AS BIGINT) AS pop, area, rucc,
  pop / nullif(area, 0) AS popdens
FROM (
  SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS stfips, {code} AS fips, {name} AS name, y.year,
    count(*) FILTER (year(l_shipdate) = y.year - 18) AS pop, {area} AS area, {rucc} AS rucc
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey, (VALUES (2012), (2013), (2014)) y(year) GROUP BY ALL)
"""
_CODE = """lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CASE WHEN s_suppkey > 999 THEN CAST(s_suppkey AS VARCHAR)
    ELSE lpad(CAST(s_suppkey AS VARCHAR), 3, '0') END"""


@query("population_by_year", f"""
{_POPULATION_SQL.format(code=_CODE, name="s_name", area="CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 10 END",
                        rucc="s_suppkey % 9")}
UNION ALL {_POPULATION_SQL.format(code="CAST(NULL AS VARCHAR)", name="'all'", area="CAST(NULL AS BIGINT)",
                                  rucc="CAST(NULL AS BIGINT)")}
""")
def population_by_year(t: Tables):
    """County and state population unpivoted to years, counties with area, density and rurality."""
    wide = population(t)
    code = paste(zero_pad("s_nationkey", 2), zero_pad("s_suppkey", 3))
    land = t.supplier.where("s_suppkey % 5 > 0").select(
        code.alias("STCOU"), F.expr("s_suppkey % 10").alias("LND110210D"))
    rurality = t.supplier.select(code.alias("FIPS"), F.expr("s_suppkey % 9").alias("RUCC_2013"))
    county = county_population(wide, land, rurality).select(
        "stfips", "fips", "ctyname", "year", F.col("countypop").alias("pop"), F.col("landarea").alias("area"),
        "rucc", "popdens")
    state = state_population(wide).withColumnRenamed("statepop", "pop")
    return county.unionByName(state, allowMissingColumns=True)


_RATES = {"HC01_EST_VC01": "count(*) * 1000", "HC02_EST_VC01": "50 + count(*) % 40", "HC03_EST_VC01": "40 + count(*) % 20",
          "HC04_EST_VC01": "count(*) % 13", "HC01_EST_VC22": "count(*) * 700", "HC01_EST_VC41": "count(*) * 90"}


def _labour_sql(prefix: str, where: str) -> str:
    p = prefix
    return f"""
SELECT *, {p}totpop - {p}totwhite AS {p}totnonwhite, round_even({p}totpop * {p}lforcepct / 100, 0) AS {p}labforce,
  round_even(round_even({p}totpop * {p}lforcepct / 100, 0) * {p}unemrate / 100, 0) AS {p}totunem
FROM (
  SELECT {where}, count(*) * 1000.0::DOUBLE AS {p}totpop, (50 + count(*) % 40)::DOUBLE AS {p}lforcepct,
    (40 + count(*) % 20)::DOUBLE AS {p}emppct, CASE WHEN count(*) % 7 > 0 THEN (count(*) % 13)::DOUBLE END AS {p}unemrate,
    (count(*) * 700)::DOUBLE AS {p}totwhite, (count(*) * 90)::DOUBLE AS {p}bahigh
  FROM customer GROUP BY ALL)"""


_STATE = "lpad(CAST(c_nationkey AS VARCHAR), 2, '0')"


@query("labour_rates", f"""
SELECT c.*, s.* EXCLUDE (stfips)
FROM ({_labour_sql("ct", f"{_STATE} || lpad(CAST(c_custkey % 40 AS VARCHAR), 3, '0') AS fips")}) c
JOIN ({_labour_sql("st", f"{_STATE} AS stfips")}) s ON s.stfips = substr(c.fips, 1, 2)
""".replace("SELECT c.*,", "SELECT c.*, s.stfips,", 1))
def labour_rates(t: Tables):
    """Labour statistics of counties next to their state's; text that is no number is NULL."""
    def sheet(code):
        rates = [F.when(F.expr("count(*) % 7") == 0, "(X)").otherwise(F.expr(f"string({v})")).alias(k)
                 if k == "HC04_EST_VC01" else F.expr(f"string({v})").alias(k) for k, v in _RATES.items()]
        return t.customer.groupBy(code.alias("GEO.id2")).agg(*rates)

    state = zero_pad("c_nationkey", 2)
    return labour(sheet(state), sheet(paste(state, zero_pad(F.col("c_custkey") % 40, 3))))


@query("state_finance", """
WITH o AS (
  SELECT CAST(year(o_orderdate) + 18 AS INTEGER) AS year, n_name AS stname, n_nationkey, count(*) AS n
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT year, stname, CAST(round_even(n / 2, 0) AS INTEGER) AS fte, n * 3 AS appropfte, n + 5 AS nettuitfte,
  n % 10 AS stuappropshare, CASE WHEN n_nationkey % 6 > 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS stfips
FROM o WHERE year BETWEEN 2012 AND 2014
""")
def state_finance(t: Tables):
    """A finance sheet renamed by position, three years of it, half counts rounded to even; the
    national row and other years go, states without a code stay."""
    orders = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    )
    n = F.count("*")
    columns = [(n / 2).alias("b"), (n * 3).alias("c"), (n + 5).alias("d"), (n % 10).alias("e")]
    year = (F.year("o_orderdate") + 18).alias("a")
    sheet = stack_rows(orders.groupBy(year, F.col("n_name").alias("s")).agg(*columns),
                       orders.groupBy(year, F.lit("US").alias("s")).agg(*columns))
    crosswalk = t.nation.where("n_nationkey % 6 > 0").select(
        zero_pad("n_nationkey", 2).alias("stfips"), F.col("n_name").alias("stname"))
    return finance(sheet, crosswalk)
