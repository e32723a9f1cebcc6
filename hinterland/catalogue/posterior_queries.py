"""Draw summaries, with embeddings as draw matrices and labels as fits."""

from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables, query, rounded
from hinterland.functions import inv_logit
from hinterland.operators.aggregates import ratio_range
from hinterland.operators.posterior import (
    Margin, draws_long, margin_mult, margin_quad, margin_tables, posterior_terms,
    regression_table,
)

GRID = [i / 10 for i in range(101)]


def draws(t: Tables):
    return t.embeddings.select(F.col("label").alias("fit"), F.col("embedding").alias("beta"))


TERMS_SQL = """
WITH d AS (SELECT label AS fit, CAST(i - 1 AS INTEGER) AS pos, 'beta[' || i || ']' AS term,
                  CAST(embedding[i] AS DOUBLE) AS value
           FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
s AS (SELECT fit, pos, term, avg(value) AS estimate, quantile_cont(value, 0.025) AS lo,
             quantile_cont(value, 0.975) AS hi FROM d
      WHERE pos < 13 OR pos > 20 GROUP BY 1, 2, 3)
"""
NUISANCE = r"^beta\[(1[4-9]|20|21)\]$"


@query("posterior_terms", TERMS_SQL + """
SELECT fit, pos, term, round(estimate, 3) + 0.0 AS estimate, round(lo, 3) + 0.0 AS lo,
  round(hi, 3) + 0.0 AS hi FROM s  -- adding 0 turns -0.0 into 0.0
""")
def terms(t: Tables):
    return posterior_terms(draws(t), drop=NUISANCE, rounding=F.round)


SHOWN = [*range(2, 14), *range(22, 31), 1]


def sql_text(c: str) -> str:
    return (rf"CASE WHEN regexp_replace(printf('%.3f', {c}), '\.?0+$', '') = '-0' THEN '0' "
            rf"ELSE regexp_replace(printf('%.3f', {c}), '\.?0+$', '') END")


@query("regression_table", TERMS_SQL + f""",
o AS (SELECT CAST(unnest(range({len(SHOWN)})) AS INTEGER) AS ord, unnest({SHOWN}) AS k),
c AS (SELECT fit, ord, term, 'estimate' AS stat, {sql_text('estimate')} AS text
      FROM s JOIN o ON pos = k - 1
      UNION ALL SELECT fit, ord, term, 'interval',
        '[' || {sql_text('lo')} || ',' || {sql_text('hi')} || ']' FROM s JOIN o ON pos = k - 1)
SELECT ord, term, stat, """ + ", ".join(
    f"max(CASE WHEN fit = {f} THEN text END) AS \"{f}\"" for f in range(10)
) + f""" FROM c GROUP BY ord, term, stat
UNION ALL SELECT {len(SHOWN)}, 'unique', 'n', """ + ", ".join(["u"] * 10) + f"""
FROM (SELECT CAST(count(DISTINCT label) AS VARCHAR) AS u FROM embeddings)
UNION ALL SELECT {len(SHOWN) + 1}, 'N', 'n', """ + ", ".join(["u"] * 10) + """
FROM (SELECT CAST(count(*) AS VARCHAR) AS u FROM embeddings)
""")
def coefficient_table(t: Tables):
    summary = posterior_terms(draws(t), digits=None, drop=NUISANCE)
    counts = t.embeddings.agg(
        F.count_distinct("label").alias("unique"), F.count("*").alias("N")
    )
    return regression_table(
        summary, [str(f) for f in range(10)], [f"beta[{k}]" for k in SHOWN], counts
    )


EFFECT_SQL = """
SELECT fit, round(x + 1, 4) AS x, round(quantile_cont(effect, 0.025), 5) + 0.0 AS lo_ci,
  round(quantile_cont(effect, 0.5), 5) + 0.0 AS med, round(avg(effect), 5) + 0.0 AS mean,
  round(quantile_cont(effect, 0.975), 5) + 0.0 AS hi_ci,
  round(avg(CAST(effect > 0 AS INTEGER)), 5) AS gt0
"""
EFFECT = ["x", "lo_ci", "med", "mean", "hi_ci", "gt0"]


def shown(df):
    return rounded(rounded(df, 4, "x"), 5, *EFFECT[1:])


def sql_slope(i: int, j: int, x: str, b: str = "embedding") -> str:
    return f"(CAST({b}[{i}] AS DOUBLE) + 2 * CAST({b}[{j}] AS DOUBLE) * {x})"


@query("margin_quad", EFFECT_SQL + f"""
FROM (SELECT label AS fit, i / 10.0 AS x, {sql_slope(1, 2, '(i / 10.0)')} AS effect
      FROM embeddings, (SELECT unnest(range(101)) AS i)) GROUP BY fit, x
""")
def quad(t: Tables):
    return shown(margin_quad(draws_double(t), 0, 1, GRID))


@query("margin_mult", f"""
WITH e AS (SELECT min(l_tax + 0.01) / min(l_quantity) AS lo, max(l_tax + 0.01) / max(l_quantity) AS hi
           FROM lineitem),
g AS (SELECT i / 10.0 AS x, i / 10.0 * (lo + (hi - lo) * i / 100.0) AS y
      FROM e, (SELECT unnest(range(101)) AS i))
""" + EFFECT_SQL + f"""
FROM (SELECT label AS fit, x, {sql_slope(1, 2, 'x')} + {sql_slope(3, 4, 'y')} AS effect
      FROM embeddings, g) GROUP BY fit, x
""")
def mult(t: Tables):
    speeds = t.lineitem.select(
        F.col("l_quantity").alias("down"), (F.col("l_tax") + 0.01).alias("up")
    )
    return shown(margin_mult(draws_double(t), (0, 1), (2, 3), ratio_range(speeds, "up", "down", GRID)))


def draws_double(t: Tables):
    """Single precision draws widened once, so that effects are computed in double."""
    return draws(t).withColumn("beta", F.col("beta").cast("array<double>"))


KINDS = {"dl": (0, 1), "ul": (2, 3), "pc": (4, 5)}


@query("margin_tables", EFFECT_SQL.replace("SELECT fit,", "SELECT fit, type,") + " FROM (" +
       " UNION ALL ".join(
           f"SELECT CAST(label AS VARCHAR) AS fit, '{k}' AS type, i / 10.0 AS x, "
           f"{sql_slope(i + 1, j + 1, '(i / 10.0)')} AS effect FROM embeddings, "
           "(SELECT unnest(range(101)) AS i)" for k, (i, j) in KINDS.items()
       ) + ") GROUP BY fit, type, x")
def many_margins(t: Tables):
    named = draws_double(t).withColumn("fit", F.col("fit").cast("string"))
    wanted = [Margin(str(f), k, i, j) for f in range(10) for k, (i, j) in KINDS.items()]
    return shown(margin_tables(named, wanted, GRID))


@query("inv_logit_fit", """
SELECT fit, pos, round(avg(1 / (1 + exp(-value))), 6) AS p FROM (
  SELECT label AS fit, CAST(i - 1 AS INTEGER) AS pos, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)) GROUP BY 1, 2
""")
def inv_logit_fit(t: Tables):
    return (
        draws_long(draws(t)).groupBy("fit", "pos")
        .agg(F.round(F.avg(inv_logit("value")), 6).alias("p"))
    )
