"""Design matrices, sufficient statistics and fitted models."""

import numpy as np
from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables, query, rounded
from hinterland.operators.beta_models import (
    fit_beta, fit_varying_beta, open_interval, packed_rows, score_sums,
)
from hinterland.operators.design import (
    centre_columns, design_matrix, gram, moments, sizes, thin_qr, triangle_entries,
)
from hinterland.operators.frame import one_hot
from hinterland.operators.normal_models import (
    fit_normal, fit_varying_normal, group_level, group_stats,
)
from hinterland.operators.posterior import OTHER_TERMS, posterior_terms
from hinterland.plans.models import ALL_FITS, fit_grid

PANEL_SQL = """
WITH panel AS (
  SELECT o_orderkey, ln(o_totalprice) AS y, c_acctbal / 1000 AS pdw2_download,
         CAST(o_orderstatus = 'F' AS INTEGER) AS done, c_nationkey,
         CAST(substr(o_orderpriority, 1, 1) = '2' AS INTEGER) AS rucc_2,
         CAST(substr(o_orderpriority, 1, 1) = '3' AS INTEGER) AS rucc_3
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""


def panel(t: Tables):
    """Orders as institutions: log price, a measure, flags, nation as state."""
    people = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                               (F.col("c_acctbal") / 1000).alias("pdw2_download"))
    rows = t.orders.select(
        "o_orderkey", "o_custkey", F.log("o_totalprice").alias("y"), "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("rucc"),
    )
    return one_hot(rows, "rucc", [2, 3], "rucc_").join(people, "o_custkey")


COVARIATES = ["done", "rucc_2", "rucc_3"]


def design(t: Tables, y: str = "y"):
    return design_matrix(
        panel(t), y, ["pdw2_download"], COVARIATES, "c_nationkey", keep=["o_orderkey"]
    )


def states(t: Tables):
    """One row a nation: a second-level covariate and its region."""
    wealth = t.customer.groupBy(F.col("c_nationkey")).agg(F.avg("c_acctbal").alias("wealth"))
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return group_level(nations.join(wealth, "c_nationkey"), "c_nationkey", ["wealth"],
                       "n_regionkey")


@query("design_matrix", PANEL_SQL + """
SELECT o_orderkey, c_nationkey, round(y, 6) AS y, round(pdw2_download, 6) AS x1,
  round(pdw2_download * pdw2_download, 6) AS x2, CAST(done AS DOUBLE) AS x3,
  CAST(rucc_2 AS DOUBLE) AS x4, CAST(rucc_3 AS DOUBLE) AS x5 FROM panel
""")
def design_rows(t: Tables):
    rows, names = design(t)
    cols = [F.col("x")[i].alias(f"x{i + 1}") for i in range(len(names))]
    return rounded(rows.select("o_orderkey", "c_nationkey", "y", *cols), 6, "y", "x1", "x2")


@query("design_sizes", PANEL_SQL + """
SELECT count(*) AS N, CAST(5 AS INTEGER) AS K, count(DISTINCT c_nationkey) AS J FROM panel
""")
def design_sizes(t: Tables):
    return sizes(design(t)[0], "c_nationkey")


@query("centre_columns", """
SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (), 5) AS l_quantity,
  round(l_discount - avg(l_discount) OVER (), 5) AS l_discount FROM lineitem
""")
def centred(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(centre_columns(rows, ["l_quantity", "l_discount"]), 5,
                   "l_quantity", "l_discount")


NUMBERS = ["l_quantity", "l_discount", "l_tax"]


@query("gram_entries", " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, round(sum({a} * {b}), 3) AS value FROM lineitem"
    for k, a in enumerate(NUMBERS) for b in NUMBERS[k:]
))
def gram_entries(t: Tables):
    return rounded(gram(t.lineitem, NUMBERS), 3, "value")


WIDE = [f"q{k}" for k in range(1, 15)]


@query("gram_wide", "WITH w AS (SELECT " + ", ".join(
    f"l_quantity * {k} / 100 + l_tax * ({k} % 4) AS q{k}" for k in range(1, 15)
) + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, round(sum({a} * {b}), 3) AS value FROM w"
    for k, a in enumerate(WIDE) for b in WIDE[k:]
))
def gram_wide(t: Tables):
    """More columns than one generated method holds."""
    wide = t.lineitem.select(*[
        (F.col("l_quantity") * k / 100 + F.col("l_tax") * (k % 4)).alias(f"q{k}")
        for k in range(1, 15)
    ])
    return rounded(gram(wide, WIDE), 3, "value")


@query("thin_qr", f"""
WITH c AS (SELECT {", ".join(f"covar_samp({a}, {b}) AS c{i}{j}" for i, a in enumerate(NUMBERS)
                            for j, b in enumerate(NUMBERS) if j >= i)} FROM lineitem),
r1 AS (SELECT *, sqrt(c00) AS r00, c01 / sqrt(c00) AS r01, c02 / sqrt(c00) AS r02 FROM c),
r2 AS (SELECT *, sqrt(c11 - r01 * r01) AS r11 FROM r1),
r3 AS (SELECT *, (c12 - r01 * r02) / r11 AS r12 FROM r2),
r4 AS (SELECT *, sqrt(c22 - r02 * r02 - r12 * r12) AS r22 FROM r3)
""" + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, round(r{i}{j}, 6) AS value FROM r4"
    for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if j >= i))
def qr_factor(t: Tables):
    """R of the thin QR of centred columns, scaled as the models scale it."""
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), F.array(*NUMBERS).alias("x"))
    r = thin_qr(rows, len(NUMBERS)).factor()
    return rounded(triangle_entries(t.spark, r, NUMBERS), 6, "value")


@query("ols_coef", """
SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 4) AS estimate,
       round(avg(l_extendedprice), 4) AS alpha FROM lineitem
""")
def ols_coef(t: Tables):
    rows = t.lineitem.select(
        F.col("l_extendedprice").alias("y"), F.array("l_quantity").alias("x")
    )
    fitted = fit_normal(rows, ["l_quantity"])
    # The fit reads the whole table; its few coefficients come back as one literal row.
    return t.spark.range(1).select(
        F.lit("l_quantity").alias("term"),
        F.round(F.lit(float(fitted.beta[0])), 4).alias("estimate"),
        F.round(F.lit(fitted.alpha), 4).alias("alpha"),
    )


@query("state_suffstats", PANEL_SQL + """
SELECT c_nationkey, count(*) AS n, round(sum(y), 4) AS sy, round(sum(y * y), 4) AS syy,
  round(sum(pdw2_download), 4) AS sx1, round(sum(pdw2_download * pdw2_download), 4) AS sx2,
  CAST(sum(done) AS DOUBLE) AS sx3
FROM panel GROUP BY 1
""")
def state_suffstats(t: Tables):
    rows, names = design(t)
    out = group_stats(rows, "c_nationkey", len(names)).select(
        "c_nationkey", "n", "sy", "syy",
        *[F.col("sx")[i].alias(f"sx{i + 1}") for i in range(3)],
    )
    return rounded(out, 4, "sy", "syy", "sx1", "sx2")


@query("normal_draws")
def normal_draws(t: Tables):
    rows, names = design(t)
    return posterior_terms(fit_normal(rows, names).draws, names)


@query("normal_fit", """
WITH m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem),
c AS (SELECT covar_samp(l_quantity, l_quantity) AS c11, covar_samp(l_quantity, l_discount) AS c12,
        covar_samp(l_discount, l_discount) AS c22, covar_samp(l_quantity, l_extendedprice) AS c1,
        covar_samp(l_discount, l_extendedprice) AS c2, covar_samp(l_extendedprice, l_extendedprice) AS cy FROM lineitem),
b AS (SELECT *, (c22 * c1 - c12 * c2) / (c11 * c22 - c12 * c12) AS b1,
        (c11 * c2 - c12 * c1) / (c11 * c22 - c12 * c12) AS b2 FROM c, m)
SELECT round(b1, 4) AS l_quantity, round(b2, 2) AS l_discount, round(my, 4) AS alpha,
  round(sqrt((cy - b1 * c1 - b2 * c2) * (n - 1) / (n - 4)), 3) AS residual,
  round(sqrt(c22 / (c11 * c22 - c12 * c12) / (n - 1)) * 1000, 6) AS spread_1,
  round(sqrt(c11 / (c11 * c22 - c12 * c12) / (n - 1)), 6) AS spread_2
FROM b
""")
def normal_fit(t: Tables):
    """Coefficients, intercept, residual deviation and unscaled deviations of the slopes."""
    rows = t.lineitem.select(F.col("l_extendedprice").alias("y"), F.array("l_quantity", "l_discount").alias("x"))
    f = fit_normal(rows, ["l_quantity", "l_discount"], draws=1, chains=1)
    spread = np.sqrt(np.diag(f.cov_unscaled))
    out = t.spark.createDataFrame(
        [(float(f.beta[0]), float(f.beta[1]), f.alpha, float(np.sqrt(f.sse / (f.n - 4))), float(spread[0] * 1000), float(spread[1]))],
        "l_quantity double, l_discount double, alpha double, residual double, spread_1 double, spread_2 double")
    out = rounded(rounded(out, 4, "l_quantity", "alpha"), 2, "l_discount")
    return rounded(rounded(out, 3, "residual"), 6, "spread_1", "spread_2")


@query("vi_normal_fit")
def vi_normal_fit(t: Tables):
    rows, names = design(t)
    fitted = fit_varying_normal(rows, names, "c_nationkey", states(t))
    return posterior_terms(fitted.draws, names, also=OTHER_TERMS)


def share_design(t: Tables):
    """Order price as a share of the dearest order, strictly inside (0, 1)."""
    top = t.orders.agg((F.max("o_totalprice") * 1.01).alias("m"))
    rows = panel(t).withColumn("share", F.col("o_totalprice") / top.scalar())
    return design_matrix(rows, "share", ["pdw2_download"], COVARIATES, "c_nationkey")


@query("beta_fit")
def beta_fit(t: Tables):
    rows, names = share_design(t)
    return posterior_terms(fit_beta(rows, names).draws, names, also=OTHER_TERMS)


#: Intercept, slopes of the centred and scaled measure and flag, and log phi; and a small change.
PLACE, CHANGE = (-0.1, 0.05, -0.02, 0.7), 1e-4
MOVES = ", ".join(
    f"({n}, {sign}, " + ", ".join(str(v + sign * CHANGE * (i == n)) for i, v in enumerate(PLACE)) + ")"
    for n in range(len(PLACE)) for sign in (-1, 0, 1) if sign or not n)


@query("beta_scores", f"""
WITH top AS (SELECT max(o_totalprice) * 1.01 AS m FROM orders),
p AS (SELECT o_totalprice / m AS y, c_acctbal / 1000 AS a, CAST(o_orderstatus = 'F' AS DOUBLE) AS b
      FROM orders JOIN customer ON o_custkey = c_custkey, top),
z AS (SELECT y, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b
      FROM p WHERE y > 0 AND y < 1),
moves(n, side, t0, t1, t2, t3) AS (VALUES {MOVES}),
e AS (SELECT n, side, y, 1 / (1 + exp(-(t0 + t1 * a + t2 * b))) AS mu, exp(t3) AS phi FROM z, moves),
l AS (SELECT n, side, sum(lgamma(phi) - lgamma(mu * phi) - lgamma((1 - mu) * phi) + (mu * phi - 1) * ln(y)
                          + ((1 - mu) * phi - 1) * ln(1 - y)) AS v FROM e GROUP BY ALL)
SELECT round(max(v) FILTER (side = 0), 4) AS loglik, {", ".join(
    f"round((max(v) FILTER (n = {n} AND side = 1) - max(v) FILTER (n = {n} AND side = -1)) / {2 * CHANGE}, 1) AS {c}"
    for n, c in enumerate(("alpha", "pdw2_download", "done", "log_phi")))}
FROM l
""")
def beta_scores(t: Tables):
    """Log likelihood and score of a beta regression at fixed parameters, by the pass of the fits."""
    rows, names = share_design(t)
    rows = open_interval(rows)
    at = [names.index(c) for c in ("pdw2_download", "done")]
    got = score_sums(packed_rows(rows, len(names)), moments(rows, len(names)), {"f": (at, np.array(PLACE))})["f"]
    out = t.spark.createDataFrame(
        [tuple(map(float, got[:5]))], "loglik double, alpha double, pdw2_download double, done double, log_phi double")
    return rounded(rounded(out, 4, "loglik"), 1, "alpha", "pdw2_download", "done", "log_phi")


@query("vi_beta_fit")
def vi_beta_fit(t: Tables):
    rows, names = share_design(t)
    return posterior_terms(
        fit_varying_beta(rows, names, "c_nationkey", states(t)).draws, names, also=OTHER_TERMS
    )


@query("fit_grid")
def model_grid(t: Tables):
    """All 32 fits of the library's list, one wide pass over a sample for its normal fits.

    The full sample holds every order; sens leaves out the urgent ones and has two flags more.
    """
    top = t.orders.agg((F.max("o_totalprice") * 1.01).alias("m"))
    rows = panel(t).withColumns({
        "pdw2_pcount": 1 + F.col("o_custkey") % 7, "pdw2_upload": (F.col("o_custkey") * 13) % 11,
        "share": F.col("o_totalprice") / top.scalar(),
    })
    sens = rows.where("rucc > 1").withColumns({
        "rucc_4": (F.col("rucc") == 4).cast("int"), "third": (F.col("o_custkey") % 3 == 0).cast("int"),
    })
    level = states(t)
    draws = fit_grid(
        {"full": rows, "sens": sens}, ALL_FITS, {"normal": "y", "beta": "share"},
        {"full": COVARIATES, "sens": [*COVARIATES, "rucc_4", "third"]},
        group="c_nationkey", second={"full": level, "sens": level},
    )
    return posterior_terms(draws, also=OTHER_TERMS)
