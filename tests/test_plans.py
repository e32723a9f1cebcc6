"""The pipelines end to end on a small country, and the shape of the plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables
from hinterland.operators.aggregates import merge_rollups, rollup
from hinterland.plans import analysis, measures, models, panel
from hinterland.sources.delimited import write_table

YEARS = (2012, 2013, 2014)
STATES = {"01": ("AL", "Alabama", 1), "05": ("AR", "Arkansas", 1), "06": ("CA", "California", 2),
          "17": ("IL", "Illinois", 2)}
COUNTIES = [f"{s}{c:03d}" for s in STATES for c in (1, 3)]


@pytest.fixture(scope="module")
def country(spark):
    """Source tables with the survey's columns, all rows made from one seed."""
    rng = np.random.default_rng(9)
    crosswalk = spark.createDataFrame(
        [(st, name, fips, region) for fips, (st, name, region) in STATES.items()],
        "st string, stname string, stfips string, region int")
    units = [(100 + i, COUNTIES[i % len(COUNTIES)]) for i in range(40)]
    each = [(u, c, y) for u, c in units for y in YEARS]
    place = {u: (float(rng.uniform(-95, -90)), float(rng.uniform(33, 37))) for u, _ in units}

    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    total = {k: int(v) for k, v in zip(((u, y) for u, _, y in each),
                                       rng.integers(500, 5000, len(each)))}
    surveys = {
        "header": table(
            [(u, STATES[c[:2]][0], int(c), 4 if u % 3 else 1, *place[u], y) for u, c, y in each]
            + [(999, "AL", 1001, 0, -90.0, 33.0, 2012), (998, "GU", 66010, 4, 144.0, 13.0, 2012)],
            "UNITID int, STABBR string, COUNTYCD int, SECTOR int, LONGITUD double, "
            "LATITUDE double, year int"),
        "characteristics": table([(u, 1 if u % 4 else 2, -2 if u % 5 == 0 else 1 + u % 2, y)
                                  for u, _, y in each],
                                 "UNITID int, OPENADMP int, ROOM int, year int"),
        "full_time_equivalent": table([(u, total[u, y], y) for u, _, y in each],
                                      "UNITID int, EFTEUG int, year int"),
        "enrolment_a": table(
            [(u, lev, total[u, y], total[u, y] // 2, total[u, y] // 3, y)
             for u, _, y in each for lev in (1, 2)],
            "UNITID int, EFALEVEL int, EFTOTLT int, EFTOTLW int, EFWHITT int, year int"),
        "enrolment_b": table(
            [(u, age, 2, total[u, y] // 4, total[u, y] // 5, y)
             for u, _, y in each for age in (1, 7)],
            "UNITID int, EFBAGE int, LSTUDY int, EFAGE06 int, EFAGE09 int, year int"),
        "aid": table([(u, total[u, y] // 6, int(rng.integers(5, 90)), y) for u, _, y in each],
                     "UNITID int, UPGRNTN int, UPGRNTP int, year int"),
        "distance": table(
            [(u, 2, total[u, y], int(total[u, y] * rng.uniform(0.05, 0.8)), 5, 9, y)
             for u, _, y in each],
            "UNITID int, EFDELEV int, EFDETOT int, EFDESOM int, EFDEEXC int, EFDENON int, "
            "year int"),
    }
    groups = [(f"{c}{t:06d}", 1) for c in COUNTIES for t in (100, 200, 300)]
    raw = table(
        [(f"{t}{b}{k:03d}", "50", str(k % (1 + g % 4)), str(int(rng.integers(1, 12))),
          "" if k == 2 else str(int(rng.integers(1, 12))))
         for g, (t, b) in enumerate(groups) for k in range(4)],
        "fullfipsid string, transtech string, frn string, downloadspeed string, "
        "uploadspeed string")
    centres = table(
        [(t[:2], t[2:5], t[5:], str(b), int(rng.integers(100, 3000)),
          float(rng.uniform(-95, -90)), float(rng.uniform(33, 37))) for t, b in groups],
        "statefp string, countyfp string, tractce string, blkgrpce string, population long, "
        "longitude double, latitude double")
    labour_rows = {"state": list(STATES), "county": COUNTIES}
    labour = {
        level: table([(k, "1000", "60", "55", "(X)" if k == "05003" else "7", "700", "12")
                      for k in keys],
                     "`GEO.id2` string, HC01_EST_VC01 string, HC02_EST_VC01 string, "
                     "HC03_EST_VC01 string, HC04_EST_VC01 string, HC01_EST_VC22 string, "
                     "HC01_EST_VC41 string")
        for level, keys in labour_rows.items()
    }
    population = table(
        [("040", s, "000", "x", 10, 1000, 1010, 1020) for s in STATES]
        + [("050", c[:2], c[2:], f"County {c}", 10, 100 + int(c) % 7, 110, 120) for c in COUNTIES],
        "SUMLEV string, STATE string, COUNTY string, CTYNAME string, POPESTIMATE2011 long, "
        "POPESTIMATE2012 long, POPESTIMATE2013 long, POPESTIMATE2014 long")
    land = table([(c, 10.0 + i) for i, c in enumerate(COUNTIES)],
                 "STCOU string, LND110210D double")
    rurality = table([(c, 1 + i % 9) for i, c in enumerate(COUNTIES)],
                     "FIPS string, RUCC_2013 int")
    finance = table(
        [(y, n, 100.5, 4000.0 + 100 * i, 1.0, 2.0) for y in (2011, *YEARS)
         for i, n in enumerate([*(v[1] for v in STATES.values()), "US"])],
        "`Fiscal Year` int, State string, a double, b double, c double, d double")
    return dict(crosswalk=crosswalk, surveys=surveys, raw=raw, centres=centres, labour=labour,
                population=population, land=land, rurality=rurality, finance=finance)


@pytest.fixture(scope="module")
def built(spark, country, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("pipeline"))
    raw = country["raw"]
    streets = raw.where("frn <> '3'")
    years = spark.createDataFrame([(y, 6) for y in YEARS], "year int, mon int")
    measures.store_measures([s.join(years) for s in (raw, streets)], f"{base}/measures")
    stored = spark.read.schema(
        "fips string, mcount long, pcount long, download double, upload double, "
        "year int, mon int").parquet(f"{base}/measures")

    def stored_table(df, name):
        """Hand-off between stages, as the pipelines are meant to be run."""
        write_table(df, f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    units = stored_table(
        panel.institution_panel(country["surveys"], country["crosswalk"]), "panel")
    centres = measures.block_group_centres(country["centres"], measures.OUTSIDE_CONTINENT)
    weighted = stored_table(measures.weighted_measures(units, stored, centres), "weighted")
    located = analysis.located_institutions(units, weighted, country["crosswalk"])
    distances = analysis.nearest_mean_distance(
        located, measures.block_group_centres(country["centres"], measures.NO_STATE))
    full = analysis.analysis_panel(
        located,
        analysis.county_population(country["population"], country["land"], country["rurality"]),
        analysis.state_population(country["population"]),
        analysis.labour(country["labour"]["state"], country["labour"]["county"]),
        analysis.finance(country["finance"], country["crosswalk"]),
        distances,
    )
    paths = analysis.store_analysis(full, f"{base}/analysis")
    return dict(stored=stored, units=units, weighted=weighted, paths=paths, centres=centres,
                panel=spark.read.parquet(paths["analysis_all"]))


def test_measures_are_stored_by_period(built):
    stored = built["stored"]
    assert stored.select("year", "mon").distinct().count() == 3
    row = stored.where("fips = '010010001001' AND year = 2013").first()
    assert (row["mcount"], row["pcount"]) == (8, 2)  # one provider, in both sources
    counties = measures.county_measures(stored, built["centres"])
    assert counties.count() == len(COUNTIES) * 3


def test_panel_rules(built):
    units = built["units"]
    assert units.columns == panel.PANEL_COLUMNS
    assert units.count() == 120 and units.where("stabbr = 'GU' OR unitid = 999").isEmpty()
    row = units.where("unitid = 100 AND year = 2012").first()
    assert (row["openadmp"], row["room"], row["twoyr"], row["public"]) == (0, None, 1, 1)


def test_weighted_measures_lie_within_the_observed_range(built):
    rows = built["weighted"].collect()
    assert len(rows) == 120 and all(r["mon"] == 6 for r in rows)
    assert all(1 <= r["pdw2_download"] <= 11 and 1 <= r["pdw2_upload"] <= 11 for r in rows)


def test_analysis_panel(built, spark):
    df = built["panel"]
    assert df.count() == 120
    states = df.select("stfips", "ststan").distinct().orderBy("ststan").collect()
    assert [(r["stfips"], r["ststan"]) for r in states] == [
        (s, i + 1) for i, s in enumerate(sorted(STATES))]
    row = df.where("unitid = 101 AND year = 2014").first()
    assert row["lefdetot"] == pytest.approx(np.log1p(row["efdetot"]))
    assert row["appropfte_t"] == row["appropfte"] / 1000 and row["pwm_dist_oa"] > 0
    assert (row["year13"], row["year14"]) == (0, 1)
    # 05003 has no county rate; its state and the other columns are still there.
    gap = df.where("fips = '05003'").select("ctunemrate", "stunemrate").first()
    assert (gap["ctunemrate"], gap["stunemrate"]) == (None, 7.0)
    oap = spark.read.parquet(built["paths"]["analysis_oap"])
    assert 0 < oap.count() < 120 and oap.where("openadmp <> 1 OR public <> 1").isEmpty()


def test_models_run_on_the_panel(built):
    rows = models.model_rows(built["panel"])
    assert {f"rucc_{k}" for k in models.RUCC} < set(rows.columns)
    second = models.second_level(rows, covariates=["appropfte_t"])
    assert second.table.count() == 4 and [r.region for r in second.regions.orderBy("region_index").collect()] == [1, 2]
    specs = [models.FitSpec("sl", "normal", "full", m) for m in ("download", "upload", "pcount",
                                                                 "all")]
    specs.append(models.FitSpec("vi", "normal", "full", "all"))
    draws = models.fit_grid(
        {"full": rows}, specs, {"normal": "lefdesom"},
        {"full": ["twoyr", "lefdetot", "upgrntpp", "year13", "year14"]},
        second={"full": second}, draws=60, chains=2,
    )
    table = models.margins(draws)
    assert table.count() == 101 * 9
    both = models.combined_margins(draws, rows)
    assert both.count() == 101 * 2
    assert len(models.ALL_FITS) == 32 and len({f.name for f in models.ALL_FITS}) == 32
    assert len(models.FIRST_LEVEL["full"]) == 19 and len(models.FIRST_LEVEL["sens"]) == 22


def test_second_level(built):
    rows = models.model_rows(built["panel"])
    second = models.second_level(rows, average=True)
    assert second.table.count() == 4 and second.n_z == 4
    with pytest.raises(ValueError, match="collinear"):  # four covariates, four states
        models.fit_grid({"full": rows}, [models.FitSpec("vi", "normal", "full", "download")],
                        {"normal": "lefdesom"}, {"full": ["twoyr"]}, second={"full": second})


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollups_stay_in_the_jvm_and_read_few_columns(spark, tables):
    t = Tables(spark, tables)
    lines = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("k"), "l_suppkey", "l_quantity", "l_linestatus")
    parts = [rollup(lines.where(F.col("l_linestatus") == s), "k", 3, "l_suppkey",
                    {"download": "l_quantity"}) for s in "OF"]
    plan = physical(merge_rollups(parts, "k", means=["download"]))
    assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan
    assert "l_extendedprice" not in plan
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,O)]" in plan
