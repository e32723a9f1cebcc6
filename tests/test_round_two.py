"""Nothing is lost silently: pivots, headers, draw files, and groups without a second level."""

import numpy as np
import pytest

from hinterland.operators.frame import to_wide
from hinterland.operators.normal_models import fit_varying_normal, group_level
from hinterland.operators.regions import neighbour_set
from hinterland.sources.delimited import read_table
from hinterland.sources.draws import read_draws


def test_pivot_finds_and_demands_every_key(spark):
    rows = spark.createDataFrame([(1, 2000, 1.0), (1, 2005, 2.0)], "id int, year int, v double")
    assert to_wide(rows, ["id"], "year", "v").columns == ["id", "2000", "2005"]
    with pytest.raises(ValueError, match="2005"):
        to_wide(rows, ["id"], "year", "v", [2000])


def test_header_in_another_order_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("unitid,efdetot\n7,100\n")
    good = read_table(spark, str(tmp_path), "unitid int, efdetot int")
    assert tuple(good.first()) == (7, 100)
    with pytest.raises(Exception, match="CSV header"):
        read_table(spark, str(tmp_path), "efdetot int, unitid int").collect()


def test_draw_files_of_two_widths(spark, tmp_path):
    (tmp_path / "sl_normal_full_w_pcount_1.csv").write_text("# c\nlp__,beta.1,beta.2,alpha\n1,0.1,0.2,9\n")
    (tmp_path / "sl_normal_full_w_all_1.csv").write_text("alpha,beta.2,beta.1,beta.10\n8,0.5,0.4,0.6\n# end\n")
    got = {r["fit"]: r for r in read_draws(spark, str(tmp_path), scalars=("alpha", "sigma")).collect()}
    assert got["sl_normal_full_w_pcount"]["beta"] == [0.1, 0.2]
    assert got["sl_normal_full_w_all"]["beta"] == [0.4, 0.5, 0.6]
    assert got["sl_normal_full_w_all"]["alpha"] == 8 and got["sl_normal_full_w_all"]["sigma"] is None
    (tmp_path / "sl_normal_full_w_all_2.csv").write_text("alpha,beta.1\n8\n")
    with pytest.raises(Exception, match="fields differ"):
        read_draws(spark, str(tmp_path)).collect()


def test_neighbours_and_the_area_itself_once(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("d", "a")], "orgfips string, adjfips string")
    assert sorted(map(tuple, neighbour_set(rows, "a").collect())) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_groups_without_second_level_leave_the_fit(spark):
    rng = np.random.default_rng(3)
    rows, groups = [], []
    for g in range(12):
        bad = g >= 10
        groups.append((g, float(g % 5) if g != 11 else None, f"r{g % 3}" if g != 10 else None))
        for _ in range(60):
            x = [float(v) for v in rng.normal(20.0 if bad else 0.0, 1.0, 2)]
            y = 0.5 * x[0] + 0.2 * (g % 3) + float(rng.normal(0, 0.3)) + (90.0 if bad else 0.0)
            rows.append((g, y, x))
    design = spark.createDataFrame(rows, "g int, y double, x array<double>")
    table = spark.createDataFrame(groups, "g int, z double, region string")
    fit = fit_varying_normal(design, ["x1", "x2"], "g", group_level(table, "g", ["z"], "region"), draws=50)
    assert fit.groups == 10
    beta = fit.draws.selectExpr("avg(beta[0]) a", "avg(beta[1]) b").first()
    assert abs(beta["a"] - 0.5) < 0.1 and abs(beta["b"]) < 0.1
