"""Draw files, periods, tables, metrics and NULL keys."""

import pytest
from pyspark.sql import functions as F

from hinterland.operators.aggregates import measures_by_year
from hinterland.operators.frame import pivot_keys, to_wide
from hinterland.sources.checkpoint import discard, stored
from hinterland.sources.delimited import load_text, replace_table, text_schema
from hinterland.sources.draws import read_draws
from hinterland.sources.files import read_periods, store_period


def test_a_draw_that_is_no_number_stays_a_row(spark, tmp_path):
    (tmp_path / "sl_normal_full_w_all_1.csv").write_text("# c\nlp__,beta.1,beta.2\n1,0.1,0.2\nnan,0.3,0.4\nNaN,nan,-inf\n")
    got = read_draws(spark, str(tmp_path), scalars=("lp__",)).collect()
    assert sorted(r.beta for r in got[:2]) == [[0.1, 0.2], [0.3, 0.4]] and len(got) == 3
    assert got[2].beta[0] != got[2].beta[0] and got[2].beta[1] == float("-inf")
    assert (got[0].fit, got[0].model, got[0].measure, got[0].chain) == ("sl_normal_full_w_all", "sl", "all", 1)


def test_a_second_header_fails_whatever_is_selected(spark, tmp_path):
    (tmp_path / "sl_normal_full_w_all_1.csv").write_text("lp__,beta.1,beta.2\n1,0.1,0.2\nlp__,beta.2,beta.1\n1,0.3,0.4\n")
    rows = read_draws(spark, str(tmp_path))
    with pytest.raises(Exception, match="more than one header"):
        rows.collect()
    with pytest.raises(Exception, match="more than one header"):
        rows.select("beta").collect()


def test_a_file_without_a_header_fails(spark, tmp_path):
    (tmp_path / "sl_normal_full_w_all_1.csv").write_text("1,0.1,0.2\n")
    with pytest.raises(Exception, match="no header"):
        read_draws(spark, str(tmp_path)).collect()


def test_a_folder_of_part_files_is_one_draw_file(spark, tmp_path):
    folder = tmp_path / "file=vi_beta_sens_w_upload_3.csv"
    folder.mkdir()
    (folder / "part-1.txt").write_text("0.1,0.2\n")
    (folder / "part-0.txt").write_text("# n\nbeta.2,beta.1\n0.3,0.4\n")
    got = sorted((r.fit, r.chain, tuple(r.beta)) for r in read_draws(spark, f"{tmp_path}/*").collect())
    assert got == [("vi_beta_sens_w_upload", 3, (0.2, 0.1)), ("vi_beta_sens_w_upload", 3, (0.4, 0.3))]


def test_reloading_a_month_replaces_that_month_only(spark, tmp_path):
    base = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 2013, 6), (2, 2013, 6), (3, 2013, 12), (4, 2014, 6)], "v int, year int, mon int")
    store_period(rows, base)
    june = spark.createDataFrame([(9, 2013, 6)], "v int, year int, mon int")
    for _ in range(2):
        store_period(june, base)
        back = spark.read.schema(rows.schema).parquet(base)
        assert sorted((r.v, r.year, r.mon) for r in back.collect()) == [(3, 2013, 12), (4, 2014, 6), (9, 2013, 6)]
    plan = back.where("year = 2013 AND mon = 6")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_period_tables_and_replaced_tables(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/June_2012")
    spark.range(2).withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/December_2013")
    got = read_periods(spark, str(tmp_path), ["June_2012", "December_2013"]).groupBy("mon", "year").count().collect()
    assert sorted(map(tuple, got)) == [(6, 2012, 3), (12, 2013, 2)]
    replace_table(spark.range(9), "replaced_once")
    replace_table(spark.range(4).withColumn("k", F.col("id") % 2), "replaced_once", ["k"])
    assert spark.table("replaced_once").count() == 4


def test_counts_are_taken_while_the_table_is_written(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Code|Speed\n01|2.5\n02|\n\nbad\n")
    (tmp_path / "b.txt").write_text("code|speed\n03|x\n04|1|2\n")
    schema = text_schema("code").add("speed", "double")
    table, counts = load_text(spark, f"{tmp_path}/*.txt", schema, str(tmp_path / "out"))
    assert counts == {"lines": 7, "headers": 2, "rows": 5, "bad": 2}
    assert sorted(map(tuple, table.collect()), key=str) == [
        ("01", 2.5), ("02", None), ("03", None), ("04", 1.0), ("bad", None)]


def test_null_keys_have_a_column(spark):
    rows = spark.createDataFrame(
        [(1, 2000, 1.0), (1, None, 7.0), (2, 2005, 2.0), (2, None, None), (3, None, 9.0)], "id int, year int, v double")
    wide = to_wide(rows, ["id"], "year", "v")
    assert wide.columns == ["id", "2000", "2005", "NULL"]
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, None, 7.0), (2, None, 2.0, None), (3, None, None, 9.0)]
    with pytest.raises(ValueError, match="without a column"):
        to_wide(rows, ["id"], "year", "v", [2000, 2005])
    with pytest.raises(ValueError, match="too many"):
        pivot_keys(rows, "year", most=2)
    table = measures_by_year(rows, ["v"])
    assert table.columns == ["ord", "var", "stat", "2000", "2005", "NULL"]
    assert {r.stat: r["NULL"] for r in table.collect()}["mean"] == 8.0


def test_stored_tables_are_given_back(spark):
    table = stored(spark.range(5))
    assert table.count() == 5
    discard(table)
    with pytest.raises(Exception):
        table.count()
