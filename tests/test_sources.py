import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hinterland.sources.checkpoint import ensure_checkpoint_dir
from hinterland.sources.delimited import (
    preview, read_table, reconcile, replace_table, text_schema, write_extracts, write_table,
)
from hinterland.sources.draws import read_draws
from hinterland.sources.files import (
    list_files, prefer_revision, read_periods, route_sources,
)


def test_pipe_text_keeps_zeros_and_counts_agree(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"f{k}.txt").write_text("FULLFIPSID|FRN|SPEED\n010010201001000|7|4\n0200|8|\n")
    path = str(tmp_path / "*.txt")
    df = read_table(spark, path, text_schema("FULLFIPSID", "FRN", "SPEED"), sep="|")
    assert df.columns == ["fullfipsid", "frn", "speed"]
    assert {r["fullfipsid"] for r in df.collect()} == {"010010201001000", "0200"}
    row = reconcile(spark, path, df).first()
    assert (row["source_rows"], row["table_rows"], row["agree"]) == (4, 4, True)
    head, n = preview(df, 3)
    assert head.count() == 3 and n.first()["n"] == 4


def test_own_names_skip_header(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Fiscal Year,State\n2012,Ohio\n")
    df = read_table(spark, str(tmp_path / "s.csv"), "a int, b string", names=["year", "stname"])
    assert [tuple(r) for r in df.collect()] == [(2012, "Ohio")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2012, "b", 1), (2012, "a", 0), (2013, "c", 1)],
                               "year int, k string, public int")
    out = str(tmp_path / "t")
    write_table(df, out, partition_by=["year"], sort_by=["k"])
    write_table(df, out, partition_by=["year"], sort_by=["k"])  # overwrites
    assert spark.read.parquet(out).count() == 3
    paths = write_extracts(df, str(tmp_path / "x"), {"public": F.col("public") == 1})
    assert set(paths) == {"all", "public"} and spark.read.parquet(paths["public"]).count() == 2
    replace_table(df, "hinterland_test")
    replace_table(df.limit(1), "hinterland_test")
    assert spark.table("hinterland_test").count() == 1
    spark.sql("DROP TABLE hinterland_test")


def test_file_choice(spark, tmp_path):
    for n in ("ef2012a.csv", "ef2012a_rv.csv", "HD2012.csv"):
        (tmp_path / n).write_text("x\n")
    files = list_files(spark, str(tmp_path), "*.csv")
    got = {r["stem"]: r["name"] for r in prefer_revision(files).collect()}
    assert got == {"ef2012a": "ef2012a_rv.csv", "hd2012": "HD2012.csv"}
    names = spark.createDataFrame(
        [("NATIONAL-Address-Street-CSV-JUN-2014.CSV",), ("x-cblock-y.txt",), ("readme.txt",),
         ("CBLOCK.pdf",)], "name string")
    got = {r["table"]: r["kind"] for r in route_sources(names).collect()}
    assert got == {"NATIONAL_Address_Street_CSV_JUN_2014": "address", "x_cblock_y": "block"}


def test_period_tables(spark, tmp_path):
    for name, v in (("June_2012", 1), ("December_2013", 2)):
        spark.createDataFrame([(v,)], "v int").write.parquet(str(tmp_path / name))
    got = sorted(map(tuple, read_periods(spark, str(tmp_path), ["June_2012", "December_2013"])
                     .collect()))
    assert got == [(1, 6, 2012), (2, 12, 2013)]


def test_draw_files(spark, tmp_path):
    for chain in (1, 2):
        (tmp_path / f"sl_normal_full_pdw2_download_{chain}.csv").write_text(
            "# model = sl_normal\n# seed = 1\nlp__,alpha,beta.2,beta.1,beta.10\n"
            f"# adaptation\n-1.5,{chain},0.2,0.1,1.0\n-1.6,{chain},0.4,0.3,2.0\n# elapsed\n")
    df = read_draws(spark, str(tmp_path / "sl_normal_full_*.csv"), scalars=("alpha",))
    rows = df.collect()
    assert len(rows) == 4 and len({r["draw"] for r in rows}) == 4
    assert {r["fit"] for r in rows} == {"sl_normal_full_pdw2_download"}
    assert {(r["model"], r["family"], r["sample"], r["measure"]) for r in rows} == {
        ("sl", "normal", "full", "download")}
    assert sorted((r["chain"], r["alpha"], r["beta"][0]) for r in rows) == [
        (1, 1.0, 0.1), (1, 1.0, 0.3), (2, 2.0, 0.1), (2, 2.0, 0.3)]
    assert rows[0]["beta"][2] in (1.0, 2.0)
    assert df.schema["beta"].dataType == T.ArrayType(T.DoubleType())


def test_configured_checkpoint_folder_is_used(spark):
    ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in spark.sparkContext.getCheckpointDir()
    with pytest.raises(Exception):
        spark.conf.get("spark.checkpoint.no_such_setting")
