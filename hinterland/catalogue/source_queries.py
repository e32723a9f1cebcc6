"""Reading, writing, choosing and naming files."""

import uuid

from pyspark.sql import functions as F

from hinterland.catalogue.registry import Tables, query, rounded
from hinterland.functions import paste
from hinterland.operators.frame import stack_rows
from hinterland.operators.joins import attach_row
from hinterland.sources.checkpoint import ensure_checkpoint_dir
from hinterland.sources.delimited import (
    load_text, preview, read_table, reconcile, replace_table, text_schema, write_extracts, write_table,
)
from hinterland.sources.draws import read_draws
from hinterland.sources.files import (
    period_table, prefer_revision, read_periods, release_stem, route_sources, store_period, with_period,
)


def scratch(t: Tables) -> str:
    """A fresh folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(t.spark)
    return f"{t.spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("preview_count", """
SELECT l_orderkey, l_linenumber, l_quantity, (SELECT count(*) FROM lineitem) AS n
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 10
""")
def preview_count(t: Tables):
    rows = t.lineitem.orderBy("l_orderkey", "l_linenumber", "l_partkey")
    head, n = preview(rows)
    return attach_row(head.select("l_orderkey", "l_linenumber", "l_quantity"), n, ["n"])


@query("lazy_scan", """
SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity IS NOT NULL AND l_quantity > 45
""")
def lazy_scan(t: Tables):
    """Filter and columns reach the file scan."""
    return t.lineitem.where(F.col("l_quantity").isNotNull() & (F.col("l_quantity") > 45)).select(
        "l_orderkey", "l_quantity"
    )


@query("period_tables", """
SELECT monthname(l_shipdate) || '_' || CAST(year(l_shipdate) AS VARCHAR) AS tab,
  CAST(month(l_shipdate) AS INTEGER) AS mon, CAST(year(l_shipdate) AS INTEGER) AS year,
  count(*) AS n FROM lineitem GROUP BY 1, 2, 3
""")
def period_tables(t: Tables):
    named = t.lineitem.select(
        paste(F.date_format("l_shipdate", "MMMM"), F.year("l_shipdate"), sep="_").alias("tab")
    )
    counted = named.groupBy("tab").agg(F.count("*").alias("n"))
    return with_period(counted, "tab")


def releases(t: Tables):
    """A file name for each document; some names carry the revision mark."""
    return t.documents.select(F.concat(
        F.upper("source"), F.lit("_"), F.upper("lang"), F.lit("_"),
        (F.col("doc_id") % 97).cast("string"),
        F.when(F.col("n_chars") % 3 == 0, "_rv").otherwise(""), F.lit(".csv"),
    ).alias("name"))


@query("prefer_revision", r"""
SELECT name, stem FROM (
  SELECT name, stem, row_number() OVER (PARTITION BY stem
           ORDER BY CASE WHEN name LIKE '%\_rv.csv' ESCAPE '\' THEN 0 ELSE 1 END, name) AS rn
  FROM (SELECT name, replace(replace(lower(name), '_rv.csv', ''), '.csv', '') AS stem FROM (
    SELECT upper(source) || '_' || upper(lang) || '_' || (doc_id % 97)
      || CASE WHEN n_chars % 3 = 0 THEN '_rv' ELSE '' END || '.csv' AS name FROM documents)))
WHERE rn = 1
""")
def revised(t: Tables):
    return prefer_revision(releases(t), stem=release_stem("name"))


@query("route_sources", """
SELECT name, CASE WHEN page_id % 3 = 0 THEN 'address' ELSE 'block' END AS kind,
  replace(replace(replace(name, '.txt', ''), '.csv', ''), '-', '_') AS "table",
  'June_' || (2010 + page_id % 5) AS period
FROM (SELECT page_id, 'NATIONAL-' || page_id || '-'
   || CASE page_id % 3 WHEN 0 THEN 'Address-Street' WHEN 1 THEN 'CBLOCK' ELSE 'Metadata' END
   || '-June-' || (2010 + page_id % 5) || CASE page_id % 4 WHEN 0 THEN '.txt' WHEN 3 THEN '.pdf'
   ELSE '.csv' END AS name FROM pages)
WHERE page_id % 3 <> 2 AND page_id % 4 <> 3
""")
def routed(t: Tables):
    k = F.col("page_id")
    kind = F.when(k % 3 == 0, "Address-Street").when(k % 3 == 1, "CBLOCK").otherwise("Metadata")
    ext = F.when(k % 4 == 0, ".txt").when(k % 4 == 3, ".pdf").otherwise(".csv")
    names = t.pages.select(F.concat(
        F.lit("NATIONAL-"), k.cast("string"), F.lit("-"), kind, F.lit("-June-"),
        (2010 + k % 5).cast("string"), ext,
    ).alias("name"))
    return route_sources(names).withColumn("period", period_table("table"))


@query("extracts", """
SELECT 'oap' AS extract, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
UNION ALL SELECT 'public', count(*), round(sum(o_totalprice), 2) FROM orders
WHERE o_orderstatus = 'F'
UNION ALL SELECT 'all', count(*), round(sum(o_totalprice), 2) FROM orders
""")
def extracts(t: Tables):
    done = F.col("o_orderstatus") == "F"
    paths = write_extracts(
        t.orders, scratch(t), {"oap": done & (F.col("o_orderpriority") == "1-URGENT"), "public": done}
    )
    return stack_rows(*[
        t.spark.read.parquet(p).agg(
            F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
        ).withColumn("extract", F.lit(name))
        for name, p in paths.items()
    ])


@query("sink_roundtrip", """
SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS fullfipsid, o_custkey, o_totalprice,
       o_orderpriority FROM orders
""")
def sink_roundtrip(t: Tables):
    """Pipe-delimited text out and in again; codes keep their zeros."""
    path = scratch(t)
    rows = t.orders.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("FULLFIPSID"),
        F.col("o_custkey").alias("O_CUSTKEY"), F.col("o_totalprice").alias("O_TOTALPRICE"),
        F.col("o_orderpriority").alias("O_ORDERPRIORITY"),
    )
    rows.write.option("sep", "|").option("header", True).csv(path)
    schema = text_schema("fullfipsid", "o_custkey", "o_totalprice", "o_orderpriority")
    back = read_table(t.spark, path, schema, sep="|")
    return back.withColumns({
        "o_custkey": F.col("o_custkey").cast("long"),
        "o_totalprice": F.col("o_totalprice").cast("double"),
    })


@query("reconcile_counts", """
SELECT CAST(count(*) AS BIGINT) AS source_rows, count(*) AS table_rows, true AS agree FROM customer
""")
def reconcile_counts(t: Tables):
    path = scratch(t)
    write_table(t.customer.select("c_custkey", "c_mktsegment"), path, "csv")
    back = read_table(t.spark, path, "c_custkey long, c_mktsegment string",
                      names=["unitid", "segment"])
    return reconcile(t.spark, path, back)


#: Columns of the two kinds of draw files below, and the draw of each file that is no number.
WIDTHS = (8, 16)


@query("draw_files", f"""
WITH d AS (SELECT label, vec_id, unnest(range(1, 17)) AS k, unnest(embedding[1:16])::DOUBLE AS v FROM embeddings),
w AS (SELECT * FROM d WHERE k <= CASE WHEN label % 2 = 0 THEN {WIDTHS[0]} ELSE {WIDTHS[1]} END),
m AS (SELECT *, k = 1 AND vec_id = min(vec_id) OVER (PARTITION BY label) AS lost FROM w)
SELECT CASE WHEN label % 2 = 0 THEN 'sl_normal_full_w_download' ELSE 'sl_normal_full_w_all' END AS fit,
       CAST(label // 2 + 1 AS INTEGER) AS chain, CAST(k AS INTEGER) AS k, count(*) AS draws,
       count(*) FILTER (lost) AS lost, round(sum(v) FILTER (NOT lost), 4) AS total,
       round(avg(vec_id), 4) AS alpha
FROM m GROUP BY ALL
""")
def draw_files(t: Tables):
    """One draw file a chain, of two widths, with comments, headers in another order than the
    columns and a draw that is no number; then read back."""
    path = scratch(t)
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("first"))
    rows = t.embeddings.join(first, "label").withColumn(
        "width", F.when(F.col("label") % 2 == 0, WIDTHS[0]).otherwise(WIDTHS[1]))
    measure = F.when(F.col("label") % 2 == 0, F.lit("download")).otherwise(F.lit("all"))
    file = F.format_string("sl_normal_full_w_%s_%d.csv", measure, F.floor(F.col("label") / 2).cast("int") + 1)
    # Columns are written last first.
    numbers = F.transform(F.reverse(F.slice("embedding", 1, F.col("width"))), lambda v: v.cast("double").cast("string"))
    lost = F.when(F.col("vec_id") == F.col("first"), F.concat(
        F.slice(numbers, 1, F.col("width") - 1), F.array(F.lit("nan")))).otherwise(numbers)
    draws = rows.select(file.alias("file"), F.concat_ws(",", F.col("vec_id").cast("string"), lost).alias("value"))
    heads = rows.select(
        file.alias("file"),
        F.concat_ws(",", F.lit("alpha"), F.transform(F.reverse(F.sequence(F.lit(1), F.col("width"))), lambda k: F.concat(
            F.lit("beta."), k.cast("string")))).alias("value")).distinct()
    notes = heads.select("file", F.lit("# adaptation of the step size").alias("value"))
    draws.unionByName(heads).unionByName(notes).repartition("file").write.partitionBy("file").text(path)
    back = read_draws(t.spark, path, scalars=("alpha",)).select(
        "fit", "chain", "alpha", F.posexplode("beta").alias("k", "v"))
    out = back.groupBy("fit", "chain", (F.col("k") + 1).alias("k")).agg(
        F.count("*").alias("draws"), F.count_if(F.isnan("v")).alias("lost"),
        F.sum(F.when(~F.isnan("v"), F.col("v"))).alias("total"), F.avg("alpha").alias("alpha"))
    return rounded(out, 4, "total", "alpha")


@query("reload_period", """
SELECT CAST(year AS INTEGER) AS year, CAST(mon AS INTEGER) AS mon, count(*) AS n,
       round(sum(CASE WHEN year = 1995 AND mon = 3 THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total
FROM (SELECT o_totalprice, year(o_orderdate) AS year, month(o_orderdate) AS mon FROM orders)
WHERE year = 1995 GROUP BY year, mon
""")
def reload_period(t: Tables):
    """A month is loaded again, twice: that month is replaced and the others stay."""
    path = scratch(t)
    rows = t.orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"),
                           F.month("o_orderdate").alias("mon"))
    store_period(rows, path)
    march = rows.where("year = 1995 AND mon = 3").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    for _ in range(2):
        store_period(march, path)
    back = t.spark.read.schema(rows.schema).parquet(path).where("year = 1995")
    out = back.groupBy("year", "mon").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(out, 2, "total")


@query("read_periods", """
SELECT CAST(year AS INTEGER) AS year, CAST(mon AS INTEGER) AS mon, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM (SELECT o_totalprice, year(o_orderdate) AS year, month(o_orderdate) AS mon FROM orders)
WHERE year IN (1994, 1995) AND mon IN (6, 12) GROUP BY year, mon
""")
def periods(t: Tables):
    """One table a release, named after its month; month and year come from the names."""
    path = scratch(t)
    names = {"June_1994": (1994, 6), "December_1994": (1994, 12), "June_1995": (1995, 6), "December_1995": (1995, 12)}
    for name, (year, mon) in names.items():
        own = (F.year("o_orderdate") == year) & (F.month("o_orderdate") == mon)
        write_table(t.orders.where(own).select("o_orderkey", "o_totalprice"), f"{path}/{name}")
    out = read_periods(t.spark, path, list(names)).groupBy("year", "mon").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(out, 2, "total")


@query("replace_table", """
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
""")
def replaced(t: Tables):
    """A table of the catalog is created, then replaced with fewer rows."""
    name = f"staging_{uuid.uuid4().hex}"
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    replace_table(rows, name)
    replace_table(rows.where("o_orderstatus = 'F'"), name, ["o_orderpriority"])
    out = t.spark.table(name).groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(out, 2, "total")


@query("load_metrics", """
SELECT count(*) AS data_lines, count(*) AS rows, 0::BIGINT AS bad, round(sum(c_acctbal), 2) AS total
FROM customer
""")
def load_metrics(t: Tables):
    """Lines, headers and rows counted by the very job that writes the table."""
    path = scratch(t)
    rows = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment")
    rows.write.option("sep", "|").option("header", True).csv(f"{path}/text")
    table, counts = load_text(t.spark, f"{path}/text", rows.schema, f"{path}/table")
    shown = {"data_lines": counts["lines"] - counts["headers"], "rows": counts["rows"], "bad": counts["bad"]}
    out = table.agg(F.sum("c_acctbal").alias("total")).select(
        *[F.lit(v).cast("long").alias(c) for c, v in shown.items()], "total")
    return rounded(out, 2, "total")
