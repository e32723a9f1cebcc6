"""URL filter by a path-template tree: fixed rules first, then labelled purity of templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.llm.scratch import Scratch


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Levels of the tree; what lies deeper is one segment ``**``.
DEPTH = 4
#: A segment is variable when it has at least this many siblings and under a tenth of their rows.
SIBLINGS, SHARE = 20, 10
#: Branches whose counts of allowed, blocked and unlabelled rows differ from those of their
#: siblings by less (chi-square, two degrees of freedom, 5 %) are merged. Variable segments must
#: pass the same test, so that a wildcard never takes in a section whose labels are its own.
CHI_SQUARE = 5.991
#: A template is rejected when (blocked + 2) / (labelled + 4 + unlabelled / 50) is at least four
#: fifths, so a few blocked rows don't speak for a crowd of rows without a label.
PURITY, WEIGHT, SPEAKS_FOR = 0.8, 4, "50e0"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = r"^[0-9a-fA-F]{8,}(-[0-9a-fA-F]{4,})*$"


def _longest_first(rules: tuple[Rule, ...]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith(rule.path)


def split_urls(pages: DataFrame, id_col: str, url_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """``page_id, host, path, rule, rule_verdict, segments``; digits and hex names are wildcards."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"))
    name = verdict = F.lit(None).cast("string")
    for rule in reversed(_longest_first(rules)):
        name = F.when(_fits(rule), rule.name).otherwise(name)
        verdict = F.when(_fits(rule), rule.verdict).otherwise(verdict)
    parts = F.filter(F.split("path", "/", -1), lambda x: x != "")
    plain = F.transform("parts", lambda x: F.when(x.rlike(_HEX), "*").otherwise(
        F.regexp_replace(x, "[0-9]+", "*")))
    return (
        rows.withColumns({"rule": name, "rule_verdict": verdict, "parts": parts})
        .withColumn("segments", F.concat(
            F.slice(plain, 1, DEPTH), F.when(F.size("parts") > DEPTH, F.array(F.lit("**")))
            .otherwise(F.array().cast("array<string>"))))
        .drop("parts")
    )


def template_tree(urls: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, segments, template, n_template, purity``: one row for each distinct path shape.

    Shapes are counted first, so the tree's work follows their number and a hot host has been
    summed before it meets its levels. At each level, from the root down, segments under the same
    parent become ``*`` when they are many and small, ``~`` when they are not, where a chi-square
    test does not tell their label counts from those of their siblings; others keep their names.
    """
    tree = urls.groupBy("host", "segments").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("rule_verdict") == "allow").alias("good"),
        F.count_if(F.col("rule_verdict") == "block").alias("bad"),
    ).withColumn("prefix", F.lit(""))
    for level in range(DEPTH + 1):
        tree = scratch.keep(tree.withColumn("name", F.get("segments", F.lit(level))), "level")
        if not tree.where("name IS NOT NULL").take(1):
            tree = tree.drop("name")
            break
        wild = _branches(tree).where(f"k >= {SIBLINGS} AND n * {SHARE} < all_n").where(
            _chi_square()).select("host", "prefix", "name", F.lit("*").alias("star"))
        tree = scratch.keep(
            tree.join(wild, ["host", "prefix", "name"], "left")
            .withColumn("name", F.coalesce("star", "name")).drop("star"), "starred")
        alike = _branches(tree).where("all_n > n").where(
            _chi_square()).select("host", "prefix", "name", F.lit("~").alias("merged"))
        tree = (
            tree.join(alike, ["host", "prefix", "name"], "left")
            .withColumn("prefix", F.concat("prefix", F.coalesce(
                F.concat(F.lit("/"), F.coalesce("merged", "name")), F.lit(""))))
            .drop("merged", "name"))
    tree = scratch.keep(tree, "tree")
    pooled = scratch.keep(tree.groupBy("host", "prefix").agg(
        F.sum("n").alias("n_template"), F.sum("good").alias("good"), F.sum("bad").alias("bad")
    ).withColumn("purity", F.expr(_purity()))
        .drop("good", "bad"), "pooled")
    return scratch.keep(tree.select("host", "prefix", "segments").join(pooled, ["host", "prefix"])
                        .withColumnRenamed("prefix", "template"), "templates")


def _branches(tree: DataFrame) -> DataFrame:
    """Counts of each segment of a level next to those of all segments under its parent."""
    child = tree.where("name IS NOT NULL").groupBy("host", "prefix", "name").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    parent = child.groupBy("host", "prefix").agg(
        F.count("*").alias("k"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"),
        F.sum("bad").alias("all_bad"))
    return child.join(parent, ["host", "prefix"])


def _purity() -> str:
    return (f"(bad + {WEIGHT} / 2) / "
            f"(good + bad + {WEIGHT} + (n_template - good - bad) / {SPEAKS_FOR})")


def _chi_square() -> str:
    """A branch against the rest of its siblings, over the three kinds of rows."""
    def term(a: str, total: str) -> str:
        gap = f"CAST({a} * (all_n - n) - ({total} - {a}) * n AS DOUBLE)"
        return (f"CASE WHEN {total} > 0 THEN {gap} * {gap} "
                f"/ (CAST({total} AS DOUBLE) * n * (all_n - n)) ELSE 0 END")

    terms = [term("good", "all_good"), term("bad", "all_bad"),
             term("(n - good - bad)", "(all_n - all_good - all_bad)")]
    return f"{' + '.join(terms)} < {CHI_SQUARE}"


def filter_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row a page: ``page_id, host, path, rule, verdict, template, n_template, purity``.

    The longest fitting rule decides (at equal length one that blocks); its verdicts are
    also the labels. Other pages are blocked when their host's template is blocked with a smoothed
    purity of at least PURITY, and allowed otherwise: a template without labels is allowed.
    NULL urls and urls without ``://`` have an empty host and path and form one host of their own.
    Repeated rows count each; other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession)
    urls = split_urls(pages, id_col, url_col, rules)
    templates = template_tree(urls, scratch)
    return urls.join(templates, ["host", "segments"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
        .alias("verdict"), "template", "n_template", "purity")


def oracle() -> str:
    """The same in DuckDB, with one pair of queries a level."""
    def case(what: str) -> str:
        return "CASE " + " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) "
            f"AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'"
            for r in _longest_first(RULES)) + " END"

    parts = [f"""
WITH parsed AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')
        AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
    SELECT *, {case("name")} AS rule, {case("verdict")} AS rule_verdict,
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
            CASE WHEN regexp_matches(x, '{_HEX}') THEN '*' ELSE regexp_replace(x, '[0-9]+', '*', 'g') END)
            AS parts FROM parsed),
urls AS (
    SELECT * EXCLUDE (parts), CASE WHEN len(parts) > {DEPTH}
        THEN list_append(parts[1:{DEPTH}], '**') ELSE parts END AS segments FROM ruled),
tree0 AS (
    SELECT host, segments, count(*) AS n, count(*) FILTER (rule_verdict = 'allow') AS good,
        count(*) FILTER (rule_verdict = 'block') AS bad, '' AS prefix FROM urls GROUP BY ALL)"""]
    for level in range(DEPTH + 1):
        t = f"{level}"
        parts.append(f"""
named{t} AS (SELECT *, segments[{level + 1}] AS name FROM tree{t}),
child{t} AS (
    SELECT host, prefix, name, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad
    FROM named{t} WHERE name IS NOT NULL GROUP BY ALL),
kin{t} AS (
    SELECT *, count(*) OVER w AS k, (sum(n) OVER w)::BIGINT AS all_n,
        (sum(good) OVER w)::BIGINT AS all_good, (sum(bad) OVER w)::BIGINT AS all_bad
    FROM child{t} WINDOW w AS (PARTITION BY host, prefix)),
wild{t} AS (
    SELECT host, prefix, name FROM kin{t}
    WHERE k >= {SIBLINGS} AND n * {SHARE} < all_n AND {_chi_square()}),
starred{t} AS (
    SELECT a.* REPLACE (CASE WHEN w.name IS NULL THEN a.name ELSE '*' END AS name)
    FROM named{t} a LEFT JOIN wild{t} w USING (host, prefix, name)),
branch{t} AS (
    SELECT host, prefix, name, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good, sum(bad)::BIGINT AS bad
    FROM starred{t} WHERE name IS NOT NULL GROUP BY ALL),
sums{t} AS (
    SELECT *, (sum(n) OVER w)::BIGINT AS all_n, (sum(good) OVER w)::BIGINT AS all_good,
        (sum(bad) OVER w)::BIGINT AS all_bad FROM branch{t} WINDOW w AS (PARTITION BY host, prefix)),
alike{t} AS (SELECT host, prefix, name FROM sums{t} WHERE all_n > n AND {_chi_square()}),
tree{level + 1} AS (
    SELECT a.* EXCLUDE (name) REPLACE (a.prefix || CASE WHEN a.name IS NULL THEN ''
        WHEN m.name IS NOT NULL THEN '/~' ELSE '/' || a.name END AS prefix)
    FROM starred{t} a LEFT JOIN alike{t} m USING (host, prefix, name))""")
    return ",".join(parts) + f""",
pooled AS (
    SELECT host, prefix, n_template, {_purity()} AS purity
    FROM (SELECT host, prefix, sum(n)::BIGINT AS n_template, sum(good)::BIGINT AS good,
        sum(bad)::BIGINT AS bad FROM tree{DEPTH + 1} GROUP BY ALL))
SELECT u.page_id, u.host, u.path, u.rule,
    coalesce(u.rule_verdict, CASE WHEN p.purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
    t.prefix AS template, p.n_template, p.purity
FROM urls u LEFT JOIN tree{DEPTH + 1} t USING (host, segments) LEFT JOIN pooled p USING (host, prefix)"""
