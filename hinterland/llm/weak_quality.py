"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinterland.llm.scratch import Scratch

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"

#: name, condition of a vote to keep, condition of a vote to reject; neither is an abstention.
#: The conditions are SQL over the counts below, with integers only. Rules that know one kind of
#: bad document abstain on the rest.
RULES = (
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("repeats", "20 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    ("word_length", "FALSE", "word_chars > 7 * n_words OR word_chars < 2 * n_words"),
    ("lines", "FALSE", "2 * n_dup_lines > n_lines"),
    ("variety", "FALSE", "3 * n_fresh_words < n_words"),
)
#: Fresh words are the distinct ones of each run of so many words, added up: unlike the distinct
#: words of a whole text their share does not fall with its length.
RUN_WORDS = 100
STEPS = 25
#: Shares of good documents, and of votes to keep and to reject among good and among bad ones:
#: where EM starts, and what it is smoothed towards with the weight of so many documents.
PRIOR_GOOD, PRIOR_WEIGHT = 0.9, 20.0
PRIOR = {"gk": 0.5, "gr": 0.001, "bk": 0.3, "br": 0.2}
#: Rules reject at most this share of good documents. EM alone may swap the classes where a
#: crawl is mostly junk, as nothing but the start says which class is the good one; with the clamp
#: a vote to reject always speaks against a document.
MOST_REJECTED = 0.001
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents; for each rule the shares of its votes by class, as in PRIOR."""

    good: float
    rates: tuple[dict[str, float], ...]

    def evidence(self) -> list[dict[int, float]]:
        """What each vote of each rule adds to the log odds of a good document."""
        return [{
            1: math.log(r["gk"]) - math.log(r["bk"]),
            -1: math.log(r["gr"]) - math.log(r["br"]),
            0: math.log(1 - r["gk"] - r["gr"]) - math.log(1 - r["bk"] - r["br"]),
        } for r in self.rates]

    def start(self) -> float:
        return math.log(self.good) - math.log(1 - self.good)

    def log_odds(self, votes: list[Column]) -> Column:
        total = F.lit(self.start())
        for vote, adds in zip(votes, self.evidence(), strict=True):
            total = total + F.when(vote == 1, adds[1]).when(vote == -1, adds[-1]).otherwise(adds[0])
        return total


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over each whole text, row by row, without a shuffle.

    Repeated windows are found by sorting a text's (window hash, position) pairs, so the work is
    n log n in its words. NULL and empty texts have zeros.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0)))
    rows = rows.withColumn(
        "lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")))
    rows = rows.select(
        "doc_id", "words",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""aggregate(sequence(0, greatest(size(words) - 1, 0) div {RUN_WORDS}), 0L, (a, i) ->
            a + size(array_distinct(slice(words, CAST(i * {RUN_WORDS} + 1 AS INT), {RUN_WORDS}))))""")
        .alias("n_fresh_words"),
    )
    rows = rows.withColumn("windows", F.expr("""
        sort_array(CASE WHEN n_words >= 3 THEN
            transform(sequence(0, CAST(n_words AS INT) - 3),
                      i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))
        ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END)"""))
    rows = rows.withColumn("twice", F.expr("""
        array_distinct(flatten(filter(
            zip_with(windows, slice(windows, 2, greatest(size(windows) - 1, 0)),
                     (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) END),
            x -> x IS NOT NULL)))"""))
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda i: F.array(i, i + 1, i + 2))))
    return rows.withColumn("n_repeat_words", F.size(covered).cast("long")).drop(
        "words", "windows", "twice")


def vote_columns() -> list[Column]:
    return [F.expr(f"CASE WHEN {keep} THEN 1 WHEN {reject} THEN -1 ELSE 0 END").alias(f"vote_{name}")
            for name, keep, reject in RULES]


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], steps: int = STEPS) -> VoteModel:
    """Expectation-maximisation over the table of vote patterns, of at most 3 ** rules rows.

    All shares are smoothed, so none is 0 or 1. An empty table gives the starting values.
    """
    model = VoteModel(PRIOR_GOOD, (PRIOR,) * len(RULES))
    for _ in range(steps):
        adds, start = model.evidence(), model.start()
        weights = []
        for votes, n in patterns:
            odds = start + sum(adds[j][v] for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-odds))
            weights.append((votes, n * p, n * (1 - p)))
        good = sum(g for _, g, _ in weights)
        bad = sum(b for _, _, b in weights)

        def share(part: float, whole: float, prior: float) -> float:
            return (part + prior * PRIOR_WEIGHT) / (whole + PRIOR_WEIGHT)

        rates = []
        for j in range(len(RULES)):
            rates.append({
                "gk": share(sum(g for v, g, _ in weights if v[j] == 1), good, PRIOR["gk"]),
                "gr": min(share(sum(g for v, g, _ in weights if v[j] == -1), good, PRIOR["gr"]),
                          MOST_REJECTED),
                "bk": share(sum(b for v, _, b in weights if v[j] == 1), bad, PRIOR["bk"]),
                "br": share(sum(b for v, _, b in weights if v[j] == -1), bad, PRIOR["br"]),
            })
        model = VoteModel(share(good, good + bad, PRIOR_GOOD), tuple(rates))
    return model


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, votes, ``base_failed``, ``p_good`` and ``kept``.

    The votes of all documents that pass the base rules are counted by pattern; EM on that small
    table estimates how often each rule is right, and such a document is kept if its posterior
    probability of being good is at least one half. NULL, empty and wordless texts fail
    them. Repeated rows get a row each; rows without an id are judged like others; other columns
    are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    counted = features(docs, id_col, text_col)
    rows = scratch.keep(counted.select("*", *vote_columns()), "votes")
    names = [f"vote_{name}" for name, _, _ in RULES]
    patterns = [(tuple(r[n] for n in names), r["count"])
                for r in rows.where(f"NOT ({BASE_FAILED})").groupBy(*names).count().collect()]
    model = fit_votes(sorted(patterns))
    odds = model.log_odds([F.col(n) for n in names])
    return rows.withColumns({
        "base_failed": F.expr(BASE_FAILED),
        "p_good": 1 / (1 + F.exp(-odds)),
    }).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def oracle() -> str:
    """The same in DuckDB; EM is a recursive query over the table of vote patterns."""
    names = [name for name, _, _ in RULES]
    votes = ",\n".join(
        f"CASE WHEN {keep} THEN 1 WHEN {reject} THEN -1 ELSE 0 END AS v_{n}"
        for n, keep, reject in RULES)
    odds = "ln(m.good) - ln(1 - m.good)" + "".join(
        f" + CASE x.v_{n} WHEN 1 THEN ln(m.gk_{n}) - ln(m.bk_{n}) "
        f"WHEN -1 THEN ln(m.gr_{n}) - ln(m.br_{n}) "
        f"ELSE ln(1 - m.gk_{n} - m.gr_{n}) - ln(1 - m.bk_{n} - m.br_{n}) END" for n in names)

    def share(part: str, whole: str, prior: float) -> str:
        return (f"(coalesce({part}, 0) + {prior * PRIOR_WEIGHT}) "
                f"/ (coalesce({whole}, 0) + {PRIOR_WEIGHT})")

    def rate(kind: str, n: str) -> str:
        weight = "n * p" if kind[0] == "g" else "n * (1 - p)"
        vote = 1 if kind[1] == "k" else -1
        found = share(f"sum({weight}) FILTER (v_{n} = {vote})", f"sum({weight})", PRIOR[kind])
        return f"least({found}, {MOST_REJECTED})" if kind == "gr" else found

    rates = ", ".join(f"{rate(kind, n)} AS {kind}_{n}" for n in names for kind in PRIOR)
    start = ", ".join(f"{value}::DOUBLE AS {kind}_{n}" for n in names for kind, value in PRIOR.items())
    return rf"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT rid, doc_id, text, regexp_extract_all(text, '[^{SPACE}]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines
    FROM texts),
windows AS (
    SELECT rid, i, row(words[i], words[i + 1], words[i + 2]) AS w
    FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM split)),
twice AS (
    SELECT rid, i FROM windows
    QUALIFY count(*) OVER (PARTITION BY rid, w) > 1),
covered AS (
    SELECT rid, count(DISTINCT j) AS n
    FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
counts AS (
    SELECT s.doc_id, len(words)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(list_sum(list_transform(range(0, len(words), {RUN_WORDS}),
            lambda i: len(list_distinct(words[i + 1:i + {RUN_WORDS}])))), 0)::BIGINT AS n_fresh_words,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM split s LEFT JOIN covered c USING (rid)),
voted AS (SELECT *, {votes} FROM counts),
patterns AS (SELECT {", ".join(f"v_{n}" for n in names)}, count(*) AS n
    FROM voted WHERE NOT ({BASE_FAILED}) GROUP BY ALL),
model AS (
    SELECT 0 AS step, {PRIOR_GOOD}::DOUBLE AS good, {start}
    UNION ALL
    SELECT any_value(step) + 1, {share("sum(n * p)", "sum(n)", PRIOR_GOOD)} AS good, {rates}
    FROM (SELECT m.step, x.*, 1 / (1 + exp(-({odds}))) AS p FROM model m, patterns x
          WHERE m.step < {STEPS})
    HAVING count(*) > 0)
SELECT x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words,
    ({BASE_FAILED}) AS base_failed,
    NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM voted x, (SELECT * FROM model WHERE step = {STEPS}) m"""
