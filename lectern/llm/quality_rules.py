"""Weak supervision: rules vote on each document, EM learns how far to trust each rule.

A rule votes good (1) or bad (-1) or abstains (0). The model has the share ``p`` of good documents and
two accuracies a rule: how often its votes on good documents say good, and its votes on bad ones bad.
Expectation-maximisation runs over the counts of vote patterns (at most three to the number of rules,
whatever the corpus), as one fold in SQL; the posterior probability of good replaces a filter that
asks all rules to pass.

Every estimate starts from, and is pulled to, the values in ``START`` with the weight of ``PSEUDO`` votes. That
weight is fixed, so a corpus of any size outweighs it; ``LOW`` and ``HIGH`` bound what one rule's vote can say, so
that fits to a small and a large corpus of one kind agree. Accuracies are kept better than chance.

Documents that fail the base test (under 10 words, or over a fifth of the words in repeated five-word
windows) are rejected without a vote, and are not fitted.

Counts are of the whole text, however long. Variety is the mean share of distinct words over blocks of ``BLOCK`` words that
cover the text (the last one ends with the text, so all blocks are equally long); a shorter text is one block.

Each text is measured once: counts and votes are written beside the row, and verdicts are made from that table. Only
the pattern counts are shuffled, and their number is bounded.

Defined results: null text is an empty text and fails the base test; rows that repeat are judged each on
their own; documents with equal votes have equal verdicts, and a posterior of just a half is kept; a null ``doc_id`` stays
null; an empty table gives no rows; other columns are ignored (or kept as they are by ``keep``, whatever their names).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.native import let, words
from lectern.session import discard, materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Words in a block of the variety rule.
BLOCK = 400
ITERATIONS = 25
#: Share of good documents and accuracies on good and bad ones before the first step.
START = (0.9, 0.95, 0.5)
#: Votes that the start counts for, and bounds of every estimate.
PSEUDO, LOW, HIGH = 10.0, 0.002, 0.998

#: Words that are a mark of a list or table, and marks that end a word.
BARE = "|-*•–—"
ENDS = ".,;:!?"
#: Rule: name, measure, good up to, bad from. Between, or if the measure is null, the rule abstains.
RULES = (
    ("symbols", "n_symbols / n_words", 0.05, 0.3),
    ("bare", "n_bare / n_words", 0.1, 0.3),
    ("stutter", "n_stutter / n_words", 0.03, 0.2),
    ("variety", "1 - n_distinct / least(n_words, 400)", 0.3, 0.42),
    ("ends", "1 - n_ends / n_words", 0.92, 0.95),
    ("length", "abs(word_chars / n_words - 6)", 1.2, 1.6),
    ("capitals", "n_capitals / word_chars", 0.15, 0.3),
    ("marks", "n_marks / n_words", 0.05, 0.2),
    ("repeats", "n_repeat_words / n_words", 0.05, 0.15),
    ("lines", "n_dup_lines / nullif(n_lines, 0)", 0.1, 0.4),
)


def _repeated(w: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text."""
    blank = F.lit(0).cast("long")

    def by_windows(v: Column) -> Column:
        def covered(s: Column) -> Column:
            """From windows sorted by text and place: each repeat covers what the one before it left."""
            twice = F.filter(
                s,
                lambda x, k: (F.when(k > 0, F.get(s, k - 1)["v"]) == x["v"]) | (F.get(s, k + 1)["v"] == x["v"]),
            )
            places = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), blank.alias("n"))
            return F.aggregate(
                places,
                start,
                lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
                lambda a: a["n"],
            )

        return let(F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("v"), i.alias("i")))), covered)

    def windows(of: Callable[..., Column]) -> Column:
        # F.slice copies its whole array at each call; places are read one by one
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: of(*[F.get(w, i + j) for j in range(WINDOW)]))

    # equal windows have equal hashes: where all hashes differ, nothing repeats
    unlike = let(windows(F.xxhash64), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    exact = let(windows(lambda *x: F.concat_ws(" ", *x)), by_windows)
    return F.when(F.size(w) <= WINDOW, blank).when(unlike, blank).otherwise(exact)


def _distinct(w: Column) -> Column:
    """Mean number of distinct words of the blocks that cover the text."""

    def of(i: Column) -> Column:
        first = F.least(i * BLOCK, F.greatest(F.size(w) - BLOCK, F.lit(0)))
        return F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.least(F.size(w), F.lit(BLOCK)) - 1), lambda j: F.get(w, first + j))))

    blocks = F.ceil(F.size(w) / BLOCK).cast("int")
    sums = F.aggregate(F.sequence(F.lit(0), blocks - 1), F.lit(0).cast("long"), lambda a, i: a + of(i))
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(sums / blocks)


def _measured(text: Column) -> Column:
    """A struct of counts of one text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")

    def of(w: Column) -> Column:
        same = F.filter(w, lambda x, i: x == F.get(w, i - 1))

        def marks(j: Column) -> Column:
            """Counted by what is gone without them: each word has a blank on either side of its own."""
            gone = lambda x: (F.octet_length(j) - F.octet_length(F.replace(j, F.lit(x), F.lit("")))) / len(x.encode())
            return F.struct(*[sum((gone(f"{blank}{x} ") for x in some), F.lit(0.0)).cast("long").alias(name) for name, blank, some in (("n_bare", " ", BARE), ("n_ends", "", ENDS))])

        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            _distinct(w).alias("n_distinct"),
            F.size(same).cast("long").alias("n_stutter"),
            let(F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")), marks).alias("marks"),
            count(r"\p{Lu}").alias("n_capitals"),
            count("[!?]{2}").alias("n_marks"),
        )

    return let(words(text), of)


def measure(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id (or the whole row as a struct), the counts of each whole text, base_failed and the rules' votes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if row else F.col("doc_id").cast("long").alias("doc_id")
    counted = docs.select(first, _measured(text).alias("m")).select("row" if row else "doc_id", "m.*").select("*", "marks.*").drop("marks")
    return _with_votes(counted)


def _with_votes(counted: DataFrame) -> DataFrame:
    failed = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    votes = [F.expr(f"case when {m} <= {good}D then 1 when {m} >= {bad}D then -1 else 0 end") for _, m, good, bad in RULES]
    return counted.withColumns({"base_failed": failed, "votes": F.when(~failed, F.array(*votes))})


@dataclass(frozen=True)
class Trust:
    """A fitted model: the share of good documents, and each rule's accuracy on good and bad ones."""

    p: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: Column) -> Column:
        """Probability that a document with these votes is good."""
        return _posterior(F.lit(self.p), [F.lit(x) for x in self.good], [F.lit(x) for x in self.bad], votes)


def _posterior(p: Column, good: list[Column], bad: list[Column], votes: Column) -> Column:
    one = F.lit(1.0)
    is_good, is_bad = p, one - p
    for j, (g, b) in enumerate(zip(good, bad, strict=True)):
        v = votes[j]
        is_good = is_good * F.when(v == 1, g).when(v == -1, one - g).otherwise(one)
        is_bad = is_bad * F.when(v == 1, one - b).when(v == -1, b).otherwise(one)
    return is_good / (is_good + is_bad)


def fit(measured: DataFrame, rules: int = len(RULES)) -> Trust:
    """EM over the vote patterns of the documents that pass the base test (base_failed, votes of ``rules`` rules)."""
    k = rules
    patterns = (
        measured.where("not base_failed").groupBy("votes").agg(F.count("*").cast("double").alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    )
    start = F.struct(F.lit(START[0]).alias("p"), F.array(*[F.lit(START[1])] * k).alias("good"), F.array(*[F.lit(START[2])] * k).alias("bad"))
    zero = F.lit(0.0)

    def step(a: Column, t: Column) -> Column:
        weighed = F.transform(
            F.col("patterns"),
            lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * _posterior(a["p"], [a["good"][j] for j in range(k)], [a["bad"][j] for j in range(k)], x["votes"])).alias("r")),
        )

        def update(w: Column) -> Column:
            share = lambda up, of, prior: F.least(F.lit(HIGH), F.greatest(F.lit(LOW), (up + PSEUDO * prior) / (of + PSEUDO)))
            plus = lambda f: F.aggregate(w, zero, lambda s, x: s + f(x))
            good = [
                F.greatest(F.lit(0.5), share(plus(lambda x, j=j: F.when(x["votes"][j] == 1, x["r"]).otherwise(zero)), plus(lambda x, j=j: F.when(x["votes"][j] != 0, x["r"]).otherwise(zero)), START[1]))
                for j in range(k)
            ]
            bad = [
                share(plus(lambda x, j=j: F.when(x["votes"][j] == -1, x["n"] - x["r"]).otherwise(zero)), plus(lambda x, j=j: F.when(x["votes"][j] != 0, x["n"] - x["r"]).otherwise(zero)), START[2])
                for j in range(k)
            ]
            return let(
                F.array(*good),
                lambda g: F.struct(
                    share(plus(lambda x: x["r"]), plus(lambda x: x["n"]), START[0]).alias("p"), g.alias("good"), F.array(*[F.greatest(F.lit(1.0) - g[j], b) for j, b in enumerate(bad)]).alias("bad")
                ),
            )

        return let(weighed, update)

    got = patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(ITERATIONS)), start, step).alias("m")).select("m.*").first()
    return Trust(got["p"], tuple(got["good"]), tuple(got["bad"]))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, posterior and kept of each document of ``docs`` (doc_id, text)."""
    measured = materialize(measure(docs), "votes")
    return verdicts(measured, fit(measured))


def verdicts(measured: DataFrame, trust: Trust) -> DataFrame:
    p = F.when(~F.col("base_failed"), trust.posterior(F.col("votes")))
    return measured.withColumn("posterior", p).withColumn("kept", F.coalesce(F.col("posterior") >= 0.5, F.lit(False)))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The rows are stored with their votes: a filter over the measurement itself would be pushed below it and take a copy of
    it for each place where a count is used.
    """
    measured = materialize(measure(docs, row=True).select("row", "base_failed", "votes"), "votes")
    return verdicts(measured, fit(measured)).where("kept").select("row.*")


def oracle_sql() -> str:
    """The contract's columns in DuckDB SQL; each EM step is a query over the pattern counts."""
    k = len(RULES)
    blank = "[\\x20\\x09-\\x0D]+"
    votes = ", ".join(f"CASE WHEN {m.replace('nullif(n_lines, 0)', 'nullif(n_lines, 0)::DOUBLE')} <= {good} THEN 1 WHEN {m} >= {bad} THEN -1 ELSE 0 END AS v{j}" for j, (_, m, good, bad) in enumerate(RULES))
    v = ", ".join(f"v{j}" for j in range(k))
    posterior = (
        "(p * " + " * ".join(f"(CASE v{j} WHEN 1 THEN g{j} WHEN -1 THEN 1 - g{j} ELSE 1 END)" for j in range(k)) + ")",
        "((1 - p) * " + " * ".join(f"(CASE v{j} WHEN 1 THEN 1 - b{j} WHEN -1 THEN b{j} ELSE 1 END)" for j in range(k)) + ")",
    )
    r = f"({posterior[0]} / ({posterior[0]} + {posterior[1]}))"
    share = lambda up, of, prior: f"least({HIGH}, greatest({LOW}, (coalesce({up}, 0) + {PSEUDO * prior}) / (coalesce({of}, 0) + {PSEUDO})))"
    steps = [f"em0 AS (SELECT {START[0]}::DOUBLE AS p, " + ", ".join(f"{START[1]}::DOUBLE AS g{j}, {START[2]}::DOUBLE AS b{j}" for j in range(k)) + ")"]
    for t in range(ITERATIONS):
        good = ", ".join(
            f"greatest(0.5, {share(f'sum(r) FILTER (v{j} = 1)', f'sum(r) FILTER (v{j} <> 0)', START[1])}) AS g{j}, {share(f'sum(n - r) FILTER (v{j} = -1)', f'sum(n - r) FILTER (v{j} <> 0)', START[2])} AS c{j}" for j in range(k)
        )
        steps.append(
            f"w{t} AS (SELECT n, {v}, n * {r} AS r FROM patterns, em{t}), m{t} AS (SELECT {share('sum(r)', 'sum(n)', START[0])} AS p, {good} FROM w{t}), "
            f"em{t + 1} AS MATERIALIZED (SELECT p, " + ", ".join(f"g{j}, greatest(1 - g{j}, c{j}) AS b{j}" for j in range(k)) + f" FROM m{t})"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(text, '{blank}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT row_id, unnest(list_transform(range(1, len(w) - 3), lambda i: {{'i': i, 's': array_to_string(w[i:i + 4], ' ')}})) AS x FROM cut),
twice AS (SELECT row_id, i FROM (SELECT row_id, x.i AS i, count(*) OVER (PARTITION BY row_id, x.s) AS c FROM win) WHERE c > 1),
covered AS (SELECT row_id, sum(n)::BIGINT AS n_repeat_words FROM (SELECT row_id, least({WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY row_id ORDER BY i), -{WINDOW})) AS n FROM twice) GROUP BY row_id),
m AS (SELECT cut.row_id, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
  coalesce(list_avg(list_transform(range(0, len(w), {BLOCK}), lambda i: len(list_distinct(w[least(i, greatest(len(w) - {BLOCK}, 0)) + 1:least(i, greatest(len(w) - {BLOCK}, 0)) + {BLOCK}])))), 0) AS n_distinct,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter, len(list_filter(w, lambda x: length(x) = 1 AND contains('{BARE}', x))) AS n_bare, len(list_filter(w, lambda x: contains('{ENDS}', right(x, 1)))) AS n_ends,
  len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals, len(regexp_extract_all(text, '[!?]{{2}}')) AS n_marks FROM cut LEFT JOIN covered USING (row_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
voted AS (SELECT *, {votes} FROM base WHERE NOT base_failed),
patterns AS MATERIALIZED (SELECT {v}, count(*)::DOUBLE AS n FROM voted GROUP BY {v}),
{", ".join(steps)},
fate AS (SELECT row_id, {r} >= 0.5 AS kept FROM voted, em{ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(kept, FALSE) AS kept FROM base LEFT JOIN fate USING (row_id)
"""
