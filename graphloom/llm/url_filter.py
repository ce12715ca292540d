"""URL filter: rules first, then the ratio of two variable-order character Markov models (DataFrame functions only).

URLs that a rule decides teach two models, one of accepted and one of blocked URLs.  Characters are lower-cased and
folded to a fixed alphabet.  Each symbol is predicted after the longest kept context before it, of at most ``ORDER``
symbols: all contexts of up to one symbol are kept, a longer one where it makes up at least 1 in ``CONTEXTS`` of the taught
symbols, so at most ``CONTEXTS`` of each length are.  Probabilities are smoothed (Witten-Bell) down through ever
shorter contexts to the uniform distribution.  The score of a URL is the log-likelihood difference of the models
per symbol.  A held-out fifth of the rule-decided URLs calibrates the threshold (best balanced accuracy, nearest to 0
among ties).

The kept contexts and their successors are a finite automaton of proven size; its two arrays, the log ratio and the next
state of each state and symbol, become literals of the plan, so a URL is scored inside its row, without a join or shuffle.
Training uses distinct URLs, so copies of one URL do not weigh.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule fits it, and the models
judge its text (null: empty); repeated rows each get a row; with no rule-decided URL all scores are 0 and
everything is allowed; all input columns are kept unless they bear a result's name (in any letter case); a URL of any
length is read whole.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.scratch import exact, other_columns, stash


class Rule(NamedTuple):
    verdict: str
    pattern: str


DEFAULT_RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))

SYMBOLS = string.ascii_lowercase + string.digits + "./-_?=&%#:~"  # the last stands for every other character
START, END = "^", "$"
OUTCOMES = SYMBOLS + END
ORDER, CONTEXTS = 4, 2000
SIDES = ("allow", "block")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits (ties: the smaller pattern), else nulls."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r.pattern), r.pattern), reverse=False):
        rule_host, slash, rule_path = rule.pattern.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        pattern = F.when(fits, F.lit(rule.pattern)).otherwise(pattern)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return pattern, verdict


def folded(url: Column) -> Column:
    """The URL in the alphabet; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"[^a-z0-9./\-_?=&%#:]", "~")


def grams_of(url: Column) -> Column:
    """Each symbol, and the end, after the ``ORDER`` symbols before it."""
    framed = F.concat(F.lit(START * ORDER), folded(url), F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.char_length(framed) - ORDER), lambda i: framed.substr(i, F.lit(ORDER + 1)))


def codes_of(url: Column) -> Column:
    """The places of the URL's symbols and of the end in ``OUTCOMES``."""
    letters = F.filter(F.split(folded(url), ""), lambda c: c != "")
    return F.array_append(F.transform(letters, lambda c: F.position(c, F.lit(OUTCOMES)) - 1), F.lit(len(SYMBOLS)))


def context_model(grams: DataFrame) -> DataFrame:
    """context, symbol, ratio: log10 of the models' ratio for each kept context and each outcome; ``grams`` has gram, verdict."""
    counts = grams.groupBy("gram").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in SIDES])
    counts = stash(counts.select(F.expr(f"substr(gram, 1, {ORDER})").alias("context"), F.expr(f"substr(gram, {ORDER + 1})").alias("symbol"), *SIDES), "grams")
    total = counts.agg(F.coalesce(F.sum(F.col("allow") + F.col("block")), F.lit(0))).first()[0]
    outcomes = F.explode(F.array(*map(F.lit, OUTCOMES))).alias("symbol")
    model = None
    for order in range(ORDER + 1):
        context = F.expr(f"substr(context, {ORDER - order + 1})") if order else F.lit("")
        level = counts.groupBy(context.alias("context"), "symbol").agg(*[F.sum(v).alias(v) for v in SIDES])
        totals = level.groupBy("context").agg(*[F.sum(v).alias(f"n_{v}") for v in SIDES], *[F.count_if(F.col(v) > 0).alias(f"kinds_{v}") for v in SIDES])
        kept = totals if order < 2 else totals.where((F.col("n_allow") + F.col("n_block")) * CONTEXTS >= total)
        dense = kept.select("*", outcomes).join(level, ["context", "symbol"], "left").na.fill(0, list(SIDES))
        if model is None:
            dense = dense.select("*", *[F.lit(1.0 / len(OUTCOMES)).alias(f"base_{v}") for v in SIDES])
        else:
            below = model.where(F.length("context") == order - 1).select(F.col("context").alias("shorter"), "symbol", *[F.col(f"p_{v}").alias(f"base_{v}") for v in SIDES])
            dense = dense.withColumn("shorter", F.expr("substr(context, 2)")).join(below, ["shorter", "symbol"])
        smoothed = [F.when(F.col(f"n_{v}") > 0, (F.col(v) + F.col(f"kinds_{v}") * F.col(f"base_{v}")) / (F.col(f"n_{v}") + F.col(f"kinds_{v}"))).otherwise(F.col(f"base_{v}")).alias(f"p_{v}") for v in SIDES]
        level = stash(dense.select("context", "symbol", *smoothed), "model")
        model = level if model is None else model.unionByName(level)
    return model.select("context", "symbol", (F.log10("p_allow") - F.log10("p_block")).alias("ratio"))


class Automaton(NamedTuple):
    """Arrays over state * len(OUTCOMES) + symbol, as comma-joined numbers, and the state before a URL."""

    ratios: str
    onward: str
    start: int

    def score(self, url: Column) -> Column:
        """The mean log ratio of the URL's symbols."""
        ratios, onward = F.split(F.lit(self.ratios), ",").cast("array<double>"), F.split(F.lit(self.onward), ",").cast("array<int>")

        def step(acc: Column, code: Column) -> Column:
            at = acc["state"] * len(OUTCOMES) + code
            return F.struct(F.get(onward, at).alias("state"), (acc["total"] + F.get(ratios, at)).alias("total"), (acc["n"] + 1).alias("n"))

        zero = F.struct(F.lit(self.start).alias("state"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))
        return F.aggregate(codes_of(url), zero, step, lambda acc: acc["total"] / acc["n"])


def automaton(model: DataFrame) -> Automaton | None:
    """The model's arrays: at most ``(ORDER - 1) * CONTEXTS + 50`` states; None for an empty model."""
    contexts = model.select("context").distinct().withColumn("state", F.row_number().over(Window.orderBy(F.length("context"), "context")) - 1)
    states = stash(contexts, "states")
    grown = model.withColumn("grown", F.concat("context", "symbol"))
    ends = F.transform(F.sequence(F.lit(0), F.least(F.length("grown"), F.lit(ORDER))), lambda n: F.when(n == 0, "").otherwise(F.col("grown").substr(F.length("grown") - n + 1, n)))
    longest = grown.select(F.col("context").alias("at"), "symbol", F.explode(ends).alias("context")).join(states, "context").groupBy("at", "symbol").agg(F.max_by("state", F.length("context")).alias("next"))
    rows = model.join(states, "context").join(longest.withColumnRenamed("at", "context"), ["context", "symbol"])
    place = F.col("state") * len(OUTCOMES) + F.position("symbol", F.lit(OUTCOMES)) - 1
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), "ratio", "next")))
    joined = lambda field: F.array_join(F.transform("o", lambda x: x[field].cast("string")), ",")
    row = rows.agg(ordered.alias("o")).select(joined("ratio"), joined("next")).first()
    if not row[0]:
        return None
    start = states.where(F.lit(START * ORDER).endswith(F.col("context"))).agg(F.max_by("state", F.length("context"))).first()[0]
    return Automaton(row[0], row[1], start)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null: none fits), score and verdict (allow or block)."""
    host, path = url_parts(F.col(url))
    rule, verdict = matching_rule(host, path, rules)

    decided = pages.select(F.col(url).alias("u"), verdict.alias("verdict")).where("verdict is not null").distinct()
    decided = decided.withColumn("held_out", F.crc32(F.col("u").cast("binary")) % 5 == 0)
    taught = decided.where(~F.col("held_out")).select("verdict", F.explode(grams_of(F.col("u"))).alias("gram"))
    model = automaton(context_model(taught))

    threshold, score = 0.0, F.lit(0.0)
    if model is not None:
        score = model.score(F.col(url))
        trial = decided.where("held_out").select("verdict", model.score(F.col("u")).alias("score"))
        bins = trial.groupBy(F.round(F.greatest(F.least("score", F.lit(5.0)), F.lit(-5.0)) * 200).cast("int").alias("bin")).agg(
            F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")
        )
        threshold = best_threshold([(r["bin"] / 200, r["good"], r["bad"]) for r in bins.collect()])  # at most 2001 rows

    own = other_columns(pages, "host", "path", "rule", "score", "verdict")
    by_model = F.when(score >= threshold, "allow").otherwise("block")
    return pages.select(*map(exact, own), host.alias("host"), path.alias("path"), rule.alias("rule"), score.alias("score"), F.coalesce(verdict, by_model).alias("verdict"))


def best_threshold(bins: Sequence[tuple[float, int, int]]) -> float:
    """The score from which to allow: best balanced accuracy over (score, allowed, blocked) bins.

    Candidates lie midway between neighbouring bins; among ties the one nearest to 0 wins.  Without bins it is 0.
    """
    if not bins:
        return 0.0
    ranked = sorted(bins)
    good, bad = sum(b[1] for b in ranked), sum(b[2] for b in ranked)
    best, passed, stopped, before = (-1.0, 0.0, 0.0), good, 0, ranked[0][0] - 0.01
    for score, g, b in [*ranked, (ranked[-1][0] + 0.01, 0, 0)]:
        edge = (before + score) / 2
        best = max(best, (round(passed / (good or 1) + stopped / (bad or 1), 9), -abs(edge), edge))
        passed, stopped, before = passed - g, stopped + b, score
    return best[2]
