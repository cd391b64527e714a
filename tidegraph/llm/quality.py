"""Quality rules by weak supervision, on built-in functions only.

Rules look at a document and vote good or bad, or abstain. What a vote is worth is
not set by hand and not learned from labels: expectation maximisation over all
documents estimates, for each rule, how often it votes good, bad or not at all
among good and among bad documents, together with the share of good ones. A rule
that fires equally often in both classes is noise and weighs nothing; one that is
quiet where others find defects speaks for a document by being quiet. The verdict
is the posterior probability that a document is good.

The estimate has no floors. It starts from a weak belief about what rules mean, a
few imagined documents for each rule and class; these fix which of the two classes
is called good, and are outweighed by any sizeable table.

Documents with the same votes are the same to the model, so it works on the
counts of vote patterns: at most 3 to the number of rules, however many documents
there are. They are fetched once, and the rounds are plain arithmetic on them.

Defined cases: a null text has no words; it, like any document under the least
number of words, fails the base rules. A base failure is never kept and does not
enter the estimate. Lengths are in code points; words are runs between ASCII
white space. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.scratch import Scratch

SYMBOLS = "#*$%&|<>"
# letters or digits with at most one mark behind
PLAIN_WORD = r"""(?<!\S)[\p{L}\p{M}\p{N}'’-]++[.,;:?!)"]?(?!\S)"""
WINDOW = 5
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20
GOOD, BAD, ABSTAIN = 1, -1, 0
KEEP_FROM = 0.5


# ---- measures -------------------------------------------------------------


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _windows(hashes: Column) -> Column:
    """A hash of each run of ``WINDOW`` words; ``hashes`` are those of the words."""
    at = lambda i, k: F.get(hashes, i + k if k else i)
    return F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]),
    )


def _by_hash(windows: Column) -> Column:
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated_places(by_hash: str) -> Column:
    """The places, in order, of the windows that stand beside their like when
    sorted by hash. A column's name, as its values are looked up by number."""
    h = lambda i: F.get(by_hash, i).getField("h")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return F.array_sort(F.filter(
        F.transform(by_hash, lambda x, i: F.when(
            same(x.getField("h"), h(i + 1)) | same(x.getField("h"), h(i - 1)), x.getField("i"))),
        lambda i: i.isNotNull()))


def _sum_of_gaps(places: Column) -> Column:
    """Words covered by windows at these places: each adds those up to the next,
    at most a window."""
    zero = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        places, zero,
        lambda a, i: F.struct(
            (a.getField("words") + F.least(F.lit(WINDOW), i - a.getField("last"))).alias("words"),
            i.alias("last")),
        lambda a: a.getField("words"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of its text. Each array is made in a step of
    its own, so that no step makes one twice."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    steps = (
        docs.select("doc_id", text.alias("t"))
        .withColumn("w", _words(F.col("t")))
        .withColumn("l", lines)
        .withColumn("n_words", F.size("w").cast("long"))
        .withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
        .withColumn("win", F.when(F.col("n_words") >= WINDOW, _windows(F.col("h"))))
        # most texts repeat no window: those need no sorting
        .withColumn("again", F.coalesce(F.size("win") > F.size(F.array_distinct("win")), F.lit(False)))
        .withColumn("by_hash", F.when(F.col("again"), _by_hash(F.col("win"))))
    )
    def ascii_marks(marks: str) -> Column:
        # taken out byte by byte, so that no list of matches is kept, however long the text
        left = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), marks, F.col("t"))
        return F.octet_length("t") - F.octet_length(left)

    upper = F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[A-Z]+", ""))
    return steps.select(
        "doc_id", "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        ascii_marks(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), _sum_of_gaps(_repeated_places("by_hash"))).otherwise(0).cast("long")
        .alias("n_repeat_words"),
        F.size("l").alias("n_lines"),
        upper.alias("n_upper"), ascii_marks(".!?").alias("n_ends"), ascii_marks("!").alias("n_bangs"),
        F.regexp_count("t", F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
    )


# ---- votes ----------------------------------------------------------------


def _vote(good: Column | None = None, bad: Column | None = None) -> Column:
    vote = F.when(bad, BAD)
    return (vote if good is None else vote.when(good, GOOD)).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The votes. Rules on what prose looks like vote both ways and abstain between
    their clear cases; rules on single defects vote bad or abstain."""
    words = F.col("n_words")
    chars = F.col("word_chars")
    ends = F.col("n_ends")
    return {
        "symbols": _vote(F.col("n_symbols") == 0, F.col("n_symbols") > 0.2 * words),
        "capitals": _vote(F.col("n_upper") < 0.1 * chars, F.col("n_upper") > 0.4 * chars),
        "repeated_words": _vote(bad=F.col("n_repeat_words") > 0.1 * words),
        "repeated_lines": _vote(bad=F.col("n_dup_lines") > 0.3 * F.col("n_lines")),
        "few_distinct_words": _vote(bad=F.col("n_distinct") < F.least(F.sqrt(words), words / 4)),
        "exclamations": _vote(bad=F.col("n_bangs") > 0.3 * words),
        "plain_words": _vote(F.col("n_plain") >= 0.9 * words, F.col("n_plain") < 0.6 * words),
        "word_length": _vote(chars.between(3 * words, 9 * words), (chars < 2 * words) | (chars > 14 * words)),
        "sentences": _vote(ends.between(0.02 * words, 0.3 * words),
                           (words > 250 * ends + 50) | (ends > words)),
    }


# ---- the estimate ---------------------------------------------------------

VOTES = (GOOD, BAD, ABSTAIN)
START_SHARE = 0.8
# how a rule is believed to vote among good and bad documents: good, bad, not at all
BELIEF = ((0.55, 0.05, 0.4), (0.25, 0.35, 0.4))
IMAGINED = 10.0  # documents of each class behind that belief, for each rule
ROUNDS, CLOSE = 200, 1e-7

# of each rule, the share of VOTES among good and among bad documents
Habits = dict[str, tuple[tuple[float, ...], tuple[float, ...]]]


def _log_odds(share: float, habits: Habits) -> tuple[float, dict[str, dict[int, float]]]:
    """What the share and each vote add to the log odds of "good"."""
    adds = {
        name: {v: math.log(g / b) for v, g, b in zip(VOTES, among_good, among_bad)}
        for name, (among_good, among_bad) in habits.items()
    }
    return math.log(share / (1 - share)), adds


def posterior(share: float, habits: Habits) -> Column:
    """The probability of "good" given the votes, independent within each class."""
    prior, adds = _log_odds(share, habits)
    odds = F.lit(prior)
    for name, of in adds.items():
        odds = odds + (
            F.when(F.col(name) == GOOD, of[GOOD]).when(F.col(name) == BAD, of[BAD]).otherwise(of[ABSTAIN]))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str]) -> tuple[float, Habits]:
    """The share of good documents and the rules' habits, from ``(votes, documents)``."""
    share, habits = START_SHARE, {n: BELIEF for n in names}
    for _ in range(ROUNDS):
        prior, adds = _log_odds(share, habits)
        # documents of each class, in all and by rule and vote
        total = [IMAGINED * START_SHARE, IMAGINED * (1 - START_SHARE)]
        cast = {n: [{v: IMAGINED * p for v, p in zip(VOTES, side)} for side in BELIEF] for n in names}
        for votes, n in patterns:
            odds = prior + sum(adds[name][v] for name, v in zip(names, votes))
            good = n / (1 + math.exp(-odds)) if odds > -700 else 0.0
            total[0] += good
            total[1] += n - good
            for name, v in zip(names, votes):
                cast[name][0][v] += good
                cast[name][1][v] += n - good
        new_share = total[0] / sum(total)
        new = {
            name: tuple(tuple(side[v] / sum(side.values()) for v in VOTES) for side in sides)
            for name, sides in cast.items()
        }
        moved = max([abs(new_share - share)] + [
            abs(x - y) for name in names for a, b in zip(new[name], habits[name]) for x, y in zip(a, b)])
        share, habits = new_share, new
        if moved < CLOSE:
            break
    return share, habits


# ---- the operator ---------------------------------------------------------


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures, ``base_failed``, ``quality`` (the posterior),
    ``kept`` and each rule's vote, per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    votes = rules()
    names = list(votes)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    voted = scratch.save(
        measured(docs).withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", *[v.cast("byte").alias(n) for n, v in votes.items()])
    )
    counted = voted.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n"))
    # at most 3 to the number of rules rows; in order, so that sums agree
    patterns = sorted((tuple(r[n] for n in names), r["n"]) for r in counted.collect())
    quality = posterior(*estimate(patterns, names))
    return voted.withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def quality_rules(docs: DataFrame) -> DataFrame:
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "quality")
