"""Operator 11 [native]: quality rules whose cutoffs come with a bound on false rejections.

Every document gets whole-text counts from DataFrame functions alone: words, their
characters, symbols, repeated lines, and words in three-word windows that occur again.
A fixed base rule drops what is short or mostly repeats itself. Beyond it, each rule of
RULES rejects a document whose rate is at or past a cutoff, and the cutoffs are chosen
for each stratum (the document's language) from labelled documents:

* Labelled documents are halved by a hash of their id. One half, for tuning, says what a
  cutoff gains: of the documents that no earlier rule rejects, the share of bad ones that it
  rejects less COST times the share of good ones. The other half, held out, says what it risks.
* A rule's cutoffs are tested from the mildest to the strictest, each by the exact binomial
  tail: if k of n held-out good documents are rejected, "more than ``limit`` of good
  documents are rejected" is refused where P(Binomial(n, limit) <= k) is at most the
  level. That is the Clopper-Pearson bound: the upper bound of the rate is then below the limit.
  Testing ends with the first cutoff that isn't passed, so the tests of one rule need no
  correction; the rules of all strata share ``delta`` evenly (Bonferroni).
* Of the cutoffs that passed, the one of the largest gain is taken, the mildest of equal ones;
  none where no gain is above 0 or nothing passed.

So with a probability of 1 - DELTA at least, in no stratum more than LIMIT of the good
documents that the base rule keeps are rejected (each rule may take LIMIT / len(RULES)).
A stratum with too few labels passes no test and loses no document to the rules.

Window hashes are 64-bit. Counts are written once as a table of numbers; the labelled rows
and the verdicts are both read from it. The table of cutoffs has a row for each stratum: up
to BROADCAST_STRATA of them are broadcast, more are joined by shuffling rows of numbers.

Defined results: null and empty texts have no words and fail the base rule; very long texts
are counted whole; repeated rows are counted and judged each; a null language is a stratum of its
own, together with the empty one; null labels and labels of ids that don't occur are ignored,
of contradicting labels the worse one counts; an empty table gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, read

#: At most this share of a stratum's good documents is rejected, but for a chance of DELTA over all strata.
LIMIT, DELTA = 0.05, 0.05
#: A share of the good documents that is lost weighs as much as so many times that share of the bad ones.
COST = 20
#: Strata whose cutoffs are broadcast: a few hundred bytes each.
BROADCAST_STRATA = 10_000
WORD, SYMBOL = r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
_SHARES = (1000, 800, 640, 500, 400, 320, 250, 200, 160, 125, 100, 80, 64, 50, 40, 32, 25, 20, 16, 12, 10, 8, 6, 5, 4, 3, 2, 1)
#: rule -> (numerator, denominator, scale, cutoffs from the mildest to the strictest); descending
#: cutoffs reject rates at or above them, ascending ones rates at or below them.
RULES: dict[str, tuple[str, str, int, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "word_chars", 1000, _SHARES),
    "repeated_lines": ("n_dup_lines", "n_lines", 1000, _SHARES),
    "repeated_words": ("n_repeat_words", "n_words", 1000, _SHARES),
    "long_words": ("word_chars", "n_words", 100, tuple(range(3000, 450, -50))),
    "short_words": ("word_chars", "n_words", 100, tuple(range(100, 500, 10))),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words of the array that lie in three-word windows found twice or more in it, the first included."""

    def places(s: Column) -> Column:
        # s: (hash, place) in order; equal hashes are neighbours
        hash_at = lambda i: F.get(s, i)["h"]
        again = F.filter(s, lambda x, i: F.coalesce(x["h"] == hash_at(i - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(i + 1), F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(p, start, step, lambda a: a["n"])

    def of_hashes(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(_bound(F.sort_array(placed), places)))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_bound(hashes, of_hashes))

    return _bound(words, of)


def measured(docs: DataFrame, *keys: Column) -> DataFrame:
    """The keys and the counts of each document's whole text: BASE, ``n_lines`` and ``base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    of_words = _bound(
        F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")
        ),
    )
    of_lines = _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols")
    counts = docs.select(*keys, of_words.alias("__words"), of_lines.alias("__lines"), symbols).select("*", "__words.*", "__lines.*").drop("__words", "__lines")
    return counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def level(rule: str) -> Column:
    """Number of the rule's mildest cutoff that rejects the document; as many as there are cutoffs where none does."""
    part, whole, scale, cutoffs = RULES[rule]
    rate = F.when(F.col(whole) > 0, F.floor(F.lit(scale) * F.col(part) / F.col(whole)))
    passes = (lambda c: rate < c) if cutoffs[0] > cutoffs[-1] else (lambda c: rate > c)
    return F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: F.coalesce(passes(c), F.lit(True))))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k < n * p, by the largest term and the ratios below it; 1 for larger k, where it is no test."""
    odds = (1 - p) / p
    logs = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))
    largest = logs + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(a: Column, i: Column) -> Column:
        j = k - i  # from the term of j + 1 to that of j
        term = a["term"] * (j + 1) / (n - j) * F.lit(odds)
        return F.struct((a["sum"] + term).alias("sum"), term.alias("term"))

    below = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k < n * p, F.exp(largest) * F.aggregate(below, start, step, lambda a: a["sum"])).otherwise(1.0)


def cutoff(labelled: DataFrame, rule: str, risk: float, level_of_test: Column) -> DataFrame:
    """The rule's cutoff in each stratum, where one is certified and gains: (stratum, level, n_good, n_rejected, p_value, gain).

    labelled: ``stratum``, ``good``, ``held_out``, ``caught`` (an earlier rule rejects it) and
    the counts of measured(). Documents meet in counts by stratum and level, which are
    combined before the shuffle. What earlier rules catch adds nothing to the gain; the risk
    is that of the rule alone.
    """
    one = lambda cond: F.count(F.when(cond, 1))
    good, held, fresh_ = F.col("good"), F.col("held_out"), ~F.col("caught")
    counts = labelled.select("stratum", "good", "held_out", "caught", level(rule).alias("level")).groupBy("stratum", "level").agg(
        one(good & held).alias("good_held"), one(good & ~held & fresh_).alias("good_tune"), one(~good & ~held & fresh_).alias("bad_tune")
    )
    each = Window.partitionBy("stratum")  # at most as many rows as a rule has cutoffs, and one
    upto = each.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.select(
        "stratum", "level",
        F.sum("good_held").over(upto).alias("n_rejected"), F.sum("good_held").over(each).alias("n_good"),
        (F.sum("bad_tune").over(upto) * F.sum("good_tune").over(each) - COST * F.sum("good_tune").over(upto) * F.sum("bad_tune").over(each)).alias("gain"),
    )
    tested = sums.where(F.col("level") < len(RULES[rule][3])).withColumn("p_value", binomial_tail(F.col("n_rejected"), F.col("n_good"), risk))
    tested = tested.withColumn("passed", F.min(F.col("p_value") <= level_of_test).over(upto))
    best = tested.where("passed AND gain > 0").groupBy("stratum")
    return best.agg(F.max_by(F.struct("level", "n_good", "n_rejected", "p_value", "gain"), F.struct("gain", -F.col("level"))).alias("best")).select("stratum", "best.*")


def certified(labelled: DataFrame, limit: float = LIMIT, delta: float = DELTA, rules: tuple[str, ...] = tuple(RULES)) -> dict[str, DataFrame]:
    """rule -> its cutoffs by stratum; each a written table, marked for broadcasting if it is small."""
    scratch = Scratch(labelled.sparkSession, "quality")
    rows = scratch.write(labelled.select("stratum", "good", "held_out", *BASE, "n_lines"), "labelled")
    tests = max(1, rows.select("stratum").distinct().count()) * len(rules)
    out, rows = {}, rows.withColumn("caught", F.lit(False))
    for rule in rules:
        table, n = scratch.counted(cutoff(rows, rule, limit / len(rules), F.lit(delta / tests)), rule)
        out[rule] = F.broadcast(table) if n <= BROADCAST_STRATA else table
        rows = rejecting(rows, rule, out[rule])
    return out


def rejecting(rows: DataFrame, rule: str, chosen: DataFrame) -> DataFrame:
    """rows, with ``caught`` true also where the rule's cutoff in the row's stratum rejects it."""
    limits = chosen.select("stratum", F.col("level").alias("__level"))
    hit = F.coalesce(level(rule) <= F.col("__level"), F.lit(False))
    return rows.join(limits, "stratum", "left").withColumn("caught", F.col("caught") | hit).drop("__level")


def verdicts(counts: DataFrame, chosen: dict[str, DataFrame]) -> DataFrame:
    """counts with ``kept``: not failed by the base rule, nor rejected by a cutoff of its stratum."""
    rows = counts.withColumn("caught", F.lit(False))
    for rule, limits in chosen.items():
        rows = rejecting(rows, rule, limits)
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("caught")).drop("caught")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", label: str = "quality") -> DataFrame:
    """For each document: its key, BASE, ``base_failed`` and ``kept``."""
    name = fresh([*BASE, "n_lines", "base_failed", "kept", "caught", "stratum", "good", "held_out"], key)
    keys = (F.col(key).alias(name), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    counts = Scratch(docs.sparkSession, "quality").write(measured(docs, *keys), "counts")
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias(name)).agg((F.min(label) > 0).alias("good"))
    digit = F.substring(F.md5(F.encode(F.col(name).cast("string"), "UTF-8")), 1, 1)
    labelled = counts.where("NOT base_failed").join(marks, name).withColumn("held_out", digit.isin(*"02468ace"))
    out = verdicts(counts, certified(labelled)).select(name, *BASE, "base_failed", "kept")
    return out.withColumnRenamed(name, key)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
