"""Learned quality rules: a decision list found by sequential covering.

Each text gets a few statistics.  From the labelled documents, rules for *bad* texts are grown one after
the other: the threshold test that raises the rule's gain most is added until none does, on one half of the labels; then the
last tests are pruned away as long as that doesn't worsen the rule on the other half.  Documents that a
rule covers are set aside and the next rule is grown on the rest.  Counts for all thresholds of all
statistics come from one aggregate per step, so learning reads all labels and holds a
fixed number of figures.  The result is an ordered list, applied as one conditional column.

Only DataFrame functions are used.  A null text counts as empty.  Without labels (or with one kind only) the list is
empty and only the base rule decides.  Rows without a matching label are not learned from;
contradicting labels of a document all count.  Ties go to the statistic and threshold that come first.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.common import settle, text_or_empty

#: words `[^\x20\x09-\x0D]+`
_BLANKS = r"[ \t-\r]+"
#: words of the windows searched for repetition
WINDOW = 8
#: candidate thresholds per statistic
CUTS = 24
#: at most so many rules, and tests in a rule
RULES, TESTS = 8, 3
#: a rule must be right for this share of what it covers, and cover this share of all labels
PRECISION, COVER = 0.9, 0.002

#: the learned statistics, from the columns of :func:`measure`
FEATURES = {
    "symbol_share": "n_symbols / greatest(n_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(n_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "log_words": "ln(1 + n_words)",
}


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every text."""
    text = text_or_empty("_t")
    split = (docs.select("doc_id", F.col("text").alias("_t"))
             .select("doc_id", text.alias("_t"), F.array_remove(F.split(text, _BLANKS), "").alias("_w"),
                     F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("_l")))
    size = F.size("_w")
    hashes = F.transform(F.when(size >= WINDOW, F.sequence(F.lit(1), size - WINDOW + 1)).otherwise(F.array().cast("array<int>")),
                         lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))
    removed = lambda marks: F.length("_t") - F.length(F.regexp_replace("_t", marks, ""))
    counts = split.select(
        "doc_id", size.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        removed("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.length("_t").alias("n_chars"), F.size("_l").alias("n_lines"), removed("[A-Z]+").alias("n_upper"),
        removed("[!?]+").alias("n_marks"), removed("[0-9]+").alias("n_digits"), F.size(F.array_distinct("_w")).alias("n_distinct"),
        hashes.alias("_h"))
    # most texts repeat no window: only the others are searched for the words that repeated ones cover
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    return (counts.withColumn("_p", F.when(repeats, _repeated("_h")))
            .withColumn("n_repeat_words", F.coalesce(F.aggregate(
                "_p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
                lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["reach"], i)).alias("n"), (i + WINDOW).alias("reach")),
                lambda a: a["n"]), F.lit(0)).cast("long"))
            .drop("_h", "_p"))


def _repeated(name: str) -> Column:
    """Sorted places of the values that are in the list more than once."""
    order = F.array_sort(F.transform(F.col(name), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # neighbours are compared through shifted copies of the sorted list
    shifted = lambda s: F.zip_with(
        s, F.zip_with(F.slice(F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s), 1, F.size(s)),
                      F.slice(F.concat(s, F.array(F.lit(None).cast("struct<h:bigint,i:int>"))), 2, F.size(s)),
                      lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b"))),
        lambda x, y: F.when(x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"]), x["i"]))
    bound = F.transform(F.array(order), lambda s: F.array_sort(F.array_compact(shifted(s))))
    return F.element_at(bound, 1)


class Test(NamedTuple):
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return (value > self.cut) if self.above else (value <= self.cut)


def covered(tests: list[Test]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def list_column(rules: list[list[Test]]) -> Column:
    """Number of the first rule that covers a row, from 1; 0 if none does."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        out = F.when(covered(rules[k - 1]), F.lit(k)).otherwise(out)
    return out


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """How much a test concentrates the bad rows (gain of information, weighed by the bad rows kept)."""
    if not bad or not bad0:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def learn(stats: DataFrame, labels: DataFrame) -> list[list[Test]]:
    """Rules for documents of quality 0, from :func:`measure` and ``labels`` (doc_id, quality)."""
    rows = settle(stats.join(labels.select("doc_id", F.col("quality").alias("_quality")).where("_quality is not null"), "doc_id")
                  .select((F.col("_quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("grow"),
                          *[F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()]))
    bad, good = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("bad"), ~F.col("bad")))
    spots = [(k + 0.5) / CUTS for k in range(CUTS)]
    first = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"),
                               *[F.percentile_approx(f, spots, 5000).alias(f) for f in FEATURES],
                               *[F.percentile_approx(F.when(F.col("bad"), F.col(f)), spots, 5000).alias(f"{f}_bad") for f in FEATURES]).first()
    total = first["n"]
    rules: list[list[Test]] = []
    if not total or first["bad"] in (0, total):
        return rules
    tests = [Test(f, above, cut) for f in FEATURES for cut in sorted({*first[f], *first[f"{f}_bad"]}) for above in (True, False)]
    as_test = lambda t: (F.col(t.feature) > t.cut) if t.above else (F.col(t.feature) <= t.cut)

    def within(rule):
        out = F.lit(True)
        for t in rule:
            out = out & as_test(t)
        return out
    rest = F.lit(True)
    while len(rules) < RULES:
        rule: list[Test] = []
        while len(rule) < TESTS:
            here = rows.where(rest & within(rule) & F.col("grow"))
            # one pass: rows of each kind below every threshold
            kinds = here.groupBy("bad").agg(F.count(F.lit(1)).alias("n"), *[
                F.sum(F.when(F.col(t.feature) <= t.cut, 1).otherwise(0)).alias(f"t{k}") for k, t in enumerate(tests) if not t.above]).collect()
            by = {r["bad"]: r for r in kinds}
            if True not in by:
                break
            bad0, good0 = by[True]["n"], by[False]["n"] if False in by else 0
            best, most = None, 0.0
            for k, t in enumerate(tests):
                below = k + 1 if t.above else k
                b, g = by[True][f"t{below}"], by[False][f"t{below}"] if False in by else 0
                b, g = (bad0 - b, good0 - g) if t.above else (b, g)
                gain = _gain(b, g, bad0, good0)
                if gain > most + 1e-9:
                    best, most = t, gain
            if best is None:
                break
            rule.append(best)
            if good0 == 0:
                break
        if not rule:
            break
        # prune: the shortest head of the rule that is no worse on the other half
        heads = [rule[:k] for k in range(1, len(rule) + 1)]
        held = rows.where(rest & ~F.col("grow")).agg(*[F.sum(F.when(within(h) & c, 1).otherwise(0)).alias(f"{n}{k}")
                                                      for k, h in enumerate(heads) for n, c in (("b", F.col("bad")), ("g", ~F.col("bad")))]).first()
        worth = [((held[f"b{k}"] or 0) - (held[f"g{k}"] or 0)) / max(1, (held[f"b{k}"] or 0) + (held[f"g{k}"] or 0)) for k in range(len(heads))]
        k = max(range(len(heads)), key=lambda k: (worth[k], -k))
        caught, wrong = held[f"b{k}"] or 0, held[f"g{k}"] or 0
        if caught + wrong == 0 or caught / (caught + wrong) < PRECISION or caught + wrong < COVER * total / 2:
            break
        rules.append(heads[k])
        rest = rest & ~within(heads[k])
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op1: counts, the base rule, the number of the learned rule that covers a document (0: none) and the verdict."""
    stats = settle(measure(docs))
    rule = list_column(learn(stats, labels))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (stats.withColumn("base_failed", failed).withColumn("rule", rule)
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule"))
