"""Quality rules: text statistics and a learned decision list, in DataFrame functions only.

The list is learned by sequential covering. From the labelled rows not yet covered, a rule grows
one threshold condition at a time, each the one with the highest gain of information for the
rejected class; it is then pruned from its end on rows that growing did not see, and kept while
it stays precise there. Every step is one aggregation of counts by feature and threshold; the
driver sees these counts only. The result is an ordered chain of `when` expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, words_column, written

SYMBOLS = "#*$%&|<>"

#: Ratios that rules may test, over the columns of `text_statistics`.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and counts
    of capitals, digits and exclamation or question marks; a null text counts as empty.

    n_repeat_words is the number of words inside 3-word windows that occur twice or more: window
    hashes are sorted with their places, places of equal neighbours are the repeated windows, and
    the union of these windows' spans is summed from the gaps between them. All of it is per row,
    without a shuffle, in n log n of the row's words.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(whole, WHITE, "")
    symbols = F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.trim(F.translate(x, WHITE, " " * len(WHITE))) != "")

    def count(pattern: str) -> Column:
        return F.length("_bare") - F.length(F.regexp_replace("_bare", pattern, ""))

    step = docs.withColumns({"_words": F.transform(words_column(F.col(text)), lambda w: F.xxhash64(w)), "_lines": lines, "_bare": bare})
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length("_bare").cast("long"),
            "n_symbols": symbols.cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_upper": count("[A-Z]+").cast("long"),
            "n_digits": count("[0-9]+").cast("long"),
            "n_marks": count("[!?]+").cast("long"),
        }
    )
    windows = F.expr(
        "CASE WHEN size(_words) >= 3 THEN transform(sequence(0, size(_words) - 3),"
        " i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) ELSE array() END"
    )
    step = step.withColumn("_win", windows)
    # windows of texts without a repeat need no sort
    placed = F.expr("CASE WHEN size(array_distinct(_win)) = size(_win) THEN array() ELSE sort_array(transform(_win, (h, i) -> struct(h, i))) END")
    step = step.withColumn("_placed", placed)
    again = F.expr(
        "sort_array(transform(filter(transform(_placed, (x, k) -> struct(x.i AS i,"
        " coalesce(get(_placed, k - 1).h = x.h, false) OR coalesce(get(_placed, k + 1).h = x.h, false) AS r)), x -> x.r), x -> x.i))"
    )
    step = step.withColumn("_again", again)
    spans = F.expr("aggregate(transform(_again, (p, k) -> if(k = 0, 3, least(3, p - get(_again, k - 1)))), 0L, (s, x) -> s + x)")
    return step.withColumn("n_repeat_words", spans).drop("_words", "_lines", "_bare", "_win", "_placed", "_again")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _thresholds(rows: DataFrame, n_cuts: int) -> dict[str, list[float]]:
    """Quantiles of each ratio over all rows and over the rejected ones: rare junk needs cuts of its own."""
    values = rows.select("bad", *(F.expr(e).alias(k) for k, e in FEATURES.items()))
    probes = [i / n_cuts for i in range(n_cuts + 1)]
    q = [F.percentile_approx(k, probes, 10000).alias(k) for k in FEATURES]
    every, junk = values.agg(*q).first(), values.where("bad = 1").agg(*q).first()
    return {k: sorted({float(x) for x in (every[k] or []) + (junk[k] or [])}) for k in FEATURES}


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> Rule:
    """Conditions by gain of information, until only rejected rows are covered or `most` are set."""
    rule: Rule = ()
    while len(rule) < most:
        here = rows.where(_holds(rule))
        # place of each value among its feature's cuts: counts by place give every threshold at once
        places = [
            F.struct(F.lit(k).alias("feature"), F.expr("size(filter(array({}), c -> c <= {}))".format(",".join(f"{c!r}D" for c in cuts[k]), e)).alias("place"))
            for k, e in FEATURES.items()
            if cuts[k]
        ]
        if not places:
            return rule
        counts = here.select("bad", F.explode(F.array(*places)).alias("x")).groupBy("x.feature", "x.place").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        p0 = sum(r["p"] for r in counts if r["feature"] == counts[0]["feature"]) if counts else 0
        n0 = sum(r["n"] for r in counts if r["feature"] == counts[0]["feature"]) if counts else 0
        if p0 == 0 or n0 == 0:
            return rule
        before = math.log2(p0 / (p0 + n0))
        best: tuple[float, Condition] | None = None
        for feature in sorted({r["feature"] for r in counts}):
            own = [r for r in counts if r["feature"] == feature]
            for at, cut in enumerate(cuts[feature], 1):
                for above in (True, False):
                    p = sum(r["p"] for r in own if (r["place"] >= at) == above)
                    n = sum(r["n"] for r in own if (r["place"] >= at) == above)
                    if p >= 5:
                        gain = p * (math.log2(p / (p + n)) - before)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = gain, Condition(feature, above, cut)
        if best is None:
            return rule
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The beginning of the rule that is best on unseen rows, with its rejected and clean rows there."""
    heads = [rule[:k] for k in range(len(rule), 0, -1)]
    sums = [F.sum(F.when(_holds(h), F.col("bad")).otherwise(0)).alias(f"p{i}") for i, h in enumerate(heads)]
    sums += [F.sum(F.when(_holds(h), 1 - F.col("bad")).otherwise(0)).alias(f"n{i}") for i, h in enumerate(heads)]
    got = rows.agg(*sums).first()
    scored = [((got[f"p{i}"] or 0), (got[f"n{i}"] or 0), h) for i, h in enumerate(heads)]
    p, n, head = max(scored, key=lambda x: ((x[0] + 1) / (x[0] + x[1] + 2), x[0], len(x[2])))
    return head, p, n


def learn_rules(rows: DataFrame, *, n_cuts: int = 24, most_rules: int = 8, most_conditions: int = 3, precision: float = 0.97) -> list[Rule]:
    """Ordered rejecting rules from rows with the statistics' columns, id and bad (0 or 1).

    Two thirds of the rows, by a hash of the id, grow rules; the others prune them. Learning ends
    when a pruned rule's precision on the latter falls below `precision`, or it covers none. No
    rows, or rows of one class, give no rules.
    """
    rows = rows.withColumn("grows", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) > 0)
    cuts = _thresholds(rows, n_cuts)
    rules: list[Rule] = []
    left = rows
    for _ in range(most_rules):
        rule = _grow(left.where("grows"), cuts, most_conditions)
        if not rule:
            break
        rule, p, n = _prune(left.where("not grows"), rule)
        if p == 0 or p / (p + n) < precision:
            break
        rules.append(rule)
        left = left.where(~_holds(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects the row, null where none does."""
    chain: Column | None = None
    for i, rule in enumerate(rules):
        chain = F.when(_holds(rule), i) if chain is None else chain.when(_holds(rule), i)
    return F.lit(None).cast("int") if chain is None else chain.cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """At most `most` labelled documents by the least hashes of their ids, with statistics and bad."""
    rated = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    return text_statistics(texts).withColumn("bad", (F.col("quality") == 0).cast("int")).drop("text", "quality")


def quality_rules(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 20000) -> tuple[DataFrame, list[Rule]]:
    """docs with the statistics, base_failed, rule and kept; and the learned list.

    The list is fitted on `most_labelled` labelled rows at most that the base rules let pass (the
    documented bound), everything else is computed for every row. Null and empty texts fail the
    base rules (no words). Repeated rows get a row each; extra columns stay, but for those named as
    a statistic or a verdict, which are overwritten. With an empty label table the list is empty and
    only the base rules reject.
    """
    # written before it is filtered: a filter pushed below would compute the statistics anew
    rows = written(labelled_sample(docs, labels, most_labelled))
    rules = learn_rules(rows.where(~base_failed()))
    judged = text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
