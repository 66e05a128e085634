"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditions.

Fixed base rules reject texts of under 10 words or with over 20 % of repeated words. What passes is
judged by an ordered list of threshold conjunctions that sequential covering learns from labels: a
rule grows, condition by condition, on two thirds of the labelled rows (FOIL gain), is pruned on
the rest, and is taken if it is right in ``precision`` of the cases there; then the rows that it
covers are set aside. The rules reject; what none covers is kept. The list becomes one CASE
expression over the statistics, so applying it is a projection.

Statistics cover all documents and whole texts. Labels are read from at most ``max_labelled`` rows
(those with the smallest hash of their id).

Nulls and empties: null text has no words and fails the base. Labels with a null id or label, and
documents without a label, teach nothing; without labels of both kinds there are no learned rules.
Several labels of a document count each. An empty table gives an empty result. Extra columns are
kept by ``keep_good`` and ignored by ``verdicts``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowhelm.llm.storage import bounded_sample
from rowhelm.llm.textstats import COUNTS, add_counts

MAX_LABELLED = 20_000
PRECISION = 0.9
MAX_RULES = 12
MAX_CONDITIONS = 4
#: Ratios that rules may test: name, numerator, denominator (counts).
RATIOS = [
    ("symbols_per_word", "n_symbols", "n_words"),
    ("chars_per_word", "word_chars", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
    ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"),
    ("marks_per_word", "n_marks", "n_words"),
    ("short_share", "n_short_words", "n_words"),
    ("distinct_share", "n_distinct_words", "n_words"),
]
FEATURES = ["n_words", *(name for name, _, _ in RATIOS)]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.limit) if self.above else value < F.lit(self.limit)

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, FEATURES.index(self.feature)]
        return value >= self.limit if self.above else value < self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.limit:g}"


def covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, limits: list[np.ndarray]) -> list[Condition]:
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[inside]).any():
        p0, all0 = bad[inside].sum(), inside.sum()
        best = (0.0, None)
        for k, name in enumerate(FEATURES):
            value = x[inside, k]
            at = np.searchsorted(limits[k], value, side="right")  # limits at or below the value
            n = np.bincount(at, minlength=len(limits[k]) + 1)
            p = np.bincount(at, bad[inside], minlength=len(limits[k]) + 1)
            low_n, low_p = np.cumsum(n)[:-1], np.cumsum(p)[:-1]
            for above, cn, cp in ((False, low_n, low_p), (True, all0 - low_n, p0 - low_p)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / cn) - np.log2(p0 / all0)), -1)
                j = int(np.argmax(gain)) if len(gain) else -1
                if j >= 0 and gain[j] > best[0] + 1e-9:
                    best = (gain[j], Condition(name, above, float(limits[k][j])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    def worth(part):
        inside = covers(part, x)
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth) if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION) -> list[list[Condition]]:
    """Ordered rules that reject, from statistics (columns ``FEATURES``) and labels."""
    rules: list[list[Condition]] = []
    order = np.argsort((np.arange(len(x)) * 7919) % 104729, kind="stable")
    x, bad = x[order], bad[order].astype(bool)
    test = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    while len(rules) < MAX_RULES and bad[left & ~test].sum() >= 5:
        own = left & ~test
        cuts = [np.unique(np.quantile(x[own, k], np.linspace(0.005, 0.995, 100))) for k in range(x.shape[1])]
        rule = _prune(_grow(x[own], bad[own], cuts), x[left & test], bad[left & test])
        if not rule:
            break
        hit = covers(rule, x) & left
        right, held = bad[hit].sum(), bad[hit & test]
        if hit.sum() < 5 or right < precision * hit.sum() or len(held) and held.mean() < precision:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def with_ratios(df: DataFrame) -> DataFrame:
    return df.select("*", *(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)).alias(name) for name, a, b in RATIOS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rejecting_rule(rules: list[list[Condition]]) -> Column:
    """Number (from 1) of the first rule that covers the row, or 0: one ordered CASE."""
    out = None
    for number, rule in enumerate(rules, 1):
        both = rule[0].column()
        for condition in rule[1:]:
            both = both & condition.column()
        out = F.when(both, F.lit(number)) if out is None else out.when(both, F.lit(number))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def statistics(docs: DataFrame, columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{c} long" for c in COUNTS)])
    return docs.select("text", *columns).mapInArrow(add_counts, schema)


def learn_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, precision: float = PRECISION) -> list[list[Condition]]:
    """Rules from at most ``max_labelled`` rows of labels (doc_id, quality); reads their documents."""
    known = labels.select("doc_id", "quality").dropna()
    sample = F.broadcast(bounded_sample(known, "doc_id", max_labelled))  # two numbers a row
    rows = with_ratios(statistics(docs.select("doc_id", "text").join(sample, "doc_id"), ["doc_id", "quality"]))
    rows = rows.filter(~base_failed()).select("doc_id", "quality", *FEATURES).toPandas().sort_values(["doc_id", "quality", "n_words"])
    return learn(rows[FEATURES].to_numpy(float), (rows["quality"] == 0).to_numpy(), precision)


def verdicts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, precision: float = PRECISION) -> DataFrame:
    """doc_id, the counts, base_failed, the rule that rejects (0: none) and kept. Learns when called."""
    rules = learn_rules(docs, labels, max_labelled, precision)
    judged = with_ratios(statistics(docs, ["doc_id"])).select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), rejecting_rule(rules).alias("rule")
    )
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, precision: float = PRECISION) -> DataFrame:
    """The documents, with their columns, that are kept: judged in the same pass that carries them."""
    rules = learn_rules(docs, labels, max_labelled, precision)
    own = {c: f"_kept_{k}" for k, c in enumerate(docs.columns)}  # no clash with the counts' names
    carried = docs.select(F.col("text"), *(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in own.items()))
    judged = with_ratios(statistics(carried, list(own.values())))
    return judged.filter(~base_failed() & (rejecting_rule(rules) == 0)).select(*(F.col(n).alias(c) for c, n in own.items()))
