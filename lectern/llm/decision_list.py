"""Quality rules: statistics of whole texts, and decision lists learned from labels; DataFrame functions only.

Sequential covering: a rule is a conjunction of thresholds. It grows on two thirds of the labelled
sample by the best information gain, is pruned on the other third, and is kept while it is precise there; what
it covers is removed, and the next rule begins. The ordered rules become one CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import least_hashed, unit_hash

SPACE = r"[\x20\x09-\x0D]+"
#: Labelled documents that are learned from, at most, by least hashed id.
SAMPLE = 8000
MAX_RULES, MAX_TERMS = 12, 4
PRECISION = 0.9

STATISTICS = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "words_a_line")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


#: More low bits of a window's hash that its place takes, besides those it needs (for tests of collisions).
EXTRA_BITS = 0


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that the array has twice or more, the first ones included.

    Each window becomes a 64-bit word: the low bits its place, the others of its hash. Sorted, equal
    windows are neighbours, and so may be a few others; the windows that have such a neighbour are sorted by their
    words, and only those with equal words count. Their places, sorted again, cover up to three words each. O(n log n).
    """
    def alike(w):
        """Places of windows whose hash, as far as it is kept, another one has."""
        n = F.size(w)

        def found(bits):
            mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1
            key = lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("bigint"))

            def repeats(s):
                head = lambda v: F.call_function("shiftrightunsigned", v, bits)
                same = lambda v, j: F.coalesce(head(F.get(s, j)) == head(v), F.lit(False))
                return F.transform(F.filter(s, lambda v, j: same(v, j - 1) | same(v, j + 1)), lambda v: v.bitwiseAND(mask).cast("int"))

            return _let(F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key)), repeats)

        return F.when(n >= 4, _let(F.length(F.bin(n.cast("bigint"))) + EXTRA_BITS, found)).otherwise(F.array().cast("array<int>"))

    def equal(w, places):
        def repeats(s):
            same = lambda v, j: F.coalesce((F.get(s, j)["a"] == v["a"]) & (F.get(s, j)["b"] == v["b"]) & (F.get(s, j)["c"] == v["c"]), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda v, j: same(v, j - 1) | same(v, j + 1)), lambda v: v["p"]))

        window = lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p"))
        return _let(F.sort_array(F.transform(places, window)), repeats)

    def covered(p):
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, b: a + b)

    return _let(words, lambda w: _let(alike(w), lambda p: F.when(F.size(p) > 0, _let(equal(w, p), covered)).otherwise(F.lit(0).cast("bigint"))))


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a struct ``stats`` of base counts and of ``STATISTICS`` (in place of a column ``stats`` of its own).

    Null texts count as empty; shares of nothing are 0. Repeated rows stay; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gone = lambda t, kind: F.length(t) - F.length(F.regexp_replace(t, f"[{kind}]+", ""))

    def of(b):
        w, t, lines = b["words"], b["text"], b["lines"]
        n, n_lines = F.size(w).cast("bigint"), F.size(lines).cast("bigint")
        return F.struct(
            n.alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), gone(t, "#*$%&|<>").cast("bigint").alias("n_symbols"),
            (n_lines - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"),
            gone(t, "A-Z").alias("upper"), gone(t, "!?").alias("marks"), gone(t, "0-9").alias("digits"),
            F.size(F.array_distinct(w)).alias("distinct"), n_lines.alias("lines"),
        )

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = _let(F.struct(text.alias("text"), words.alias("words"), lines.alias("lines")), of)

    def shares(c):
        part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0).cast("double")
        n = c["n_words"]
        return F.struct(
            *(c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            part(c["word_chars"], n).alias("mean_word"), part(c["n_symbols"], n).alias("symbol_share"), part(c["n_dup_lines"], c["lines"]).alias("dup_line_share"),
            part(c["n_repeat_words"], n).alias("repeat_share"), part(c["upper"], c["word_chars"]).alias("upper_share"), part(c["marks"], n).alias("mark_share"),
            part(c["digits"], c["word_chars"]).alias("digit_share"), part(c["distinct"], n).alias("distinct_share"), part(n, c["lines"]).alias("words_a_line"),
        )

    return df.withColumn("stats", _let(base, shares))


@dataclass(frozen=True)
class Term:
    statistic: str
    above: bool
    cut: float


@dataclass
class DecisionList:
    """Rules that reject, in order; what none covers is kept."""

    rules: list[list[Term]]

    def verdict(self, value) -> Column:
        """True where the document is kept. ``value`` gives the column of a statistic."""
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for t in rule:
                test = test & ((value(t.statistic) > F.lit(t.cut)) if t.above else (value(t.statistic) <= F.lit(t.cut)))
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)


def _covers(x: np.ndarray, rule: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= x[:, f] > cut if above else x[:, f] <= cut
    return out


def learn(x: np.ndarray, bad: np.ndarray, names=STATISTICS, max_rules: int = MAX_RULES, max_terms: int = MAX_TERMS, precision: float = PRECISION) -> DecisionList:
    """Rules for ``bad`` rows. With no row, no bad row, or none that can be told apart, the list is empty.

    Of cuts and statistics of equal gain the first wins. ``x`` has no nulls (``statistics`` gives none).
    """
    rules = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        if (grow & bad).sum() < 5:
            break
        rule: list[tuple[int, bool, float]] = []
        inside = grow.copy()
        while len(rule) < max_terms and (inside & ~bad).any():
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            before, best = math.log2(p / (p + n)), (1e-9, None)
            for f in range(x.shape[1]):
                v = x[inside, f]
                for cut in np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, 33)), np.quantile(x[inside & bad, f], [0, 1]), np.quantile(x[inside & ~bad, f], [0, 1])])):
                    for above in (True, False):
                        hit = v > cut if above else v <= cut
                        p1 = (hit & bad[inside]).sum()
                        if p1 >= 3:
                            gain = p1 * (math.log2(p1 / hit.sum()) - before)
                            if gain > best[0]:
                                best = (gain, (f, above, float(cut)))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= _covers(x, rule[-1:])

        def worth(r):
            c = _covers(x, r) & prune
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=worth, default=[])
        covered = _covers(x, rule) & left if rule else np.zeros(len(x), bool)
        held = covered & prune
        if not rule or not held.any() or (held & bad).sum() < precision * held.sum():
            break
        rules.append([Term(names[f], above, cut) for f, above, cut in rule])
        left &= ~covered
    return DecisionList(rules)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DecisionList:
    """Learn from ``sample`` documents with a quality label (1 good, 0 bad), by least hashed id.

    An id with several labels is bad if any says so; of several texts of an id the least counts, so repeated rows do not
    add to the sample. Null ids and labels are no examples.
    """
    known = labels.where(F.col("quality").isNotNull()).select(F.col(id_col).alias("id"), F.col("quality").alias("q"))
    picked = least_hashed(known.where("id is not null").groupBy("id").agg(F.min("q").alias("q")), unit_hash("id"), sample, "id")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = rows.groupBy("id", "q").agg(F.min("text").alias("text"))
    got = statistics(rows).select("id", "q", *(F.col(f"stats.{s}").cast("double").alias(s) for s in STATISTICS)).orderBy(F.xxhash64("id"), "id").collect()
    if not got:
        return DecisionList([])
    return learn(np.array([[r[s] for s in STATISTICS] for r in got]), np.array([r.q == 0 for r in got]))


def judge(df: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row; other columns are ignored.

    A null or blank text has no words and fails the base rules. Equal texts are judged alike, repeated rows stay, and an
    empty table gives an empty result.
    """
    rows = statistics(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", "stats")
    s = lambda name: F.col(f"stats.{name}")
    failed = (s("n_words") < 50) | (100 * s("n_repeat_words") > 50 * s("n_words"))
    return rows.select(F.col("id").alias(id_col), *(s(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), (~failed & rules.verdict(s)).alias("kept"))
