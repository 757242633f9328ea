"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a domain-language-source tree hold documents. A budget of tokens goes down the tree by
weights. A node cannot give more than its supply (tokens of its documents times ``max_epochs``);
what it cannot give goes to its siblings by their weights, and only what all siblings together
cannot give goes up to the siblings of the parent. Each leaf then takes a prefix of its seeded
epochs: every epoch has its own order, by a seeded hash of the id, and the prefix is the documents
that begin before the leaf's budget is used up.

The plan of budgets is a table of one row for each leaf. The prefix needs no sort of a leaf: the order is a
hash of 60 bits, and the place where a budget ends is found by its digits to the base 1024, the sums of which
are pre-aggregated. Rows that no digit tells apart (equal id and equal text) are cut inside the tie.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kernels
from .common import Scratch, given
from .tokens import encoder

#: Bits of the order, and of a digit of it.
ORDER_BITS, DIGIT = 60, 10
#: Nodes of the tree that the plan holds on the driver, at most; more raise an error.
MAX_LEAVES = 100_000
LEAF = ["d", "l", "s"]

Weights = Mapping[tuple, float] | Callable[[Mapping[tuple, float]], tuple[Mapping[tuple, float], float]]


def water_fill(budget: float, weights: Mapping, supplies: Mapping) -> dict:
    """Give ``budget`` to children by weight, none more than its supply; shortages go to the others by weight.

    Children of no weight get something only after all others are full.
    """
    given = dict.fromkeys(weights, 0.0)
    for open_ in ([k for k in weights if weights[k] > 0], [k for k in weights if not weights[k] > 0]):
        left = min(budget, sum(supplies.values())) - sum(given.values())
        while open_ and left > 1e-9:
            total = sum(max(weights[k], 0) for k in open_) or None
            share = {k: left * (weights[k] / total if total else 1 / len(open_)) for k in open_}
            full = [k for k in open_ if share[k] >= supplies[k]]
            if not full:
                given.update(share)
                break
            for k in full:
                given[k] = supplies[k]
                left -= supplies[k]
            open_ = [k for k in open_ if k not in full]
    return given


def budget_tree(leaves: Mapping[tuple, float], weights: Mapping[tuple, float], budget: float) -> dict[tuple, float]:
    """The budget of each leaf (path -> tokens). ``leaves`` has the supply of each path, ``weights`` the weight of
    any path prefix; a path without a weight has its supply as weight, scaled to the supplies of its siblings."""
    def go(prefix: tuple, amount: float, paths: list[tuple]) -> dict[tuple, float]:
        if paths == [prefix]:
            return {prefix: amount}
        children: dict[tuple, list[tuple]] = {}
        for p in paths:
            children.setdefault(p[: len(prefix) + 1], []).append(p)
        supplies = {c: sum(leaves[p] for p in ps) for c, ps in children.items()}
        total = sum(supplies.values()) or 1.0
        shares = {c: weights.get(c, supplies[c] / total) for c in children}
        out: dict[tuple, float] = {}
        for c, amount_c in water_fill(amount, shares, supplies).items():
            out |= go(c, amount_c, children[c])
        return out

    return go((), budget, sorted(leaves, key=str)) if leaves else {}


def _order(epoch) -> Column:
    """The place of a row in an epoch's seeded order, of ``ORDER_BITS`` bits."""
    return F.shiftrightunsigned(F.xxhash64("h", epoch), 64 - ORDER_BITS)


def _keyed(df: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str, seed: int) -> list[Column]:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = [text(domain), text(F.col(lang_col)), text(F.col(source_col))]
    return [*(k.alias(n) for k, n in zip(keys, LEAF)), F.xxhash64(F.col(id_col).cast("string"), text(F.col(text_col)), F.lit(seed)).alias("h")]


def _counts(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            counts = [np.diff(offsets) for _, offsets in enc.batches(batch.column(batch.num_columns - 1))]
            n = np.maximum(np.concatenate(counts) if counts else np.zeros(0, np.int64), 1)
            yield pa.record_batch([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n"])

    return run


def token_rows(df: DataFrame, path: str, domain: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", seed: int = 17) -> DataFrame:
    """(id, d, l, s, h, n) of every row: the leaf, the seed of its order, and its tokens (1 at least), without its text."""
    rows = df.select(F.col(id_col).alias("id"), *_keyed(df, domain, id_col, text_col, lang_col, source_col, seed), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernels.tidy(_counts(path), keep=True), f"id {dict(rows.dtypes)['id']}, d string, l string, s string, h long, n long")


def _cuts(light: DataFrame, wanted: dict[tuple, tuple[int, float]], order: Callable[[Column], Column]) -> dict[tuple, tuple[int, int, int]]:
    """For each leaf with a rest: (cut, rows taken of those at the cut, rows at the cut); all rows of a lower order are taken.

    ``wanted`` has (epoch, rest) of leaves. A round finds one digit of the place where the rest ends, over the rows of the
    digits found before; a leaf is done when one order is left.
    """
    spark = light.sparkSession
    state = {leaf: (0, 0, 0.0) for leaf, (_, rest) in wanted.items() if rest > 0}  # digits found, their value, tokens before
    done: dict[tuple, tuple[int, int, int]] = {}
    while state:
        rows = [(*leaf, wanted[leaf][0], wanted[leaf][1], ORDER_BITS - DIGIT * k, value, before) for leaf, (k, value, before) in state.items()]
        table = given(spark, rows, "d string, l string, s string, epoch int, rest double, shift int, value long, before double")
        own = light.join(F.broadcast(table), LEAF).withColumn("o", order(F.col("epoch")))
        right = lambda by: F.call_function("shiftright", F.col("o"), by)
        # At the first digit the shift is 60, so that all rows have the value 0.
        own = own.where(right(F.col("shift")) == F.col("value"))
        parts = own.groupBy(*LEAF, "rest", "before", right(F.col("shift") - DIGIT).alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("o").alias("a"), F.max("o").alias("z"))
        until = Window.partitionBy(*LEAF).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(until), F.lit(0)))
        at = Window.partitionBy(*LEAF).orderBy(F.desc("part"))
        ends = parts.where("start < rest").withColumn("k", F.row_number().over(at)).where("k = 1")
        for r in ends.collect():  # one for each leaf
            leaf = (r.d, r.l, r.s)
            if r.a == r.z:
                done[leaf] = (r.a, min(r.rows, int(-((r.start - r.rest) // (r.n / r.rows)))), r.rows)
                del state[leaf]
            else:
                state[leaf] = (state[leaf][0] + 1, r.part, r.start)
    return done


def _planned(light: DataFrame, weights: Weights, budget: float | None, factor: float, max_epochs: int) -> dict[tuple, tuple[int, float]]:
    """(whole epochs, tokens of the next one) of each leaf with supply."""
    rows = light.groupBy(*LEAF).agg(F.sum("n").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    leaves = {(r.d, r.l, r.s): float(r.n) for r in rows}
    if callable(weights):
        weights, budget = weights(leaves)
    want = float(sum(leaves.values()) * factor if budget is None else budget)
    plan = budget_tree({k: v * max_epochs for k, v in leaves.items()}, weights, want)
    out = {}
    for k, b in plan.items():
        whole = int((b + 1e-6) // leaves[k])
        out[k] = (whole, max(0.0, b - whole * leaves[k]) if whole < max_epochs else 0.0)
        if out[k][1] < 1e-6:
            out[k] = (whole, 0.0)
    return out


def select(rows: DataFrame, light: DataFrame, weights: Weights, budget: float | None = None, factor: float = 1.0, max_epochs: int = 4) -> DataFrame:
    """``rows`` (with d, l, s, h and any more columns) once for each epoch that selects them, with ``epoch`` and ``order``.

    ``light`` has d, l, s, h and the tokens n of the same rows. A leaf's budget may be passed by the document in which it
    ends, by no more.
    """
    spark = rows.sparkSession
    wanted = _planned(light, weights, budget, factor, max_epochs)
    cuts = _cuts(light, wanted, _order)
    table = [(*k, whole, *(cuts[k] if k in cuts else (-1, 0, 0))) for k, (whole, _) in wanted.items()]
    table = given(spark, table, "d string, l string, s string, whole int, cut long, taken long, tied long")
    own = rows.join(F.broadcast(table), LEAF).withColumn("_o", _order(F.col("whole")))
    at_cut, some = F.col("_o") == F.col("cut"), F.col("taken") < F.col("tied")
    extra = (F.col("_o") < F.col("cut")) | (at_cut & ~some)
    if any(0 < taken < tied for _, taken, tied in cuts.values()):
        # Equal rows, of which some are taken: they are written, so that each has a number that stays, and cut by that.
        tie = Scratch(spark, "tie").stage(own.where(at_cut & some).withColumn("_number", F.monotonically_increasing_id()), "tied")
        number = lambda _: F.shiftrightunsigned(F.xxhash64("_number"), 64 - ORDER_BITS)
        inner = _cuts(tie.select(*LEAF, "_number", F.lit(1).alias("n")), {k: (0, float(taken)) for k, (_, taken, tied) in cuts.items() if 0 < taken < tied}, number)
        limits = given(spark, [(*k, cut) for k, (cut, _, _) in inner.items()], "d string, l string, s string, _last long")
        tie = tie.join(F.broadcast(limits), LEAF).withColumn("_extra", number(None) <= F.col("_last")).drop("_number", "_last")
        own = own.where(~(at_cut & some)).withColumn("_extra", extra).unionByName(tie)
    else:
        own = own.withColumn("_extra", extra)
    times = F.col("whole") + F.col("_extra").cast("int")
    own = own.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    return own.withColumn("order", _order(F.col("epoch"))).select(*rows.columns, "epoch", "order")


def mix(df: DataFrame, path: str, weights: Weights, budget: float | None = None, *, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", factor: float = 1.0, max_epochs: int = 4, seed: int = 17) -> DataFrame:
    """Documents selected for the target weights, with (domain, lang, source, epoch, order) in a struct ``mix``.

    A row comes once for each epoch that selects it, beside all its columns (a column ``mix`` of its own
    is replaced). Tokens are those of the tokenizer at ``path``, and at least 1 for each row; ``order`` is the place in the epoch's
    seeded order. ``domain`` names the tree's first level for each row. ``budget`` is a number of tokens, or None for
    ``factor`` times those of all rows; ``weights`` may be a function of the leaves' tokens that gives both. Null domain,
    language, source or text count as '' (a leaf of their own and an empty text). Rows of one id (null
    ids too) are ordered by their texts; of rows equal in both as many are taken as the budget has room for.
    An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    names = dict(id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, seed=seed)
    light = scratch.stage(token_rows(df, path, domain, **names).drop("id"), "light")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *_keyed(df, domain, **names))
    out = select(rows, light, weights, budget, factor, max_epochs)
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns if c != "mix"), F.struct(F.col("d").alias("domain"), F.col("l").alias("lang"), F.col("s").alias("source"), "epoch", "order").alias("mix"))


def mix_ids(df: DataFrame, path: str, weights: Weights, budget: float | None = None, *, domain: Column, id_col: str = "doc_id", factor: float = 1.0, max_epochs: int = 4, **names) -> DataFrame:
    """(id_col, domain, lang, source, epoch, order, n_tokens) of what ``mix`` selects, without texts."""
    light = Scratch(df.sparkSession, "mixing").stage(token_rows(df, path, domain, id_col=id_col, **names), "light")
    out = select(light, light.drop("id"), weights, budget, factor, max_epochs)
    return out.select(F.col("id").alias(id_col), F.col("d").alias("domain"), F.col("l").alias("lang"), F.col("s").alias("source"), "epoch", "order", F.col("n").alias("n_tokens"))
