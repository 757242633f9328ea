"""Vector and loss functions as column expressions over arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .arrays import once


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def masked_mean(rows: Column, mask: Column) -> Column:
    """Mean of the vectors of ``rows`` (array of arrays) where ``mask`` is 1, over at least one."""
    kept = F.filter(F.arrays_zip(rows.alias("v"), mask.alias("m")), lambda r: r["m"] == 1)
    width = F.size(F.get(rows, F.lit(0)))
    total = F.aggregate(F.transform(kept, lambda r: r["v"]), F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def span_mean(rows: Column, starts: Column, ends: Column, fallback: Column) -> Column:
    """Mean of the vectors at places in any span [start, end); the masked mean of ``fallback`` where spans cover none."""
    spans = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    inside = F.transform(rows, lambda _, i: F.exists(spans, lambda s: (s["a"] <= i) & (i < s["b"])).cast("int"))
    return F.when(F.exists(inside, lambda m: m == 1), masked_mean(rows, inside)).otherwise(masked_mean(rows, fallback))


def log_sigmoid(x: Column) -> Column:
    return -(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def info_nce(positive: Column, negatives: Column, temperature: float = 0.07) -> Column:
    """Loss of similarities: the positive against itself and the negatives, shifted by the largest."""
    scaled = F.transform(F.concat(F.array(positive.cast("double")), negatives), lambda x: x / temperature)
    top = F.array_max(scaled)
    return top + F.log(_sum(F.transform(scaled, lambda x: F.exp(x - top)))) - positive / temperature


def dpo_margin(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    return beta * ((chosen - rejected) - (ref_chosen - ref_rejected))


def dpo_loss(margin: Column, smoothing: float = 0.0) -> Column:
    return -((1 - smoothing) * log_sigmoid(margin) + smoothing * log_sigmoid(-margin))


def simpo_margin(chosen_sum: Column, chosen_n: Column, rejected_sum: Column, rejected_n: Column, beta: float = 2.0, gamma: float = 1.0) -> Column:
    mean = lambda s, n: s / F.greatest(n.cast("double"), F.lit(1.0))
    return beta * (mean(chosen_sum, chosen_n) - mean(rejected_sum, rejected_n)) - gamma


def sequence_logprob(logprobs: Column, mask: Column) -> Column:
    """STRUCT(sum, n) of the log-probabilities whose *target* (the next place) is in the mask."""
    targets = F.filter(F.arrays_zip(logprobs.alias("l"), F.slice(mask, 2, F.size(mask)).alias("m")), lambda r: (r["m"] == 1) & r["l"].isNotNull())
    return F.struct(_sum(F.transform(targets, lambda r: r["l"])).alias("sum"), F.size(targets).alias("n"))


def total_loss(parse: Column, contrast: Column, weight: float) -> Column:
    return parse + weight * contrast


def perplexity_ratio(conditional: Column, unconditional: Column) -> Column:
    return F.exp(conditional - unconditional)


def truncated_context(context: Column, target: Column, max_tokens: int) -> tuple[Column, Column]:
    """Token arrays that a scorer sees: the target's first half budget, and the context's last rest."""
    kept = F.slice(target, 1, max_tokens // 2)
    room = F.lit(max_tokens) - F.size(kept)
    return F.slice(context, F.greatest(F.size(context) - room + 1, F.lit(1)), F.greatest(room, F.lit(0))), kept


def find_subsequence(haystack: Column, needle: Column) -> Column:
    """The first place (from 0) of ``needle`` in ``haystack``, or -1."""
    def place(h: Column, n: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.greatest(F.size(h) - F.size(n), F.lit(0))), lambda i: F.slice(h, i + 1, F.size(n)) == n)
        return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))

    return once(haystack, lambda h: once(needle, lambda n: place(h, n)))


def projection_head(w1, b1, w2, b2, gain, shift, eps: float = 1e-5):
    """A pandas UDF: pooled vectors through two linear layers with an (erf) GELU between, layer norm, and scaling to length 1.

    Weights are arrays (out x in) that go to the tasks with the function.
    """
    w1, b1, w2, b2, gain, shift = (np.asarray(x, np.float64) for x in (w1, b1, w2, b2, gain, shift))

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros((0, w1.shape[1]))
        h = x @ w1.T + b1
        h = h * 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(h / math.sqrt(2))) if h.size else h
        z = h @ w2.T + b2
        z = (z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + eps) * gain + shift
        z = z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)
        return pd.Series(list(z))

    return project
