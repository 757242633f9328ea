"""Pluggable models: completions, scorers and generators run as Arrow batches beside the data."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.vectors import perplexity_ratio
from ..session import fresh_dir, kept
from . import quantiles


def completed(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str | None]]], prompt: str = "prompt", out: str = "reply", retries: int = 1, valid: Callable[[str], bool] = bool, parallel: int | None = None) -> DataFrame:
    """Replies to a prompt column. ``make`` builds the client once for each task; invalid replies are asked again,
    and the last answer stays whatever it is. ``parallel`` bounds the tasks that call at once."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        ask = make()
        for batch in batches:
            replies = list(ask(batch[prompt].tolist()))
            for _ in range(retries):
                again = [i for i, r in enumerate(replies) if r is None or not valid(r)]
                if again:
                    for i, r in zip(again, ask([batch[prompt].iloc[i] for i in again])):
                        replies[i] = r if r is not None else replies[i]
            yield batch.assign(**{out: replies})

    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, schema)


def completed_pending(rows: DataFrame, store: str, key: str, make: Callable[[], Callable[[list[str]], list[str | None]]], prompt: str = "prompt", **how) -> DataFrame:
    """(key, value, seq) of all rows: replies that a store has are not asked for again, and a row without a reply stays pending."""
    from ..streaming.incremental import score_pending

    ask = lambda pending: completed(pending.select(key, prompt), make, prompt, "value", **how).select(key, "value", F.lit(0).alias("seq"))
    return score_pending(rows, store, key, ask, f"{key} {dict(rows.dtypes)[key]}, value string, seq int")


def in_flight(one: Callable[[str], str | None], at_once: int) -> Callable[[list[str]], list[str | None]]:
    """A client that has up to ``at_once`` calls of ``one`` in flight: a call begins when one has ended, so no more prompts wait
    than are in a batch, and replies keep the order of the prompts. An error of a call is that prompt's None."""
    from concurrent.futures import ThreadPoolExecutor

    def safe(prompt: str) -> str | None:
        try:
            return one(prompt)
        except Exception:  # noqa: BLE001 - a reply that is lost stays pending
            return None

    def ask(prompts: list[str]) -> list[str | None]:
        if at_once <= 1 or len(prompts) <= 1:
            return [safe(p) for p in prompts]
        with ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(safe, prompts))

    return ask


def chat_client(url: str, model: str, system: str | None = None, timeout: float = 60.0, headers: dict[str, str] | None = None, at_once: int = 8, **options) -> Callable[[], Callable[[list[str]], list[str | None]]]:
    """A client of a chat-completions server, as ``completed`` takes it: a prompt's first reply, or None where the server has none.

    Each task has up to ``at_once`` requests in flight; ``completed(parallel=...)`` bounds the tasks, so the server sees their product at most.
    """
    def make():
        import json
        import urllib.request

        def one(prompt: str) -> str | None:
            turns = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
            body = json.dumps({"model": model, "messages": turns, **options}).encode()
            request = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", body, {"Content-Type": "application/json", **(headers or {})})
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                return json.load(reply)["choices"][0]["message"]["content"]

        return in_flight(one, at_once)

    return make


def parsed_by_command(rows: DataFrame, command: list[str], content: str = "content", out: str = "markdown", timeout: float = 600.0) -> DataFrame:
    """``rows`` with what a command prints for a row's bytes on its standard input; null where it fails or takes too long."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        import subprocess

        for batch in batches:
            texts = []
            for raw in batch[content]:
                try:
                    done = subprocess.run(command, input=bytes(raw) if raw is not None else b"", capture_output=True, timeout=timeout)
                    texts.append(done.stdout.decode(errors="replace") if done.returncode == 0 else None)
                except (OSError, subprocess.TimeoutExpired):
                    texts.append(None)
            yield batch.assign(**{out: texts})

    return rows.mapInPandas(run, schema)


def unigram_nll(text: str, context: str | None) -> float | None:
    """Offline stand-in for a language model: mean negative log-likelihood of characters, smoothed, over the text's own and its context's counts."""
    import math
    from collections import Counter

    if not text:
        return None
    seen = Counter(context or "")
    total, n = 0.0, sum(seen.values())
    for c in text:
        total -= math.log((seen[c] + 1) / (n + 256))
        seen[c] += 1
        n += 1
    return total / len(text)


#: Cells of a table of counts: texts times different characters.
_CELLS = 1 << 20


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1, dtype=np.float64)))])


def unigram_nlls(texts: list[str | None], contexts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(plain, given): what ``unigram_nll`` gives each text without and with its context, NaN for None. How often a text has each character says all,
    so the counts of many texts are one table."""
    n = len(texts)
    out = np.full((2, n), np.nan)
    points = lambda xs: np.frombuffer("".join(xs).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    before = np.array([len(c or "") for c in contexts], np.int64)
    x, y = points([t or "" for t in texts]), points([c or "" for c in contexts])
    alphabet = np.unique(x)
    if not len(alphabet):
        return out[0], out[1]
    code = np.full(int(max(alphabet[-1], y.max() if len(y) else 0)) + 1, -1, np.int64)
    code[alphabet] = np.arange(len(alphabet))
    x, y, width = code[x], code[y], len(alphabet)
    logs = _log_factorials(int(max(sizes.max() + before.max() + 256, 256)))
    begin, start = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(before)])
    step = max(1, _CELLS // width)
    for i in range(0, n, step):
        j = min(n, i + step)
        count = lambda z, at, k: np.bincount((np.repeat(np.arange(j - i), k[i:j]) * width + z[at[i] : at[j]])[z[at[i] : at[j]] >= 0], minlength=(j - i) * width)
        own, seen = count(x, begin, sizes), count(y, start, before)
        cells = np.flatnonzero(own)
        text, own, seen = cells // width, own[cells], seen[cells]
        m, k = sizes[i:j], before[i:j]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[0, i:j] = (logs[m + 255] - logs[255] - np.bincount(text, logs[own], j - i)) / m
            out[1, i:j] = (logs[k + m + 255] - logs[k + 255] - np.bincount(text, logs[own + seen] - logs[seen], j - i)) / m
    return out[0], out[1]


def boundary_clarity(pairs: DataFrame, nll: Callable[[str, str | None], float | None] = unigram_nll, prev: str = "prev_text", nxt: str = "next_text") -> DataFrame:
    """``bc`` = ppl(next | prev) / ppl(next) and ``skip_reason`` of neighbouring texts; stickiness is the same on the halves of one chunk."""
    @F.pandas_udf("struct<plain:double,given:double>")
    def score(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        if nll is unigram_nll:
            plain, given = unigram_nlls(b.tolist(), a.tolist())
            return pd.DataFrame({"plain": plain, "given": given})
        return pd.DataFrame({"plain": [nll(y, None) if y is not None else None for y in b], "given": [nll(y, x) if y is not None else None for x, y in zip(a, b)]}, dtype="float64")

    rows = pairs.withColumn("_nll", score(F.col(prev), F.col(nxt)))
    return valid_ratio(rows, perplexity_ratio(F.col("_nll.given"), F.col("_nll.plain"))).drop("_nll")


def valid_ratio(rows: DataFrame, ratio: Column, out: str = "bc") -> DataFrame:
    """A ratio and why it is left out: missing, NaN or infinite."""
    reason = F.when(ratio.isNull(), "too_short").when(F.isnan(ratio), "nan").when(F.abs(ratio) == float("inf"), "infinite")
    return rows.withColumn(out, F.when(reason.isNull(), ratio)).withColumn("skip_reason", reason)


def summary(scores: DataFrame, value: str = "bc", by: tuple[str, ...] = (), median: bool = True) -> DataFrame:
    """Over all boundaries, not over pages: mean, median, sample deviation, range, and how many were left out."""
    return scores.groupBy(*by).agg(F.count(value).alias("n"), F.count(F.when(F.col(value).isNull(), 1)).alias("skipped"), F.avg(value).alias("mean"), *([F.median(value).alias("median")] if median else []), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def large_summary(scores: DataFrame, value: str = "bc") -> DataFrame:
    """What ``summary`` gives over all rows, where the values are too many for one task: they are a table of one column, and the median comes from narrowing ranges."""
    rows = kept(scores.select(value), fresh_dir(scores.sparkSession, "scores"))
    half = quantiles.exact(rows, value, [0.5]).select(F.get("q", F.lit(0)).alias("median"))
    return summary(rows, value, median=False).join(half, F.lit(True), "left").select("n", "skipped", "mean", "median", "sd", "low", "high")
