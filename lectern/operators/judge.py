"""Judging answers: a shortcut by text, a model's strict replies for the rest, and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_for_match


def strict_reply(text: Column, fields: dict[str, str], allowed: dict[str, tuple[str, ...]] | None = None) -> Column:
    """A model's JSON reply as a struct of ``fields`` (name -> DDL type); null where it is no object of exactly these fields with
    values of these types, or a value is none of the ``allowed`` ones."""
    got = F.from_json(text, ", ".join(f"`{n}` {t}" for n, t in fields.items()))
    ok = F.array_sort(F.json_object_keys(text)) == F.array(*(F.lit(n) for n in sorted(fields)))
    for n in fields:
        ok = ok & got[n].isNotNull()
    for n, values in (allowed or {}).items():
        ok = ok & got[n].isin(*values)
    return F.when(F.coalesce(ok, F.lit(False)), got)


def shortcut(gold: Column, pred: Column, exact_unicode: bool = True) -> Column:
    """Whether the normalised gold answer is in the prediction: no judge is asked then."""
    g = normalize_for_match(gold, exact_unicode)
    return F.coalesce((g != "") & F.contains(normalize_for_match(pred, exact_unicode), g), F.lit(False))


def judged(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], gold: str = "gold", pred: str = "pred", exact_unicode: bool = True) -> DataFrame:
    """``rows`` with ``correct``: the shortcut, and for the rest what ``judge`` adds as a boolean column of that name."""
    marked = rows.withColumn("correct", shortcut(F.col(gold), F.col(pred), exact_unicode))
    rest = judge(marked.where(~F.col("correct")).drop("correct"))
    return marked.where("correct").unionByName(rest.select(*rows.columns, F.col("correct").cast("boolean")))


def summary(rows: DataFrame, by: str = "parser", labels: tuple[str, ...] = ("present", "degraded", "absent")) -> DataFrame:
    """What a judge makes of answers that text matching misses: rows(by, matched, has_page, label).

    A page that is not parsed is absent without a judge. The semantic rate is null unless every missed answer is judged.
    """
    missed = ~F.col("matched")
    label = F.when(missed & ~F.col("has_page"), labels[-1]).when(missed, F.col("label"))
    counts = rows.withColumn("_label", label).groupBy(by).agg(
        F.count("*").alias("total"), F.count(F.when(missed, 1)).alias("missed"), F.count("_label").alias("judged"), F.count(F.when(F.col("_label").isNotNull() & F.col("has_page"), 1)).alias("with_page"),
        *(F.count(F.when(F.col("_label") == n, 1)).alias(n) for n in labels),
    )
    share = lambda n: F.when(F.col("with_page") > 0, F.col(n) / F.col("with_page")).otherwise(0.0)
    complete = F.col("judged") == F.col("missed")
    return counts.withColumns({
        "artifact_share": share(labels[0]), "complete": complete, "semantic_absent_rate": F.when(complete, (F.col("missed") - F.col(labels[0])) / F.col("total")),
    })
