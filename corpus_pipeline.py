"""A training-data pipeline over ``documents``: language ID, near copies, personal data, mixing, packing.

Each stage works on what its predecessor kept. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import language, mixing, packing, pii
from lectern.llm.common import Scratch
from lectern.llm.jaccard_join import drop_near_copies
from lectern.llm.queries import domain_of
from lectern.llm.tokens import tokenizer_path
from lectern.session import ship

#: Languages are mixed by their share to this power; no document has less than one epoch.
SMOOTHING = 0.7


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the predicted language replaces the label; documents without any language (``und``) go."""
    ship(spark)
    model = language.fit(docs.where(language.remainder("doc_id") != 0))
    return language.with_language(docs, model).where("lang <> 'und'")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6, as near duplicates: shingles of five words, similarity 0.8 or more; one document of each group stays."""
    ship(spark)
    return drop_near_copies(docs, "doc_id", "text", 5, (80, 100))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: spans become their kind in brackets; no document goes."""
    ship(spark)
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def smoothed(leaves: Mapping[tuple, float]) -> tuple[dict[tuple, float], float]:
    """Weights of languages below each domain, their share to the power ``SMOOTHING``, and the budget in which no leaf has less than one epoch."""
    sizes: dict[tuple, float] = {}
    for (domain, lang, _), n in leaves.items():
        sizes[domain, lang] = sizes.get((domain, lang), 0.0) + n
    own = {d: {k: n for k, n in sizes.items() if k[0] == d} for d in {d for d, _ in sizes}}
    weights = {k: n**SMOOTHING / sum(x**SMOOTHING for x in own[k[0]].values()) for k, n in sizes.items()}
    need = max((n / sum(own[k[0]].values()) / weights[k] for k, n in sizes.items()), default=1.0)
    return weights, 1.0001 * sum(leaves.values()) * need


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: languages weigh their share to the power ``SMOOTHING``, in a budget that gives each leaf
    one epoch at least; rare languages are repeated, up to four epochs. An empty table stays empty; a column ``mix``
    of the documents' own would not."""
    ship(spark)
    return mixing.mix(docs, tokenizer_path(), smoothed, domain=domain_of()).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: pieces of all documents in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language ID", identify_languages), ("n-gram Jaccard join", drop_copies), ("PII", redact_personal_data), ("mixing", mix_languages), ("packing", pack_sequences)]

#: SQL has no language model, trees or best-fit packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
