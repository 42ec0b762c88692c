"""A corpus, stage by stage: language, near-duplicates, benchmark passages, personal data, and the mix of sources.

Each stage takes what its predecessor kept. All but the last return the columns of `documents`; the last returns the mixing
plan: doc_id, source, size, source_size, target, copies, taken.

Nulls and edges: a null or empty text has no language and goes; rows with a null id stay in all later stages; rows that share an id
are told apart by their text, and equal ones are near-duplicates; ties in a group go to the least id, then the least hash of the text;
a long text is worked on whole by every stage; `documents` may have further columns of any name, which all stages but the last pass
on; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runstore.llm import decontam, langid, mixing, pii, similar
from runstore.llm._common import stored, table

#: A text stays if its language scores this many times what all languages score by chance: very short texts stay.
OVER_CHANCE = 1.2


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, or told with a score near chance, go."""
    net = langid.learned(docs, langid.third(F.col("doc_id")) != 1)
    return langid.accepted(docs, net, OVER_CHANCE / len(net.languages) if net else 0.0)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: sets of five-word shingles with a Jaccard similarity of 0.8 or more, proposed by tries of fingerprints and confirmed on the whole sets."""
    return similar.one_of_each(docs, shingle=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced; n_chars follows the text."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.when(out["text"].isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken."""
    return mixing.mix_sources(docs, quality=mixing.quality_weights(table(spark, sf_dir, "labels"))).drop("tie")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify),
    ("SimHash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("mixing sources", mix),
]
#: SQL can express neither the network nor the alignments; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
