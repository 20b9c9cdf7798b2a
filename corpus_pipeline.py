"""Five stages that turn raw documents into a token file.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared scratch
folder and rereads as the next stage's docs. All but the last return the columns of documents.

Rows whose text is null or empty have no sign of toxicity but the classifier's bias, are near-duplicates of each other,
and hold no passage and no token but the end id. Rows with a null doc_id are kept like others, learned from by no
classifier, chosen last among near-duplicates and written first. Repeated rows are near-duplicates, so one stays. Extra
columns, also of names that stages use inside, go through all stages but the last. Without documents the result is
empty; without labels nothing is rejected, and every domain is as likely as the next; without benchmark items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, mixing, simhash, token_files, toxicity
from tessella.llm.common import stored, table

#: Documents of this score or more are rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier is learned from the labelled rows of the whole table; it judges the documents of this stage."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, keep=TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates for the documents that are left; a rate is the expected number of a document's copies."""
    return mixing.mixed(docs, mixing.fit_to_weights(docs, table(spark, sf_dir, "labels")))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the token file, read back from it."""
    return token_files.written_and_read(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_to_weights),
    ("token-id output", write_tokens),
]

#: SimHash groups, trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the token file."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
