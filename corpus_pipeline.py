"""A training corpus in five stages, each over all that the stage before has kept.

Toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark items go, secrets are blotted out, and what is left is mixed
by source. Every stage but the last returns the columns of ``documents``; each
result is written as Parquet to the shared folder and read again as the next
stage's input, so a lost executor costs at most the running stage.

In every stage null and empty texts stay (as one near-duplicate group), an empty
table gives an empty table, columns that a stage doesn't use pass through with
type and bits whatever their names, and very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barsmith.llm.common import materialize, read_table
from barsmith.llm.decontaminate import drop_leaks
from barsmith.llm.mixing import mix
from barsmith.llm.secret_ledger import redact
from barsmith.llm.simhash_dedup import drop_near_duplicates
from barsmith.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below 0.7; repeated rows go or stay together."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a five-word likeness of 0.8 or more the row with the smallest id; of repeated rows one; ids that are null by their text.

    Copies edited further than that stay, which are about half of the near copies that the check tool plants.
    """
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which no benchmark item is covered to 0.8 or more; repeated rows go or stay together."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets blotted out of the text and ``n_chars`` set anew where that changed; repeated rows stay."""
    return redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: how many words the mix takes of each document, repeats counted; ties in the key go by id, then size."""
    return mix(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("mixing", mixed),
]

#: SQL can express neither the trained model nor the linked groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
