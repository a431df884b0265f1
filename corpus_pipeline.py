"""The corpus pipeline: what is left of the documents after each stage, and the tokens of what remains.

Each stage takes all rows that the one before kept and gives back the columns of documents, whatever other columns there
are; the last gives tokens. In every stage rows with a null doc_id or a null or empty text stay (they have nothing that
a stage could reject, but a null or empty text counts as equal to other such texts among near copies), rows that repeat
a doc_id share its fate, very long texts are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from sluice.llm.queries import table, vocabulary
from sluice.llm.shared import fresh_path
from sluice.storage import files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of severity grades does not reject. Ties and repeats: each row is judged by its own text;
    without labels nothing is rejected."""
    model = toxicity.fit(docs, toxicity.grades_of(table(spark, sf_dir, "labels")), sample=8192)
    return toxicity.keep_clean(docs, model)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs across them, but for the first document's; a document that loses
    all lines stays, empty. n_chars isn't counted anew."""
    return line_dedup.drop_recurring(docs, passage=None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; of what is left, without the lines of
    20 words or more that an earlier document has. Rows with a null doc_id are in no group and stay; rows that repeat
    the smallest doc_id all stay. The first step is written out, as the second reads it twice."""
    path = fresh_path(spark, "pipeline-first")
    simhash.keep_first(docs, simhash.simhash_groups(docs, distance=4)).write.parquet(path)
    return line_dedup.drop_passages(spark.read.parquet(path), least=20)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; a doc_id goes with all its rows. An empty benchmark takes nothing."""
    return decontaminate.drop_leaks(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the text that they decode to; a null or empty text has none."""
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokens),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives. Each stage's rows are written and read again; they go once the next ones are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            store, folder = files(spark, before)
            store.delete(folder, True)
        before = path
    return docs
