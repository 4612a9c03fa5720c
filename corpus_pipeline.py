"""A cleaning and packing pipeline over ``documents``.

Each stage takes ``(spark, docs, sf_dir)``, with ``docs`` what the stage before it kept, and
returns a DataFrame. All but the last return the columns of ``documents`` (and any others that
``docs`` has). A stage's result is written as Parquet and read again by the next. Null and
empty texts are scored as texts without words; an empty table gives an empty result; where labels
of one kind are missing, the classifiers reject nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.llm import near_dedup, packing, rule_ensemble, toxicity
from examlake.llm.common import fresh_name, use_checkpoint_dir
from examlake.llm.queries import table, word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; trained on the labelled rows of ``docs``."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh_name(docs, "score")
    return toxicity.with_score(docs, model, out_col=score).where(F.col(score) < 0.5).drop(score)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; trained on the labelled rows of ``docs``."""
    model, score = rule_ensemble.train(docs, table(spark, sf_dir, "labels")), fresh_name(docs, "score")
    return rule_ensemble.with_score(docs, model, out_col=score).where(F.col(score) >= 0.3).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies (five words, likeness 0.8 or more).

    Rows that repeat an id are one document, so they stay or go together; rows without an id stay.
    """
    kept = near_dedup.near_duplicates(docs, 80, 5).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of 2048."""
    return packing.pack_documents(docs.select("doc_id", "text"), word_bpe(), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between them is written to the shared folder."""
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
