"""Documents to packed training sequences, in five stages over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fissura.llm.jaccard_join import may_be_among, near_copies, text_key
from fissura.llm.language import identify
from fissura.llm.packing import pack_documents
from fissura.llm.secrets import find_secrets
from fissura.llm.shared import beside, stored, table
from fissura.llm.toxicity import score_toxicity

ROW = ("row",)
#: Posterior that the best language needs for a document to stay.
SURE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    labels = table(spark, sf_dir, "labels")
    judged = beside(docs, lambda rows: score_toxicity(rows, labels, carry=ROW))
    return judged.filter("new.predicted = 0").select("row.*")


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language for sure, go."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    judged = beside(
        docs, lambda rows: identify(rows.withColumn("lang", F.col("row.lang")), path, carry=ROW)
    )
    return judged.filter((F.col("new.lang_pred") != "und") & (F.col("new.score") >= SURE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, and of rows that repeat id and text, one stays.

    Five-word shingles and a likeness of 0.8. The row of the smallest id of a
    group stays. Rows that share an id but not a text are documents of their own:
    each goes only if its own text has another keeper. Of repeated rows that differ
    in other columns the one that reads smallest as JSON stays. Documents without an
    id are in no group.
    """
    gone, again = near_copies(docs, width=5, num=80, den=100)
    gone, again = stored(gone, "gone"), stored(again, "again")
    keys = ["doc_id", "text_key"]
    # Texts that are in neither table, nearly all, are told by a bit set and not shuffled.
    row_key = F.xxhash64(*keys)
    concerned = may_be_among(gone.union(again).select(row_key.alias("id")), row_key)
    # No name can clash with the documents' own columns.
    rows = docs.select(F.struct("*").alias("row"), "doc_id", text_key(F.col("text")).alias("text_key"))
    rows = rows.withColumn("concerned", F.coalesce(concerned, F.lit(False)))
    kept = rows.filter("concerned").join(gone, keys, "left_anti")
    once = rows.filter("not concerned").select("row")
    if again.isEmpty():
        return once.union(kept.select("row")).select("row.*")
    once = once.union(kept.join(again, keys, "left_anti").select("row"))
    twice = kept.join(again, keys, "left_semi").groupBy(keys)
    return once.union(twice.agg(F.min_by("row", F.to_json("row")).alias("row")).drop(*keys)).select("row.*")


def _named(column: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; all documents stay."""
    found = beside(docs, lambda rows: find_secrets(rows, carry=ROW))
    clean = found.select("row.*", F.col("new.redacted").alias("_clean"))
    changed = F.col("_clean").isNotNull()
    n_chars = F.when(changed, F.char_length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.select(
        *(
            F.coalesce("_clean", "text").alias(c) if c == "text" else n_chars.alias(c) if c == "n_chars" else _named(c)
            for c in docs.columns
        )
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", hide_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, merges and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
