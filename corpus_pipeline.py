"""The corpus pipeline: from documents to packed sequences in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexalia.llm import decontaminate, line_dedup, packing, quality_crf, simhash
from lexalia.llm.queries import tokenizer_path
from lexalia.llm.rows import KEY, key, read, stage


def _packed(docs: DataFrame, *without: str) -> DataFrame:
    """Id, text, and the other columns as one, so that no name of theirs meets a name of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in without]
    return docs.select(F.struct(*rest).alias("_row"), "doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and whose lines are mostly content; null and empty texts go."""
    judged = quality_crf.quality_rules(_packed(docs), read(spark, sf_dir, "labels"), keep_columns=("_row",))
    return judged.where("kept").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later places of three-line windows; ``n_chars`` follows the text.

    Every document stays, one that loses all its lines with an empty text; a null text stays null.
    """
    found = line_dedup.line_dedup(_packed(docs, "text"), keep_columns=("_row",))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints: three-word shingles, at most two differing bits.

    Rows equal in id and text count as one document; texts without a word share the fingerprint zero.
    """
    return simhash.one_of_each(_packed(docs, "text")).select(
        *[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts have none and stay."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(*KEY).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *key("doc_id", "text"))
    return rows.join(hit, KEY, "left_anti").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of every document; a null text is one end token."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack),
]

#: The first stage's field and the last one's tokenizer are beyond SQL; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name, replaces=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
