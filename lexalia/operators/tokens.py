"""Token rows: tagging, cleaning and rebuilding documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexalia.functions.text import NOISE, clean_text, is_noise, tokenise
from lexalia.operators.aggregates import number_within
from lexalia.sources.wordlists import date_words, salutations, stop_words, word_frame


def token_rows(docs: DataFrame, keys: list[str], text: str, every_url: bool = False
               ) -> DataFrame:
    """Clean and split: ``keys, pos, ORG``, without punctuation.

    A document left without tokens keeps one row with an empty token.
    """
    tokens = tokenise(clean_text(F.col(text), every_url))
    rows = docs.select(*keys, F.posexplode_outer(tokens).alias("_pos", "_token"))
    return rows.select(*keys, F.col("_pos").cast("long").alias("pos"),
                       F.coalesce("_token", F.lit("")).alias("ORG"))


def lemmatise(tokens: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Add ``TAGGED``: the dictionary's lemma, or the lower-cased token.

    ``dictionary`` has one ``form, lemma`` row per form; its size decides how
    Spark joins it.
    """
    lowered = tokens.withColumn("_form", F.lower("ORG"))
    if dictionary is None:
        return lowered.withColumnRenamed("_form", "TAGGED")
    forms = dictionary.select(F.col("form").alias("_form"), F.col("lemma").alias("_lemma"))
    return (lowered.join(forms, "_form", "left")
            .withColumn("TAGGED", F.coalesce("_lemma", "_form"))
            .drop("_form", "_lemma"))


def lemmatise_with(tokens: DataFrame, lemma_of: Callable[[str], str]) -> DataFrame:
    """As ``lemmatise`` with an outside lemmatiser, called on Arrow batches."""
    @F.pandas_udf("string")
    def apply(words: pd.Series) -> pd.Series:
        lemmas = {w: lemma_of(w) for w in words.dropna().unique()}
        return pd.Series([lemmas.get(w) for w in words], dtype=object)

    return tokens.withColumn("TAGGED", apply("ORG"))


def keep_parts_of_speech(tokens: DataFrame, tags: Iterable[str] | None,
                         column: str = "pos_tag") -> DataFrame:
    """Keep the given tags; without tags or without a tag column, keep all."""
    if tags is None or column not in tokens.columns:
        return tokens
    return tokens.filter(F.col(column).isin(list(tags)))


def clean_tokens(tokens: DataFrame, column: str = "TAGGED",
                 words: list[str] | None = None,
                 rules: Iterable[str] = tuple(NOISE)) -> DataFrame:
    """Drop date words, stop words, noise shapes and salutations in one pass."""
    spark = tokens.sparkSession
    listed = date_words() + (stop_words() if words is None else words)
    return (
        tokens.filter(~is_noise(F.col(column), rules))
        .filter(~F.col(column).isin(salutations()))
        .join(word_frame(spark, listed, column), column, "left_anti")
    )


def clean_lemma_array(text: Column, words: list[str] | None = None) -> Column:
    """Cleaned lemmas of a text in reading order, inside the row.

    Gives what ``token_rows`` → ``lemmatise`` → ``clean_tokens`` → ordering
    would give without a dictionary, but needs no shuffle.
    """
    dropped = date_words() + (stop_words() if words is None else words) + salutations()
    lemmas = tokenise(F.lower(clean_text(text)))
    return F.filter(lemmas, lambda t: ~is_noise(t) & ~t.isin(dropped))


def rebuild_documents(tokens: DataFrame, keys: list[str], column: str = "TAGGED",
                      order: str = "pos", name: str = "CONTENT") -> DataFrame:
    """Paste token rows back into one text per document, in token order."""
    placed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(column))))
    words = F.transform(placed, lambda t: t[column])
    return tokens.groupBy(*keys).agg(F.array_join(words, " ").alias(name))


def pending_documents(docs: DataFrame, done: DataFrame, keys: list[str],
                      max_docs: int | None = None, order: list[str] | None = None,
                      by: list[str] | None = None) -> DataFrame:
    """Documents not processed yet, at most ``max_docs`` of them (of each group ``by``) per run."""
    todo = docs.join(done.select(*keys).distinct(), keys, "left_anti")
    if max_docs is None:
        return todo
    if not by:
        return todo.orderBy(*(order or keys)).limit(max_docs)
    # Numbers come from a running count over sorted keys: no group is gathered, and only keys are sorted.
    rest = [k for k in (order or keys) if k not in by]
    first = number_within(todo.select(*by, *keys_beside(keys, by)), by, rest, "_n").where(F.col("_n") <= max_docs)
    return todo.join(first.drop("_n"), [*by, *keys_beside(keys, by)], "left_semi")


def keys_beside(keys: list[str], by: list[str]) -> list[str]:
    return [k for k in keys if k not in by]
