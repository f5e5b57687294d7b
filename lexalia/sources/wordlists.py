"""Word lists and term bounds, with their DataFrame forms.

The full stop list of a language is a parameter: hand in a Python list, or a
path to a text file with one word per line.  Only a short list of function
words is built in.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexalia.functions.text import strip_space

_FUNCTION_WORDS = {"pl": """
a aby ale albo ani bo by być co czy dla do gdy gdzie i ich ile jak jako jest już każdy kto
który lub mój my na nad nie o od on ona oni oraz po pod przed przez przy są się ta tak ten
też to tu tylko ty w we więc wy z za ze że żeby
""", "en": """
the of and in is that for it as was with be on are this
""", "fr": """
de la le et les des en un du une que est pour par
""", "de": """
der die und den von zu das mit sich auf
""", "es": """
el y los del se las por con para
"""}

# Lemmas that only carry a date.
_DATE_WORDS = """
dzień styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik
listopad grudzień rok
"""

# Lemmas of greetings and signatures.
_SALUTATIONS = "szanowny minister premier poseł poważanie"

# Parliamentary terms with their first and last day.
TERMS = (
    ("1997-2001", dt.date(1997, 10, 20), dt.date(2001, 10, 18)),
    ("2001-2005", dt.date(2001, 10, 19), dt.date(2005, 10, 18)),
    ("2005-2007", dt.date(2005, 10, 19), dt.date(2007, 9, 7)),
)


def stop_words(language: str | None = None) -> list[str]:
    """Function words of one language (``pl en fr de es``), or of all for a mixed corpus."""
    lists = _FUNCTION_WORDS.values() if language is None else [_FUNCTION_WORDS[language]]
    return [word for words in lists for word in words.split()]


def date_words() -> list[str]:
    return _DATE_WORDS.split()


def salutations() -> list[str]:
    return _SALUTATIONS.split()


def word_frame(spark: SparkSession, words: list[str], column: str = "lemma") -> DataFrame:
    """One-column DataFrame of distinct ``words``, broadcast because its length is known."""
    rows = [(w,) for w in dict.fromkeys(words)]
    return F.broadcast(spark.createDataFrame(rows, f"{column} string"))


def stop_word_frame(spark: SparkSession, column: str = "lemma",
                    words: list[str] | None = None) -> DataFrame:
    return word_frame(spark, stop_words() if words is None else words, column)


def read_word_list(spark: SparkSession, path: str, column: str = "lemma") -> DataFrame:
    """A word list from a text file; no broadcast hint, its size is not known here."""
    words = spark.read.text(path).select(strip_space(F.col("value")).alias(column))
    return words.filter(F.length(column) > 0).distinct()


def term_bounds(spark: SparkSession, terms=TERMS) -> DataFrame:
    return F.broadcast(spark.createDataFrame(
        list(terms), "period string, start_date date, end_date date"))
