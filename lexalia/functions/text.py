"""Column functions for raw text and tokens (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Fixed value: what counts as a web address when cleaning text.
# One class of characters (%XX lies inside $-_): a repeated group would be matched by recursion.
URL = r"http[s]?://[a-zA-Z0-9$-_@.&+!*(),]+"

# A token is a number (with inner , . -), a word, or one other visible symbol;
# what a tagger labels as punctuation is never taken up.
PUNCTUATION = r".,;:!?()\[\]{}\"'…\-–—/\\"
TOKEN = (r"[0-9]+(?:[.,\-][0-9]+)*|[\p{L}\p{N}]+|[^ \t\n\r\f\p{L}\p{N}"
         + PUNCTUATION + "]")

# Token shapes that carry no vocabulary.
NOISE = {
    "integer": r"[0-9]+",
    "symbol": r"[^\p{L}\p{N}_]",
    "decimal_comma": r"[0-9]+,[0-9]+",
    "decimal_dot": r"[0-9]+\.[0-9]+",
    "date_dots": r"[0-9]{1,2}\.(0[0-9]{1}|[0-9]{1,2})\.([0-9]{2}|[0-9]{4})",
    "date_dashes": r"[0-9]{1,2}-(0[0-9]{1}|[0-9]{1,2})-([0-9]{2}|[0-9]{4})",
}


def possessive(pattern: str) -> str:
    """``URL`` or ``TOKEN`` matching the same strings without backtracking, so at any length.

    DuckDB, which has no such form, takes the pattern as it is.
    """
    return (pattern.replace("[a-zA-Z0-9$-_@.&+!*(),]+", "[a-zA-Z0-9$-_@.&+!*(),]++")
            .replace(r"[0-9]+(?:[.,\-][0-9]+)*", r"[0-9]++(?:[.,\-][0-9]++)*+"))


def noise_pattern(rules: Iterable[str] = tuple(NOISE)) -> str:
    """One anchored alternation, so each token is matched once, not per rule."""
    return "^(" + "|".join(NOISE[r] for r in rules) + ")$"


def is_noise(token: Column, rules: Iterable[str] = tuple(NOISE)) -> Column:
    return token.rlike(noise_pattern(rules))


def strip_space(text: Column) -> Column:
    """Trim spaces, tabs and line ends (Spark's ``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def remove_marks(text: Column) -> Column:
    """Drop quotation marks and hash signs."""
    return F.translate(text, '"#', "")


def remove_url(text: Column, every: bool = False) -> Column:
    """Drop the first web address, or every one."""
    if every:
        return F.regexp_replace(text, possessive(URL), "")
    return F.regexp_replace(text, rf"(?s)^(.*?){possessive(URL)}", "$1")


def clean_text(text: Column, every_url: bool = False) -> Column:
    return remove_url(remove_marks(text), every_url)


def to_ascii(text: Column) -> Column:
    """Latin letters with Polish marks to their plain forms."""
    return F.translate(text, "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ")


def tokenise(text: Column) -> Column:
    """Array of words, numbers and symbols in reading order, without punctuation."""
    return F.regexp_extract_all(text, F.lit(possessive(TOKEN)), F.lit(0))


def last_chars(text: Column, n: int = 25) -> Column:
    return F.right(text, F.lit(n))


def starts_with_any(name: Column, prefixes: Iterable[str]) -> Column:
    """File-name prefix test."""
    return name.rlike("^(" + "|".join(prefixes) + ")")


def period_from_path(path: Column) -> Column:
    """``period`` out of a ``…/period=X/…`` path or a ``kind_X.ext`` file name."""
    keyed = F.regexp_extract(path, r"period=([^/]+)", 1)
    named = F.regexp_extract(path, r"(?:^|/)[a-z]+_([^/.]+)(?:\.[^/]*)?$", 1)
    return F.when(keyed != "", keyed).otherwise(F.nullif(named, F.lit("")))


def content_kind(name: Column) -> Column:
    """Table holding the texts of a stored file: sessions start with ``ps``."""
    return F.when(starts_with_any(name, ["ps"]), F.lit("pscontent")).otherwise(
        F.lit("ipcontent"))
