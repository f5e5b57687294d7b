"""Column functions against hand-worked answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexalia.functions import dates, names, text
from lexalia.operators.tokens import clean_lemma_array, clean_tokens, lemmatise_with, token_rows


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("tail, day", [
    ("Z poważaniem, Warszawa, dnia 12 lutego 1998 r.", dt.date(1998, 2, 12)),
    ("Kraków, 5 września 2003 roku.", dt.date(2003, 9, 5)),
    ("xxxxxxxxxxxxxxxxxx 7 maja 2001r", dt.date(2001, 5, 7)),
    ("Warszawa, 31 kwietnia 2002 r.", None),
    ("zupełnie bez żadnej daty", None),
    ("12 października 1998 roku.", dt.date(1998, 10, 2)),
    ("\t 3 listopad 1999.\n", dt.date(1999, 11, 3)),
])
def test_tail_dates(spark, tail, day):
    df = spark.createDataFrame([(tail,)], "x string")
    assert dates.parse_tail_date(df, "x").first().date == day


def test_tail_length_is_a_parameter(spark):
    df = spark.createDataFrame([("12 października 1998 roku.",)], "x string")
    assert dates.parse_tail_date(df, "x", 26).first().date == dt.date(1998, 10, 12)


def test_unreadable_date_breaks_all_rules(spark):
    parsed = dates.parse_tail_date(spark.createDataFrame([(1, "brak")], "k int, x string"), "x")
    rules = {r.rule for r in dates.date_rule_violations(parsed, ["k"]).collect()}
    assert rules == {"year", "month", "day"}


@pytest.mark.parametrize("author, short", [
    ("Adam Jerzy Kowal", "Adam Kowal"), ("Adam Kowal i Jan Nowak", "Adam Kowal"),
    ("Poseł Jan Maria Lis", "Jan Lis"), ("na", "na"), ("łukasz Nowak", None),
    ("Ewa", "Ewa Ewa"), ("Senator\tAnna  Żak", "Anna Żak"), (None, None)])
def test_short_names(spark, author, short):
    assert one(spark, author, names.short_name) == short


def test_party_prefix_only_first_is_anchored(spark):
    assert one(spark, "Klub Parlamentarny X", names.party_short) == "KP X"
    assert one(spark, "Ten Klub Parlamentarny", names.party_short) == "Ten Klub Parlamentarny"
    assert one(spark, "Ten Klub Poselski", names.party_short) == "Ten KP"


@pytest.mark.parametrize("token", ["123", "%", "1,5", "1.5", "01.02.1999", "1-02-99"])
def test_noise_is_dropped(spark, token):
    assert one(spark, token, text.is_noise)


@pytest.mark.parametrize("token", ["ś", "a1", "1.5.x", "VAT", "_"])
def test_words_are_kept(spark, token):
    assert not one(spark, token, text.is_noise)


def test_transliteration(spark):
    assert one(spark, "łódź Żak", text.to_ascii) == "lodz Zak"


def test_only_first_url_goes(spark):
    two = "a http://x.pl/1 b https://y.pl c"
    assert one(spark, two, text.remove_url) == "a  b https://y.pl c"
    assert one(spark, two, lambda c: text.remove_url(c, every=True)) == "a  b  c"


def test_period_from_path(spark):
    assert one(spark, "/d/period=2001-2005/p.parquet", text.period_from_path) == "2001-2005"
    assert one(spark, "/d/pi_1997-2001.sqlite", text.period_from_path) == "1997-2001"


def test_empty_document_keeps_one_token_row(spark):
    docs = spark.createDataFrame([(1, ".,;"), (2, "Ala ma 3.5%")], "ID int, t string")
    rows = [tuple(r) for r in token_rows(docs, ["ID"], "t").orderBy("ID", "pos").collect()]
    assert rows == [(1, None, ""), (2, 0, "Ala"), (2, 1, "ma"), (2, 2, "3.5"), (2, 3, "%")]


def test_clean_array_equals_clean_rows(spark):
    docs = spark.createDataFrame([(1, "Minister i rok 12, Ustawa 1.5 o VAT; a1 % ustawa")],
                                 "ID int, t string")
    inside = docs.select(clean_lemma_array(F.col("t"))).first()[0]
    rows = clean_tokens(token_rows(docs, ["ID"], "t").withColumn("TAGGED", F.lower("ORG")))
    assert inside == [r.TAGGED for r in rows.orderBy("pos").collect()]
    assert inside == ["ustawa", "vat", "a1", "ustawa"]


def test_outside_lemmatiser(spark):
    tokens = spark.createDataFrame([("Psy",), (None,)], "ORG string")
    rows = lemmatise_with(tokens, lambda w: w.lower()[:2]).collect()
    assert [r.TAGGED for r in rows] == ["ps", None]


def test_long_addresses_and_numbers(spark):
    """Patterns match a megabyte without recursion."""
    from pyspark.sql import functions as F

    from lexalia.functions.text import clean_text, tokenise

    row = spark.range(1).select(
        F.length(clean_text(F.concat(F.lit("x http://"), F.repeat(F.lit("a"), 1_000_000), F.lit(" y")))),
        F.size(tokenise(F.repeat(F.lit("12,"), 500_000)))).first()
    assert tuple(row) == (4, 1)
