"""Rosters, author names and how well both match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexalia.functions.names import fix_lower_initial, party_short, short_name
from lexalia.operators import people
from lexalia.operators.ranking import top_n_with_ties
from lexalia.plans import corpus as base
from lexalia.plans.registry import query
from lexalia.sources.dictionaries import flatten_roster, replace_row
from lexalia.sources.tables import load

_GIVEN = ["Adam", "Ewa", "Łukasz", "Żaneta"]
_SECOND_PARTY = "Klub Poselski Drugi"


def _pick(values: list[str], key: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def _people(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as members: a short name and the way they sign."""
    key = F.col("c_custkey")
    given = _pick(_GIVEN, "c_custkey")
    surname = F.concat(F.lit("Nowak"), key,
                       F.when(key % 5 == 4, F.lit("-Lis")).otherwise(F.lit("")))
    first = F.when(key % 12 == 6, F.lit("łukasz")).otherwise(given)
    signed = (
        F.when(key % 5 == 1, F.concat_ws(" ", first, F.lit("Maria"), surname))
        .when(key % 5 == 2, F.concat(F.concat_ws(" ", first, surname), F.lit(" i Jan Drugi")))
        .when(key % 5 == 3, F.concat(F.lit("Poseł "), F.concat_ws(" ", first, surname)))
        .otherwise(F.concat_ws(" ", first, surname)))
    return load(spark, folder, "customer").select(
        "c_custkey", F.concat_ws(" ", given, surname).alias("member"), signed.alias("signed"),
        F.concat(F.lit("Klub Parlamentarny "), "c_mktsegment").alias("club"))


_PEOPLE_SQL = f"""
people AS (
  SELECT c_custkey, given || ' ' || surname AS member, 'Klub Parlamentarny ' || c_mktsegment AS club,
    CASE c_custkey % 5 WHEN 1 THEN first || ' Maria ' || surname
      WHEN 2 THEN first || ' ' || surname || ' i Jan Drugi'
      WHEN 3 THEN 'Poseł ' || first || ' ' || surname
      ELSE first || ' ' || surname END AS signed
  FROM (SELECT *, CASE WHEN c_custkey % 12 = 6 THEN 'łukasz' ELSE given END AS first
        FROM (SELECT *, ([{base.quoted(_GIVEN)}])[(c_custkey % 4) + 1] AS given,
                'Nowak' || c_custkey || CASE WHEN c_custkey % 5 = 4 THEN '-Lis' ELSE '' END
                AS surname FROM customer)))"""

_PERIOD_ROWS_SQL = "terms(i, period) AS (VALUES " + ", ".join(
    f"({i}, '{p}')" for i, p in enumerate(base.PERIODS)) + ")"

_ROSTER_SQL = f"""{_PEOPLE_SQL}, {_PERIOD_ROWS_SQL},
roster AS (
  SELECT member AS "AUTHOR", club AS ugr, period FROM people, terms
  WHERE (c_custkey + i) % 3 <> 0
  UNION ALL
  SELECT member, '{_SECOND_PARTY}', period FROM people, terms
  WHERE (c_custkey + i) % 3 <> 0 AND c_custkey % 97 = 0)"""


def _roster_json(spark: SparkSession, folder: str) -> DataFrame:
    """One ``period → party → [names]`` object per member."""
    key = F.col("c_custkey")
    clubs = F.when(key % 97 == 0, F.create_map(
        "club", F.array("member"), F.lit(_SECOND_PARTY), F.array("member"))
    ).otherwise(F.create_map("club", F.array("member")))
    listed = F.filter(F.array(*[
        F.struct(F.lit(p).alias("p"), ((key + i) % 3 != 0).alias("on"))
        for i, p in enumerate(base.PERIODS)]), lambda t: t["on"])
    periods = F.map_from_arrays(F.transform(listed, lambda t: t["p"]),
                                F.array_repeat(clubs, F.size(listed)))
    return _people(spark, folder).select(F.to_json(periods).alias("json"))


def _roster(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_roster(_roster_json(spark, folder))


@query("roster_flatten", f'WITH {_ROSTER_SQL} SELECT "AUTHOR", ugr, period FROM roster')
def roster_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return _roster(spark, folder)


@query("roster_duplicates", f"""WITH {_ROSTER_SQL},
n AS (SELECT period, "AUTHOR", count(*) AS c FROM roster GROUP BY ALL),
again AS (SELECT period, unnest(list_resize(["AUTHOR"], c - 1, "AUTHOR")) AS "AUTHOR"
          FROM n WHERE c > 1),
named AS (SELECT period, "AUTHOR" AS member_dup,
            row_number() OVER (PARTITION BY period ORDER BY "AUTHOR") AS position FROM again),
t AS (SELECT period, sum(c)::BIGINT AS n, count(*) AS uq FROM n GROUP BY period)
SELECT period, n, uq, n > uq AS any_duplicates, coalesce(position, 0) AS position,
       coalesce(member_dup, '') AS member_dup FROM t LEFT JOIN named USING (period)""")
def roster_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return people.roster_duplicates(_roster(spark, folder))


@query("roster_fixed", f"""WITH {_ROSTER_SQL}
SELECT "AUTHOR", ugr, period FROM roster
WHERE NOT (ugr = '{_SECOND_PARTY}' AND "AUTHOR" LIKE 'Ewa %' AND period = '1997-2001')
UNION ALL
SELECT "AUTHOR", 'Poprawiony', period FROM roster
WHERE ugr = '{_SECOND_PARTY}' AND "AUTHOR" LIKE 'Ewa %' AND period = '1997-2001'""")
def roster_fixed(spark: SparkSession, folder: str) -> DataFrame:
    roster = _roster(spark, folder)
    wrong = ((F.col("ugr") == _SECOND_PARTY) & F.col("AUTHOR").startswith("Ewa ")
             & (F.col("period") == "1997-2001"))
    right = roster.filter(wrong).withColumn("ugr", F.lit("Poprawiony"))
    return replace_row(roster, wrong, right)


@query("author_regex_counts", f"""WITH {_PEOPLE_SQL}
SELECT signed AS "AUTHOR", count(*) AS n FROM people
WHERE regexp_matches(signed, '(Ewa Nowak)|(Maria Nowak1)') GROUP BY signed""")
def author_regex_counts(spark: SparkSession, folder: str) -> DataFrame:
    named = _people(spark, folder).filter(F.col("signed").rlike("(Ewa Nowak)|(Maria Nowak1)"))
    return named.groupBy(F.col("signed").alias("AUTHOR")).agg(F.count("*").alias("n"))


# --- orders as signed documents --------------------------------------------

def _signed_docs(spark: SparkSession, folder: str, fixed: bool = False) -> DataFrame:
    """Orders as documents: period, ID and the signature of their customer."""
    names = _people(spark, folder)
    signed = fix_lower_initial(F.col("signed"), "ł") if fixed else F.col("signed")
    authors = names.select(F.col("c_custkey").alias("o_custkey"), signed.alias("AUTHOR"))
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ID"), "o_custkey",
        _pick(base.PERIODS, "o_orderkey").alias("period"))
    return orders.join(authors, "o_custkey").select("period", "ID", "AUTHOR")


_DOCS_SQL = f"""
signed_docs AS (SELECT o_orderkey AS "ID",
    ([{base.quoted(base.PERIODS)}])[(o_orderkey % 3) + 1] AS period, signed AS "AUTHOR",
    regexp_replace(signed, '^ł', 'Ł') AS fixed,
    CASE WHEN c_custkey % 12 = 6 AND c_custkey % 5 <> 3 THEN 1 ELSE 0 END AS was_lower, member
  FROM orders JOIN people ON o_custkey = c_custkey)"""


@query("unmatched_author_rate", f"""WITH {_ROSTER_SQL}, {_DOCS_SQL}
SELECT d.period, count(DISTINCT d."AUTHOR") AS n_mem, count(*) AS "count",
  round(avg((ugr IS NULL)::INTEGER), 9) AS without_party,
  count(DISTINCT CASE WHEN ugr IS NULL THEN d."AUTHOR" END) AS n_mem_without_party,
  round(count(DISTINCT CASE WHEN ugr IS NULL THEN d."AUTHOR" END)
        / count(DISTINCT d."AUTHOR"), 9) AS without_part_count
FROM signed_docs d LEFT JOIN roster r ON d."AUTHOR" = r."AUTHOR" AND d.period = r.period
GROUP BY d.period""")
def unmatched_author_rate(spark: SparkSession, folder: str) -> DataFrame:
    found = people.unmatched_rates(_signed_docs(spark, folder), _roster(spark, folder))
    return found.withColumns({c: F.round(c, 9) for c in ("without_party", "without_part_count")})


@query("unmatched_author_head", f"""WITH {_ROSTER_SQL}, {_DOCS_SQL}
SELECT d."AUTHOR", ugr, count(*) AS k
FROM signed_docs d LEFT JOIN roster r ON d."AUTHOR" = r."AUTHOR" AND d.period = r.period
WHERE ugr IS NULL GROUP BY ALL ORDER BY d."AUTHOR" LIMIT 6""")
def unmatched_author_head(spark: SparkSession, folder: str) -> DataFrame:
    return people.unmatched_authors(_signed_docs(spark, folder), _roster(spark, folder))


_SHORT_SQL = """CASE WHEN regexp_matches({c}, '^ł') THEN NULL
  WHEN c_custkey % 12 = 6 AND c_custkey % 5 = 3 THEN NULL ELSE member END"""


@query("author_short_name", f"""WITH {_PEOPLE_SQL}
SELECT c_custkey, signed, {_SHORT_SQL.format(c='signed')} AS stripped,
  CASE WHEN c_custkey % 12 = 6 AND c_custkey % 5 = 3 THEN NULL
       WHEN regexp_matches(signed, '^ł') THEN regexp_replace(member, '^[^ ]+', 'Łukasz')
       ELSE member END AS stripped_fixed
FROM people""")
def author_short_name(spark: SparkSession, folder: str) -> DataFrame:
    fixed = fix_lower_initial(F.col("signed"), "ł")
    return _people(spark, folder).select(
        "c_custkey", "signed", short_name(F.col("signed")).alias("stripped"),
        short_name(fixed).alias("stripped_fixed"))


def _mapping(spark: SparkSession, folder: str, shorten: bool = True) -> DataFrame:
    return people.author_map(_signed_docs(spark, folder, fixed=True), _roster(spark, folder),
                             shorten)


_MAPPED_SQL = f"""{_ROSTER_SQL}, {_DOCS_SQL},
shortened AS (SELECT period, "ID", fixed AS "AUTHOR",
    CASE WHEN regexp_matches(fixed, '^Poseł ł') THEN NULL
         WHEN was_lower = 1 THEN regexp_replace(member, '^[^ ]+', 'Łukasz')
         ELSE member END AS stripped FROM signed_docs),
names AS (SELECT DISTINCT "AUTHOR", period, stripped FROM shortened),
mapping AS (SELECT DISTINCT n."AUTHOR", n.period, n.stripped, a.ugr,
    regexp_replace(b.ugr, '^(Klub Parlamentarny)|(Koło Parlamentarne)|(Koło Poselskie)|(Klub Poselski)',
                   'KP', 'g') AS ugr2
  FROM names n LEFT JOIN roster a ON a."AUTHOR" = n."AUTHOR" AND a.period = n.period
  LEFT JOIN roster b ON b."AUTHOR" = n.stripped AND b.period = n.period)"""


@query("author_match_before_after", f"""WITH {_MAPPED_SQL}
SELECT s.period, count(DISTINCT s."AUTHOR") AS count_original,
  count(DISTINCT m.stripped) + max((m.stripped IS NULL)::INTEGER) AS count_clean,
  count(*) AS count_int, round(avg((ugr IS NULL)::INTEGER), 9) AS perc_without_original,
  round(avg((ugr2 IS NULL)::INTEGER), 9) AS perc_without_clean
FROM shortened s LEFT JOIN mapping m ON m."AUTHOR" = s."AUTHOR" AND m.period = s.period
GROUP BY s.period""")
def author_match_before_after(spark: SparkSession, folder: str) -> DataFrame:
    rates = people.match_rates(_signed_docs(spark, folder, fixed=True), _mapping(spark, folder))
    return rates.withColumns({c: F.round(c, 9) for c in (
        "perc_without_original", "perc_without_clean")})


@query("attach_authors", f"""WITH {_MAPPED_SQL}
SELECT s.period, "ID", s."AUTHOR", m.stripped AS "AUTHOR_CLEAN", m.ugr2 AS party
FROM shortened s LEFT JOIN (SELECT DISTINCT "AUTHOR", period, stripped, ugr2 FROM mapping) m
  ON m."AUTHOR" = s."AUTHOR" AND m.period = s.period""")
def attach_authors(spark: SparkSession, folder: str) -> DataFrame:
    docs = _signed_docs(spark, folder, fixed=True)
    return people.attach_authors(docs, _mapping(spark, folder)).select(
        "period", "ID", "AUTHOR", "AUTHOR_CLEAN", "party")


_CLUBS = ["Klub Parlamentarny ", "Koło Parlamentarne ", "Koło Poselskie ", "Klub Poselski ",
          "Inny Klub Parlamentarny "]


@query("party_prefix", f"""
SELECT c_custkey, regexp_replace(([{base.quoted(_CLUBS)}])[(c_custkey % 5) + 1] || c_mktsegment,
  '^(Klub Parlamentarny)|(Koło Parlamentarne)|(Koło Poselskie)|(Klub Poselski)', 'KP', 'g')
  AS party FROM customer""")
def party_prefix(spark: SparkSession, folder: str) -> DataFrame:
    named = F.concat(_pick(_CLUBS, "c_custkey"), F.col("c_mktsegment"))
    return load(spark, folder, "customer").select("c_custkey", party_short(named).alias("party"))


@query("members_all_periods", f"""WITH {base.CORPUS_SQL},
m AS (SELECT "AUTHOR_CLEAN", count(DISTINCT period) AS dist_period, count(*) AS n_int
      FROM corpus WHERE party IS NOT NULL GROUP BY "AUTHOR_CLEAN")
SELECT * FROM m WHERE dist_period = 3 QUALIFY rank() OVER (ORDER BY n_int DESC) <= 5""")
def members_all_periods(spark: SparkSession, folder: str) -> DataFrame:
    members = people.members_in_all_periods(base.corpus(spark, folder), len(base.PERIODS))
    return top_n_with_ties(members, 5, "n_int").orderBy(F.desc("n_int"), "AUTHOR_CLEAN")
