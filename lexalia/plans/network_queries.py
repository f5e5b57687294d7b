"""Author networks: edges, degrees, parties, communities, centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexalia.operators import network as net
from lexalia.operators.centrality import betweenness, closeness
from lexalia.operators.communities import find_communities
from lexalia.operators.ranking import zscore_within
from lexalia.operators.tokens import clean_lemma_array
from lexalia.plans import corpus as base
from lexalia.plans.registry import query
from lexalia.session import cut_lineage
from lexalia.sources.tables import load

BY = ["period"]
LANGS = ["de", "en", "es", "fr"]


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return base.corpus(spark, folder).filter(F.col("party").isNotNull())


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lemma counts per author; a text's lemmas are counted where the text is read."""
    words = _known(spark, folder).select(
        "period", F.col("AUTHOR_CLEAN").alias("AUTHOR"),
        F.explode(clean_lemma_array(F.col("CONTENT"))).alias("TAGGED"))
    return net.group_terms(words, BY, "AUTHOR")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    weights = net.group_tfidf(cut_lineage(_counts(spark, folder), "counts"), BY, "AUTHOR")
    return net.text_edges(cut_lineage(weights, "weights"), BY, "AUTHOR")


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    """All edges of every period."""
    return cut_lineage(_edges(spark, folder), "graph")


def _parties(spark: SparkSession, folder: str) -> DataFrame:
    return _known(spark, folder).select(
        "period", F.col("AUTHOR_CLEAN").alias("name"), "party").distinct()


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


COUNTS_SQL = f"""{base.CLEAN_SQL},
counts AS (SELECT period, "AUTHOR_CLEAN" AS "AUTHOR", "TAGGED" AS lemma, count(*) AS n
           FROM clean WHERE party IS NOT NULL GROUP BY ALL)"""
WEIGHTS_SQL = f"""{COUNTS_SQL},
g AS (SELECT period, count(DISTINCT "AUTHOR") AS groups FROM counts GROUP BY period),
weights AS (SELECT period, "AUTHOR", lemma, n, tf, df, ln(groups / df) AS idf,
              tf * ln(groups / df) AS w
  FROM (SELECT *, n / sum(n) OVER (PARTITION BY period, "AUTHOR") AS tf,
          count(*) OVER (PARTITION BY period, lemma) AS df FROM counts)
  JOIN g USING (period))"""
EDGES_SQL = f"""{WEIGHTS_SQL},
edges AS (SELECT a.period, a."AUTHOR" AS src, b."AUTHOR" AS dst, sum(a.w * b.w) AS weight
  FROM weights a JOIN weights b ON a.period = b.period AND a.lemma = b.lemma
   AND a."AUTHOR" < b."AUTHOR" WHERE a.w > 0 GROUP BY ALL)"""
GRAPH_SQL = f"""{EDGES_SQL},
graph AS (SELECT period, src, dst, weight FROM edges)"""
PARTY_SQL = """parties AS (SELECT DISTINCT period, "AUTHOR_CLEAN" AS name, party FROM corpus
  WHERE party IS NOT NULL)"""


@query("group_terms", f'WITH {COUNTS_SQL} SELECT period, "AUTHOR", lemma, n FROM counts')
def group_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _counts(spark, folder)


@query("group_tfidf", f"""WITH {WEIGHTS_SQL}
SELECT period, "AUTHOR", lemma, n, df, round(tf, 12) AS tf, round(idf, 9) AS idf,
       round(w, 12) AS w FROM weights""")
def group_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    weights = net.group_tfidf(cut_lineage(_counts(spark, folder), "counts"), BY, "AUTHOR")
    return _rounded(_rounded(weights, "tf", "w", digits=12), "idf").select(
        "period", "AUTHOR", "lemma", "n", "df", "tf", "idf", "w")


@query("text_edges", f"""WITH {EDGES_SQL}
SELECT period, src, dst, round(weight, 12) AS weight FROM edges""")
def text_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_edges(spark, folder), "weight", digits=12)


@query("edges_simplified", f"""WITH {EDGES_SQL}, directed AS (
  SELECT period, src, dst, weight FROM edges UNION ALL SELECT period, dst, src, weight FROM edges
  UNION ALL SELECT period, src, src, weight FROM edges)
SELECT period, least(src, dst) AS src, greatest(src, dst) AS dst, round(sum(weight), 12) AS weight
FROM directed WHERE src <> dst GROUP BY ALL""")
def edges_simplified(spark: SparkSession, folder: str) -> DataFrame:
    """Both directions and loops, merged back into single edges."""
    edges = _edges(spark, folder)
    ends = F.explode(F.array(F.struct("src", "dst"),
                             F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
                             F.struct("src", F.col("src").alias("dst")))).alias("e")
    directed = edges.select("period", ends, "weight").select("period", "e.*", "weight")
    return _rounded(net.simplify_edges(directed, BY), "weight", digits=12)


@query("network_vertices", f"""WITH {base.CORPUS_SQL}, {PARTY_SQL},
v AS (SELECT period, "AUTHOR_CLEAN" AS name, count(*) AS ip FROM corpus
      WHERE party IS NOT NULL GROUP BY ALL)
SELECT period, name, ip, party, ip > quantile_cont(ip, 0.9) OVER (PARTITION BY period) AS show_label
FROM v LEFT JOIN parties USING (period, name)""")
def network_vertices(spark: SparkSession, folder: str) -> DataFrame:
    vertices = net.vertex_table(_known(spark, folder), BY, "AUTHOR_CLEAN",
                                _parties(spark, folder))
    return net.labelled_vertices(vertices, BY).select(
        "period", "name", "ip", "party", "show_label")


@query("edge_cutoff", f"""WITH {EDGES_SQL}
SELECT period, round(quantile_cont(weight, 0.5), 12) AS q50,
       round(quantile_cont(weight, 0.9), 12) AS q90 FROM edges GROUP BY period""")
def edge_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    edges = cut_lineage(_edges(spark, folder), "edges")
    return _rounded(net.edge_cutoffs(edges, BY, {"q50": 0.5, "q90": 0.9}), "q50", "q90", digits=12)


@query("backbone_edges", f"""WITH {EDGES_SQL},
ends AS (SELECT period, src AS name, weight FROM edges
         UNION ALL SELECT period, dst, weight FROM edges),
s AS (SELECT period, name, sum(weight) AS s, count(*) AS k FROM ends GROUP BY ALL),
p AS (SELECT e.period, src, dst, weight,
        least(pow(1 - weight / a.s, a.k - 1), pow(1 - weight / b.s, b.k - 1)) AS p_value
      FROM edges e JOIN s a ON a.period = e.period AND a.name = src
      JOIN s b ON b.period = e.period AND b.name = dst)
SELECT period, src, dst, round(weight, 12) AS weight, round(p_value, 9) AS p_value
FROM p WHERE p_value < 0.25""")
def backbone_edges(spark: SparkSession, folder: str) -> DataFrame:
    kept = net.backbone(cut_lineage(_edges(spark, folder), "edges"), BY, 0.25)
    return _rounded(_rounded(kept, "weight", digits=12), "p_value")


@query("degree_summary", f"""WITH {GRAPH_SQL},
d AS (SELECT period, name, count(*) AS degree FROM
  (SELECT period, src AS name FROM graph UNION ALL SELECT period, dst FROM graph) GROUP BY ALL)
SELECT period, round(mean_degree, 9) AS mean_degree, max_degree, name
FROM (SELECT *, avg(degree) OVER (PARTITION BY period) AS mean_degree,
        max(degree) OVER (PARTITION BY period) AS max_degree FROM d)
WHERE degree = max_degree""")
def degree_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(net.degree_summary(_graph(spark, folder), BY), "mean_degree")


_WITH_PARTY_SQL = f"""{EDGES_SQL}, {PARTY_SQL},
pe AS (SELECT e.period, src, dst, weight, a.party AS party1, b.party AS party2,
         (b.party <> a.party)::INTEGER AS diff_party
  FROM edges e LEFT JOIN parties a ON a.period = e.period AND a.name = src
  LEFT JOIN parties b ON b.period = e.period AND b.name = dst)"""


@query("top_edges", f"""WITH {_WITH_PARTY_SQL},
r AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY weight DESC) AS rk FROM pe)
SELECT period, src AS member1, party1, dst AS member2, party2, round(weight, 12) AS weight
FROM r WHERE rk <= 3""")
def top_edges(spark: SparkSession, folder: str) -> DataFrame:
    best = net.top_edges(cut_lineage(_edges(spark, folder), "edges"), BY, 3)
    named = net.with_parties(best, BY, _parties(spark, folder))
    return _rounded(named, "weight", digits=12).select(
        "period", F.col("src").alias("member1"), "party1", F.col("dst").alias("member2"),
        "party2", "weight")


def _mix_sql(suffix: str, group: str) -> str:
    return f"""round(coalesce(avg(weight) FILTER ({group}), 0), 12) AS mw_{suffix},
  round(coalesce(stddev_samp(weight) FILTER ({group}), 0), 12) AS sdw_{suffix},
  count(weight) FILTER ({group}) AS count_{suffix}"""


@query("edge_party_mix", f"""WITH {_WITH_PARTY_SQL}
SELECT period, {_mix_sql('0', 'diff_party = 0')}, {_mix_sql('1', 'diff_party = 1')},
  {_mix_sql('na', 'diff_party IS NULL')} FROM pe GROUP BY period""")
def edge_party_mix(spark: SparkSession, folder: str) -> DataFrame:
    named = net.with_parties(_edges(spark, folder), BY, _parties(spark, folder))
    columns = [f"{label}_{suffix}" for label in ("mw", "sdw") for suffix in ("0", "1", "na")]
    return _rounded(net.edge_party_mix(named, BY), *columns, digits=12)


# --- communities -----------------------------------------------------------

@query("communities")
def communities(spark: SparkSession, folder: str) -> DataFrame:
    return find_communities(_graph(spark, folder), BY, _parties(spark, folder))


@query("community_sizes", """
SELECT count(*) AS n_groups, min(n_m) AS min_mem, max(n_m) AS max_mem
FROM (SELECT label, count(*) AS n_m FROM embeddings GROUP BY label)""")
def community_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return net.community_sizes(load(spark, folder, "embeddings"), [], "label")


@query("community_members", """
SELECT label, count(*) OVER (PARTITION BY label) AS n_members,
       row_number() OVER (PARTITION BY label ORDER BY vec_id::VARCHAR) AS position,
       vec_id::VARCHAR AS member FROM embeddings""")
def community_members(spark: SparkSession, folder: str) -> DataFrame:
    return net.community_members(load(spark, folder, "embeddings"), [], "label", "vec_id")


def _given_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Authors with their language as community; an unknown party stays NULL."""
    return base.corpus(spark, folder).select(
        "period", F.col("AUTHOR_CLEAN").alias("name"), "party", "lang").distinct()


_GIVEN_SQL = f"""{base.CORPUS_SQL},
cells AS (SELECT period, lang, party, count(*) AS member_count FROM
  (SELECT DISTINCT period, "AUTHOR_CLEAN" AS name, party, lang FROM corpus) GROUP BY ALL)"""


def _wide_sql(value: str) -> str:
    cells = ", ".join(f"coalesce(any_value({value}) FILTER (lang = '{v}'), 0) AS {v}"
                      for v in LANGS)
    return f"SELECT period, party, {cells} FROM cells GROUP BY period, party"


@query("community_party_counts", f"WITH {_GIVEN_SQL} {_wide_sql('member_count')}")
def community_party_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = net.community_party_counts(_given_communities(spark, folder), BY, "lang")
    return net.crosstab(counts, BY, "party", "lang", LANGS, "member_count")


def _percent_sql(within: str) -> str:
    return f"""WITH {_GIVEN_SQL.replace('cells AS', 'raw AS')}, cells AS (
  SELECT *, round_even(100 * member_count / sum(member_count)
    OVER (PARTITION BY period, {within}), 0)::BIGINT AS mw FROM raw) {_wide_sql('mw')}"""


@query("community_party_pct", _percent_sql("lang"))
def community_party_pct(spark: SparkSession, folder: str) -> DataFrame:
    counts = net.community_party_counts(_given_communities(spark, folder), BY, "lang")
    return net.crosstab(net.party_percent(counts, BY, "lang"), BY, "party", "lang", LANGS, "mw")


@query("party_community_pct", _percent_sql("party"))
def party_community_pct(spark: SparkSession, folder: str) -> DataFrame:
    counts = net.community_party_counts(_given_communities(spark, folder), BY, "lang")
    return net.crosstab(net.party_percent(counts, BY, "party"), BY, "party", "lang", LANGS, "mw")


_WORDS_SQL = ", ".join(
    f"""coalesce(any_value(lemma) FILTER (period = '{p}'), '') AS "{p}" """
    for p in base.PERIODS)


@query("community_words", f"""WITH {COUNTS_SQL},
members AS (SELECT DISTINCT period, "AUTHOR_CLEAN" AS "AUTHOR", lang FROM corpus
            WHERE party IS NOT NULL),
used AS (SELECT period, lang, lemma, sum(n) AS n FROM counts JOIN members USING (period, "AUTHOR")
         GROUP BY ALL),
best AS (SELECT * FROM used QUALIFY rank() OVER (PARTITION BY period, lang ORDER BY n DESC) <= 10),
placed AS (SELECT period, lang, lemma,
             row_number() OVER (PARTITION BY period, lang ORDER BY lemma) AS position FROM best)
SELECT lang, position, {_WORDS_SQL} FROM placed GROUP BY lang, position""")
def community_words(spark: SparkSession, folder: str) -> DataFrame:
    members = _known(spark, folder).select(
        "period", F.col("AUTHOR_CLEAN").alias("AUTHOR"), "lang").distinct()
    words = net.community_words(_counts(spark, folder), members, BY, "AUTHOR", "lang")
    wide = words.groupBy("lang", "position").pivot("period", base.PERIODS).agg(F.first("lemma"))
    return wide.fillna("")


# --- centrality ------------------------------------------------------------

def _period_columns(scores: DataFrame, score: str) -> DataFrame:
    best = net.consistent_members(scores, "member", "period", score, base.PERIODS, 10)
    return best.select(
        "member", "mean_score", *[F.round(F.col(f"`{p}`"), 9).alias(p) for p in base.PERIODS])


_CLOSE_SQL = f"""WITH RECURSIVE {GRAPH_SQL},
arcs AS MATERIALIZED (SELECT period, src, dst FROM graph
  UNION ALL SELECT period, dst, src FROM graph),
reach AS (SELECT DISTINCT period, src AS s, src AS v, 0 AS d FROM arcs
  UNION SELECT r.period, r.s, a.dst, r.d + 1 FROM reach r
  JOIN arcs a ON a.period = r.period AND a.src = r.v WHERE r.d < 12),
dist AS (SELECT period, s, v, min(d) AS d FROM reach GROUP BY ALL),
c AS (SELECT period, s AS member, 1.0 / sum(d) AS closeness FROM dist WHERE d > 0 GROUP BY ALL),
z AS (SELECT period, member, (closeness - avg(closeness) OVER w) / nullif(stddev_samp(closeness)
        OVER w, 0) AS cc FROM c WINDOW w AS (PARTITION BY period)),
m AS (SELECT member, round(avg(cc), 9) AS mean_score FROM z GROUP BY member HAVING count(*) = 3),
best AS (SELECT * FROM m WHERE mean_score IS NOT NULL
         QUALIFY rank() OVER (ORDER BY mean_score DESC) <= 10)
SELECT member, mean_score, """ + ", ".join(
    f"""round(any_value(cc) FILTER (period = '{p}'), 9) AS "{p}" """ for p in base.PERIODS) + """
FROM best JOIN z USING (member) GROUP BY member, mean_score"""


@query("closeness_z", _CLOSE_SQL)
def closeness_z(spark: SparkSession, folder: str) -> DataFrame:
    scores = closeness(_graph(spark, folder), BY)
    return _period_columns(zscore_within(scores, "closeness", BY, "cc"), "cc")


# Walks of length k between two vertices; at their distance all walks are shortest paths.
_WALKS_SQL = ", ".join(
    ["w1 AS (SELECT period, src AS s, dst AS t, 1::DOUBLE AS n FROM arcs)"]
    + [f"""w{k} AS (SELECT w.period, s, dst AS t, sum(n) AS n FROM w{k - 1} w
       JOIN arcs a ON a.period = w.period AND a.src = w.t GROUP BY ALL)""" for k in range(2, 13)])
_ALL_WALKS_SQL = " UNION ALL ".join(
    f"SELECT period, s, t, {k} AS k, n FROM w{k}" for k in range(1, 13))

_BETWEEN_SQL = f"""WITH {GRAPH_SQL},
arcs AS MATERIALIZED (SELECT period, src, dst FROM graph
  UNION ALL SELECT period, dst, src FROM graph), {_WALKS_SQL},
sp AS MATERIALIZED (SELECT period, s, t, min(k) AS d, arg_min(n, k) AS sigma
  FROM ({_ALL_WALKS_SQL}) WHERE s <> t GROUP BY ALL),
b AS (SELECT x.period, x.t AS member, sum(x.sigma * y.sigma / p.sigma) / 2 AS b
  FROM sp x JOIN sp y ON y.period = x.period AND y.s = x.t
  JOIN sp p ON p.period = x.period AND p.s = x.s AND p.t = y.t AND p.d = x.d + y.d GROUP BY ALL),
f AS (SELECT v.period, name AS member, coalesce(b, 0) AS betweenness
  FROM (SELECT DISTINCT period, src AS name FROM arcs) v
  LEFT JOIN b ON b.period = v.period AND b.member = v.name),
z AS (SELECT period, member, (betweenness - avg(betweenness) OVER w)
        / nullif(stddev_samp(betweenness) OVER w, 0) AS cc
      FROM f WINDOW w AS (PARTITION BY period)),
{_CLOSE_SQL[_CLOSE_SQL.index("m AS (SELECT member"):]}"""


@query("betweenness_z", _BETWEEN_SQL)
def betweenness_z(spark: SparkSession, folder: str) -> DataFrame:
    scores = betweenness(_graph(spark, folder), BY)
    return _period_columns(zscore_within(scores, "betweenness", BY, "bc"), "bc")
