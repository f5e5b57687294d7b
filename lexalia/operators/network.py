"""Networks of groups (authors) joined by the vocabulary they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexalia.operators.aggregates import exact_quantiles, numbered_values
from lexalia.operators.pairs import pairs_sharing_key
from lexalia.operators.ranking import percent_share, top_n_with_ties, with_group_stats


def group_terms(tokens: DataFrame, by: list[str], group: str, lemma: str = "TAGGED"
                ) -> DataFrame:
    """``by, group, lemma, n``: how often each group uses each lemma."""
    return tokens.groupBy(*by, group, F.col(lemma).alias("lemma")).agg(
        F.count("*").alias("n"))


def group_tfidf(counts: DataFrame, by: list[str], group: str) -> DataFrame:
    """``tf = n / all words of the group``, ``idf = ln(groups / groups using it)``."""
    totals = counts.groupBy(*by, group).agg(F.sum("n").alias("_total"))
    groups = totals.groupBy(*by).agg(F.count("*").alias("_groups"))
    usage = counts.groupBy(*by, "lemma").agg(F.count("*").alias("df"))
    tf = F.col("n") / F.col("_total")
    idf = F.log(F.col("_groups") / F.col("df"))
    return (
        counts.join(usage, [*by, "lemma"]).join(totals, [*by, group]).join(groups, by)
        .withColumn("tf", tf).withColumn("idf", idf)
        .withColumn("w", F.col("tf") * F.col("idf"))
        .drop("_total", "_groups")
    )


def text_edges(weights: DataFrame, by: list[str], group: str, block_rows: int = 2000
               ) -> DataFrame:
    """``by, src < dst, weight``: sum over shared lemmas of the weight product.

    A lemma used by one group makes no edge and one used by all weighs zero,
    so leaving both out changes nothing.
    """
    useful = weights.filter((F.col("df") > 1) & (F.col("w") > 0))
    met = pairs_sharing_key(useful, [*by, "lemma"], group, ["w"], block_rows)
    return met.groupBy(*by, F.col("id_a").alias("src"), F.col("id_b").alias("dst")).agg(
        F.sum(F.col("w_a") * F.col("w_b")).alias("weight"))


def simplify_edges(edges: DataFrame, by: list[str]) -> DataFrame:
    """Undirected: drop loops, sum the weights of parallel edges."""
    return (
        edges.filter(F.col("src") != F.col("dst"))
        .groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .agg(F.sum("weight").alias("weight"))
    )


def vertex_table(docs: DataFrame, by: list[str], group: str, party: DataFrame) -> DataFrame:
    """``by, name, ip, party``: documents per group, and its party.

    ``party`` has one ``by, name, party`` row per group.
    """
    counts = docs.groupBy(*by, F.col(group).alias("name")).agg(F.count("*").alias("ip"))
    return counts.join(party, [*by, "name"], "left")


def both_directions(edges: DataFrame, by: list[str], *extra: str) -> DataFrame:
    """Every undirected edge once from each end, in a single scan."""
    ends = F.explode(F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("_e")
    return edges.select(*by, ends, *extra).select(*by, "_e.src", "_e.dst", *extra)


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    return both_directions(edges, by).groupBy(*by, F.col("src").alias("name")).agg(
        F.count("*").alias("degree"))


def degree_summary(edges: DataFrame, by: list[str]) -> DataFrame:
    """Mean and highest degree per group, with who holds it (ties kept)."""
    known = degrees(edges, by)
    stats = known.groupBy(*by).agg(F.avg("degree").alias("mean_degree"),
                                   F.max("degree").alias("max_degree"))
    return (stats.join(known, by).filter(F.col("degree") == F.col("max_degree"))
            .select(*by, "mean_degree", "max_degree", "name"))


def top_edges(edges: DataFrame, by: list[str], n: int | None = 3) -> DataFrame:
    """Heaviest edges per group, ties kept; ``None`` keeps all."""
    return edges if n is None else top_n_with_ties(edges, n, "weight", by)


def with_parties(edges: DataFrame, by: list[str], party: DataFrame) -> DataFrame:
    """Attach ``party1`` and ``party2`` to the ends of each edge."""
    one = party.select(*by, F.col("name").alias("src"), F.col("party").alias("party1"))
    two = party.select(*by, F.col("name").alias("dst"), F.col("party").alias("party2"))
    return edges.join(one, [*by, "src"], "left").join(two, [*by, "dst"], "left")


def edge_party_mix(edges: DataFrame, by: list[str]) -> DataFrame:
    """Mean, spread and count of edge weights, in one row.

    Inside parties (``_0``), across them (``_1``), and where a party is unknown (``_na``).
    """
    other = F.col("party2") != F.col("party1")
    groups = {"0": ~other, "1": other, "na": other.isNull()}
    stats = {"mw": F.avg, "sdw": F.stddev_samp, "count": F.count}
    return edges.groupBy(*by).agg(*[
        F.coalesce(stat(F.when(group, F.col("weight"))), F.lit(0)).alias(f"{label}_{suffix}")
        for label, stat in stats.items() for suffix, group in groups.items()])


def edge_cutoffs(edges: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    return exact_quantiles(edges, by, "weight", probs)


def heavy_edges(edges: DataFrame, by: list[str], prob: float) -> DataFrame:
    """Edges at or above the group's quantile of weights."""
    cut = edge_cutoffs(edges, by, {"_cut": prob})
    return edges.join(cut, by).filter(F.col("weight") >= F.col("_cut")).drop("_cut")


def labelled_vertices(vertices: DataFrame, by: list[str], column: str = "ip",
                      prob: float = 0.9) -> DataFrame:
    """Flag the vertices above the quantile of ``column``."""
    cut = exact_quantiles(vertices, by, column, {"_cut": prob})
    return (vertices.join(cut, by)
            .withColumn("show_label", F.col(column) > F.col("_cut")).drop("_cut"))


def backbone(edges: DataFrame, by: list[str], alpha: float = 0.25) -> DataFrame:
    """Disparity filter: keep an edge that is significant from either end."""
    ends = both_directions(edges, by, "weight")
    stats = ends.groupBy(*by, F.col("src").alias("name")).agg(
        F.sum("weight").alias("s"), F.count("*").alias("k"))
    joined = edges
    for end in ("src", "dst"):
        side = stats.select(*by, F.col("name").alias(end), F.col("s").alias(f"_s_{end}"),
                            F.col("k").alias(f"_k_{end}"))
        joined = joined.join(side, [*by, end])

    def p_value(end: str) -> Column:
        return F.pow(1 - F.col("weight") / F.col(f"_s_{end}"), F.col(f"_k_{end}") - 1)

    return (joined.withColumn("p_value", F.least(p_value("src"), p_value("dst")))
            .filter(F.col("p_value") < alpha)
            .select(*by, "src", "dst", "weight", "p_value"))


def community_sizes(members: DataFrame, by: list[str], community: str) -> DataFrame:
    """Number of communities, smallest and largest."""
    sizes = members.groupBy(*by, community).agg(F.count("*").alias("n_m"))
    return sizes.groupBy(*by).agg(F.count("*").alias("n_groups"), F.min("n_m").alias("min_mem"),
                                  F.max("n_m").alias("max_mem"))


def community_members(members: DataFrame, by: list[str], community: str, name: str) -> DataFrame:
    """``by, community, n_members, position, member``: members of each community in order."""
    listed = numbered_values(members, [*by, community], name, "member")
    return with_group_stats(listed, [*by, community], n_members=F.count("*"))


def community_party_counts(members: DataFrame, by: list[str], community: str) -> DataFrame:
    """Long form: members per community and party (NULL party kept)."""
    return members.groupBy(*by, community, "party").agg(F.count("*").alias("member_count"))


def party_percent(counts: DataFrame, by: list[str], within: str) -> DataFrame:
    """Percent of each community (or party, after ``within``) per cell."""
    return percent_share(counts, "member_count", [*by, within], "mw")


def crosstab(counts: DataFrame, by: list[str], row: str, column: str, values: list,
             cell: str, prefix: str = "") -> DataFrame:
    """One column per listed value, 0 where a combination does not occur.

    A value that is not listed stops the query, as it would be lost.
    """
    unlisted = F.raise_error(F.concat(F.lit(f"value of {column} without a column: "),
                                      F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))
    known = F.when(F.col(column).isin(values), F.col(cell)).otherwise(unlisted)
    wide = counts.groupBy(*by, row).pivot(column, values).agg(F.first(known))
    named = [F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}{v}") for v in values]
    return wide.select(*by, row, *named)


def community_words(counts: DataFrame, members: DataFrame, by: list[str], group: str,
                    community: str, n: int = 10) -> DataFrame:
    """``by, community, position, lemma``: most used lemmas of each community, ties kept."""
    used = counts.join(members.select(*by, group, community), [*by, group]).groupBy(
        *by, community, "lemma").agg(F.sum("n").alias("n"))
    best = top_n_with_ties(used, n, "n", [*by, community])
    return numbered_values(best, [*by, community], "lemma", "lemma")


def consistent_members(scores: DataFrame, member: str, period: str, score: str,
                       periods: list[str], top: int) -> DataFrame:
    """Members scored in every period, best mean first, one column per period.

    A mean that ties with the last place is kept.
    """
    stats = scores.groupBy(member).agg(F.count("*").alias("_n"), F.avg(score).alias("mean_score"))
    full = stats.filter(F.col("_n") == len(periods)).drop("_n")
    rounded = full.withColumn("mean_score", F.round("mean_score", 9))
    best = top_n_with_ties(rounded, top, "mean_score")
    wide = (scores.join(best.select(member, "mean_score"), member)
            .groupBy(member, "mean_score").pivot(period, periods).agg(F.first(score)))
    return wide
