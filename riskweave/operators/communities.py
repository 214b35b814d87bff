"""Dense groups of accounts: core numbers by falling h-indices, and the connected groups of a core."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.graph import connected, laid_out_edges, nodes
from riskweave.operators.skew import spread_join
from riskweave.runtime import cut, partitions


def partner_links(e: DataFrame, min_payments: int = 1) -> DataFrame:
    """(src, dst) in both directions for every two accounts with ``min_payments`` payments between them or more.

    The direction of the payments does not count, nor do payments of an account to itself.
    """
    pairs = (
        e.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_payments)
    )
    both = F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))
    return pairs.select(F.inline(both))


def core_numbers(e: DataFrame, min_payments: int = 1, rows_per_task: int = 5_000_000) -> DataFrame:
    """(node, core) of every account: the greatest k such that it is in a group in which all have k partners.

    The core number is the fixed point of the h-index: from its number of partners, every account takes
    the greatest h such that h partners have a value of h or more, until no value falls. All
    k fall at once, so the rounds do not grow with the highest core number (peeling takes a round or more for
    each); they never exceed those of peeling. The links are stored once by
    (src, part), a source with many of them in several parts, and are not shuffled
    in a round: values are sent to the parts of their links, and only counts by partner and
    value are shuffled, of values below the partner's number of partners (others do not limit it).
    There is no cap on the rounds; one number a round reaches the driver.
    """
    spark = e.sparkSession
    links = cut(partner_links(e, min_payments))
    degree = cut(links.groupBy("src").agg(F.count("*").alias("deg")))
    limits = degree.select(F.col("src").alias("dst"), F.col("deg").alias("limit"))
    laid = laid_out_edges(spread_join(links, limits, ["dst"], "limit", "src", rows_per_task), degree, rows_per_task, ["limit"])
    parts = F.ceil(F.col("deg") / F.lit(rows_per_task)).cast("int")
    start = degree.select(F.col("src").alias("node"), "deg", F.col("deg").alias("core"), parts.alias("parts"))
    state = cut(start.repartition(partitions(spark), "node"), keep_layout=True)
    total, before = _total(state), None
    while total != before:
        state = cut(_fallen(laid, state), keep_layout=True)
        before, total = total, _total(state)
    return nodes(e).join(state.select("node", "core"), "node", "left").fillna(0, ["core"])


def _total(state: DataFrame) -> int:
    return state.agg(F.coalesce(F.sum("core"), F.lit(0))).first()[0]


def _fallen(laid: DataFrame, state: DataFrame) -> DataFrame:
    """The state with the h-index of the partners' values in place of each value."""
    sent = state.select(F.col("node").alias("src"), "core", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"))
    low = laid.join(sent, ["src", "_part"]).filter(F.col("core") < F.col("limit"))
    counts = low.groupBy(F.col("dst").alias("node"), "limit", "core").agg(F.count("*").alias("_n"))
    # Partners with less than a value of the list, and with less than any above it.
    up_to = F.sum("_n").over(Window.partitionBy("node").orderBy("core"))
    ranked = counts.withColumn("_up_to", up_to)
    below = F.greatest(F.least("core", F.col("limit") - (F.col("_up_to") - F.col("_n"))), F.lit(0))
    found = ranked.groupBy("node").agg(F.max(below).alias("_below"), F.max("_up_to").alias("_low"))
    stay = state.join(found.hint("shuffle_merge"), "node", "left")
    value = F.coalesce(F.greatest("_below", F.col("deg") - F.col("_low")), F.col("deg"))
    return stay.select("node", "deg", value.alias("core"), "parts")


def dense_communities(e: DataFrame, k: int, min_payments: int = 1, rows_per_task: int = 5_000_000) -> DataFrame:
    """(node, core, community) of the accounts with a core number of ``k`` or more.

    A community is a connected group of such accounts, named by its least id:
    each of its accounts has at least ``k`` partners inside.
    """
    cores = cut(core_numbers(e, min_payments, rows_per_task).filter(F.col("core") >= k))
    links = partner_links(e, min_payments).filter("src < dst")
    # Two joins by account; partners of a hub are spread by the adaptive skew join.
    inside = links.join(cores.select(F.col("node").alias("src")), "src", "left_semi").join(
        cores.select(F.col("node").alias("dst")), "dst", "left_semi"
    )
    groups = connected(inside)
    return cores.join(groups, "node", "left").select("node", "core", F.coalesce("component", "node").alias("community"))
