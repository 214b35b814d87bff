"""Account graph: edges, node features, PageRank, components, triangles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalars import account_column, amount_of, event_micros, number_or, ratio
from riskweave.operators.skew import spread_join
from riskweave.runtime import cut, materialise, partitions


def edges(tx: DataFrame) -> DataFrame:
    """One row per transaction: src, dst, amount, cross, fraud, ts.

    Rows without a sender or receiver are no edges.
    """
    src, dst = account_column(tx, "sender"), account_column(tx, "receiver")
    return tx.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col(src).cast("string").alias("src"),
        F.col(dst).cast("string").alias("dst"),
        amount_of(tx).alias("amount"),
        number_or(tx, "is_cross_border", 0.0).alias("cross"),
        number_or(tx, "is_fraud", 0.0).alias("fraud"),
        event_micros(tx).alias("ts"),
    ).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())


def edge_report(tx: DataFrame) -> DataFrame:
    """Edges kept and rows dropped for a missing account id."""
    src, dst = account_column(tx, "sender"), account_column(tx, "receiver")
    kept = F.col(src).isNotNull() & F.col(dst).isNotNull()
    return tx.agg(F.count(F.when(kept, 1)).alias("edges"), F.count(F.when(~kept, 1)).alias("dropped"))


def nodes(e: DataFrame) -> DataFrame:
    """Distinct accounts on either side."""
    return e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def node_features(e: DataFrame) -> DataFrame:
    """Degrees, amounts, ratios and label per node; one shuffle of signed rows.

    Amount columns come raw and as log1p (``*_log``).
    """
    sides = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("out")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")),
    )
    signed = e.select(F.inline(sides), "amount", "cross", "fraud")
    out, inn = F.col("out"), 1 - F.col("out")
    agg = signed.groupBy("node").agg(
        F.sum(out).cast("double").alias("out_degree"),
        F.sum(inn).cast("double").alias("in_degree"),
        F.sum(F.col("amount") * out).alias("out_amount_sum"),
        F.sum(F.col("amount") * inn).alias("in_amount_sum"),
        F.sum(F.col("cross") * out).alias("_cross"),
        F.sum(F.col("fraud") * out).alias("_fraud"),
        F.max(F.col("fraud") * out).alias("label"),
    )
    od, ind = F.col("out_degree"), F.col("in_degree")
    full = agg.select(
        "node", "out_degree", "in_degree", "out_amount_sum", "in_amount_sum",
        ratio(F.col("out_amount_sum"), F.nullif(od, F.lit(0.0))).alias("out_amount_mean"),
        ratio(F.col("in_amount_sum"), F.nullif(ind, F.lit(0.0))).alias("in_amount_mean"),
        (od / (ind + 1)).alias("fan_out_ratio"),
        (ind / (od + 1)).alias("fan_in_ratio"),
        ratio(F.col("_cross"), F.nullif(od, F.lit(0.0))).alias("cross_border_fraction"),
        ratio(F.col("_fraud"), F.nullif(od + ind, F.lit(0.0))).alias("fraud_neighbor_fraction"),
        F.greatest(F.lit(0.0), F.col("label")).alias("label"),
    )
    logs = ("out_amount_sum", "in_amount_sum", "out_amount_mean", "in_amount_mean")
    return full.select("*", *[F.log1p(c).alias(f"{c}_log") for c in logs])


def distinct_edges(e: DataFrame) -> DataFrame:
    return e.select("src", "dst").distinct()


def laid_out_edges(de: DataFrame, degree: DataFrame, rows_per_task: int, extra: Sequence[str] = ()) -> DataFrame:
    """Edges, with ``extra`` columns, stored by (src, _part), so that no round shuffles them again.

    Sources with many edges get several parts. The list of such sources has
    at most edges / rows_per_task entries, so it can be broadcast.
    """
    hubs = degree.filter(F.col("deg") > rows_per_task).select(
        "src", F.ceil(F.col("deg") / F.lit(rows_per_task)).alias("_parts")
    )
    joined = de.join(F.broadcast(hubs), "src", "left")
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("_parts")), F.lit(0)).cast("int")
    laid = joined.select("src", "dst", *extra, part.alias("_part")).repartition(partitions(de.sparkSession), "src", "_part")
    return cut(laid.sortWithinPartitions("src", "_part"), keep_layout=True)


def _laid_out_nodes(e: DataFrame, degree: DataFrame) -> DataFrame:
    """(node, deg) of every account, stored by node."""
    known = nodes(e).join(degree.withColumnRenamed("src", "node"), "node", "left")
    laid = known.select("node", F.coalesce("deg", F.lit(0)).alias("deg"))
    return cut(laid.repartition(partitions(e.sparkSession), "node"), keep_layout=True)


def _send(state: DataFrame, value: str, rows_per_task: int) -> DataFrame:
    """One copy of a node's value for each part of its edges."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("deg") / F.lit(rows_per_task))).cast("int")
    return state.filter(F.col("deg") > 0).select(
        F.col("node").alias("src"), "deg", value, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part")
    )


def pagerank(
    e: DataFrame,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float = 1e-6,
    rows_per_task: int = 5_000_000,
) -> DataFrame:
    """PageRank over distinct directed edges; (node, pagerank).

    The mass of nodes without out-edges is spread evenly. Stops when the total
    change falls below ``nodes * tol``; not getting there in ``max_iter`` rounds is
    an error. With ``tol`` 0 it runs exactly ``max_iter`` rounds. A round shuffles one value per node and
    the partly summed contributions, not the edges. Only two scalars per round
    reach the driver; ranks live in shared storage between rounds.
    """
    de = cut(distinct_edges(e))
    degree = de.groupBy("src").agg(F.count("*").alias("deg"))
    laid = laid_out_edges(de, degree, rows_per_task)
    base = _laid_out_nodes(e, degree)
    n, ends = base.agg(F.count("*"), F.count(F.when(F.col("deg") == 0, 1))).first()
    if n == 0:
        return base.select("node", F.lit(0.0).alias("pagerank"))
    ranks = base.select("node", "deg", F.lit(1.0 / n).alias("pagerank"))
    dangling = ends / n
    for _ in range(max_iter):
        received = (
            laid.join(_send(ranks, "pagerank", rows_per_task), ["src", "_part"])
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("pagerank") / F.col("deg")).alias("_in"))
        )
        fresh = alpha * (F.coalesce(F.col("_in"), F.lit(0.0)) + F.lit(dangling / n)) + (1 - alpha) / n
        stepped = ranks.join(received.hint("shuffle_merge"), "node", "left").select(
            "node", "deg", fresh.alias("pagerank"), F.abs(fresh - F.col("pagerank")).alias("_moved")
        )
        ranks = cut(stepped, keep_layout=True)
        moved, dangling = ranks.agg(
            F.sum("_moved"), F.sum(F.when(F.col("deg") == 0, F.col("pagerank")).otherwise(0.0))
        ).first()
        ranks = ranks.drop("_moved")
        if moved < n * tol:
            break
    else:
        if tol > 0:
            raise RuntimeError(f"PageRank moved {moved:g} in round {max_iter}, more than {n * tol:g}: raise max_iter or tol")
    return ranks.select("node", "pagerank")


def pair_weights(e: DataFrame, weight: str | None = None) -> DataFrame:
    """(src, dst, weight): payments, or the sum of ``weight``, per ordered pair.

    Repeated payments collapse here, before any feature is joined to them.
    """
    total = F.count("*").cast("double") if weight is None else F.sum(weight)
    return e.groupBy("src", "dst").agg(total.alias("weight"))


def neighbour_means(pairs: DataFrame, features: DataFrame, cols: list[str], rows_per_task: int) -> DataFrame:
    """Weighted mean of each feature over a node's in-edges, 0 for a node without any.

    ``pairs`` come from pair_weights; payment counts as weights give the mean
    over all in-edges.
    """
    source = features.select(F.col("node").alias("src"), *cols, F.col("out_degree").alias("_rows"))
    joined = spread_join(pairs, source, ["src"], "_rows", "dst", rows_per_task, "inner")
    means = joined.groupBy(F.col("dst").alias("node")).agg(
        *[
            ratio(F.sum(F.col(c) * F.col("weight")), F.nullif(F.sum("weight"), F.lit(0.0))).alias(f"nbr_{c}")
            for c in cols
        ]
    )
    return features.join(means, "node", "left").fillna(0.0, [f"nbr_{c}" for c in cols])


def fan_patterns(e: DataFrame, k: int) -> DataFrame:
    """Distinct counterparties per node on each side, and flags for over ``k``."""
    pairs = distinct_edges(e)
    sides = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("out")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")),
    )
    return (
        pairs.select(F.inline(sides))
        .groupBy("node")
        .agg(F.sum("out").alias("receivers"), F.sum(1 - F.col("out")).alias("senders"))
        .select(
            "node", "receivers", "senders",
            (F.col("receivers") > k).cast("int").alias("fan_out"),
            (F.col("senders") > k).cast("int").alias("fan_in"),
        )
    )


def closed_triples(links: DataFrame, keys: Sequence[str] = (), rows_per_task: int = 5_000_000) -> DataFrame:
    """Every three accounts that are pairwise linked, once (within equal ``keys``).

    ``links`` has one row (keys, u < v, fwd, back) per pair; fwd and back are any
    marks of the directions u to v and v to u. Each link points from the account with fewer
    links to the one with more. Then no account has more than sqrt(2 * links) outgoing
    ones, hubs included, and two of them at a time, taken at this low end, are closed by a third
    link: the joins grow with links^1.5 at worst and no hub has to be left out.
    Returns keys, a, b < c, and the marks ab, ba, ac, ca, bc, cb.
    """
    keys = list(keys)
    degree = links.select(*keys, F.explode(F.array("u", "v")).alias("n")).groupBy(*keys, "n").agg(F.count("*").alias("d"))
    of = lambda end, d: degree.select(*keys, F.col("n").alias(end), F.col("d").alias(d))
    # Attaching the degrees touches each link twice; hubs are spread.
    known = spread_join(links, of("u", "du"), [*keys, "u"], "du", "v", rows_per_task, "inner")
    known = spread_join(known, of("v", "dv"), [*keys, "v"], "dv", "u", rows_per_task, "inner")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    turned = lambda one, other: F.when(up, F.col(one)).otherwise(F.col(other))
    pointed = cut(
        known.select(*keys, turned("u", "v").alias("a"), turned("v", "u").alias("b"), turned("fwd", "back").alias("ab"), turned("back", "fwd").alias("ba"))
    )
    other = pointed.select(*keys, "a", F.col("b").alias("c"), F.col("ab").alias("ac"), F.col("ba").alias("ca"))
    third = links.select(*keys, F.col("u").alias("b"), F.col("v").alias("c"), F.col("fwd").alias("bc"), F.col("back").alias("cb"))
    wedges = pointed.join(other, [*keys, "a"]).filter("b < c")
    return wedges.join(third, [*keys, "b", "c"]).select(*keys, "a", "b", "c", "ab", "ba", "ac", "ca", "bc", "cb")


def triangles(e: DataFrame) -> DataFrame:
    """Every set of three accounts that are pairwise connected, once.

    ``ab``/``bc``/``ac`` carry bit 1 for a payment from the first account to the second and
    bit 2 for one from the second to the first.
    """
    low_first = F.col("src") < F.col("dst")
    links = (
        e.filter(F.col("src") != F.col("dst"))
        .groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(F.max(low_first.cast("int")).alias("fwd"), F.max((~low_first).cast("int")).alias("back"))
    )
    bits = lambda one, other: (F.col(one) + 2 * F.col(other))
    return closed_triples(cut(links)).select(
        "a", "b", "c", bits("ab", "ba").alias("ab"), bits("bc", "cb").alias("bc"), bits("ac", "ca").alias("ac")
    )


def payment_cycles(e: DataFrame) -> DataFrame:
    """Directed cycles x -> y -> z -> x over distinct pairs; x is the least id."""
    t = triangles(e)
    fwd = lambda c: F.col(c).bitwiseAND(1) == 1
    back = lambda c: F.col(c).bitwiseAND(2) == 2
    one = F.when(fwd("ab") & fwd("bc") & back("ac"), F.array("a", "b", "c"))
    two = F.when(fwd("ac") & back("bc") & back("ab"), F.array("a", "c", "b"))
    cycles = t.select(F.explode(F.array_compact(F.array(one, two))).alias("p"))
    p = F.col("p")
    start = F.array_position(p, F.array_min(p)).cast("int") - 1
    at = lambda i: F.get(p, F.pmod(start + i, F.lit(3)).cast("int"))
    return cycles.select(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def triangle_counts(e: DataFrame) -> DataFrame:
    """Triangles per account (undirected), 0 for accounts in none."""
    counted = triangles(e).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(
        F.count("*").alias("triangles")
    )
    return nodes(e).join(counted, "node", "left").fillna(0, ["triangles"])


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Add ``m``, the least ``v`` of each ``u``. Partial minima meet first, and the join back may split a hub."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.hint("merge"), "u")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least node around it."""
    both = pairs.select(
        F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    )
    around = _least_neighbour(both).withColumn("m", F.least("m", "u"))
    return around.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; pairs have u > v."""
    around = _least_neighbour(pairs)
    moved = around.select(
        F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
    )
    return moved.filter("u > v").distinct()


def connected(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Connected components of undirected links; (node, component = least id in it).

    Large-star and small-star steps in turn: each keeps the components and
    turns paths of any length into stars on their least node within a few
    rounds (their number grows with the logarithm of the longest path). Stops
    when a round changes nothing; there is no cap. Links live in shared storage
    between rounds, and one checksum a round reaches the driver.
    """
    pairs = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    pairs, before = materialise(pairs, "links"), None
    while True:
        mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
        pairs = materialise(_small_star(_large_star(pairs)), "links")
    heads = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        heads.select("node", F.col("node").alias("component"))
    )


def components(e: DataFrame) -> DataFrame:
    """Connected components (undirected) of all accounts; (node, component = least id in it)."""
    known = connected(e)
    return nodes(e).join(known, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
