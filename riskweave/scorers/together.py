"""All five scorers in one pass, with one shuffle of the transactions.

Velocity windows, corridor counts, account features and node scores all hang
on the sender. Scored one by one, the transactions would be shuffled for each
and once more to bring the results together by id. Here they are partitioned
by sender once, and every per-sender step reuses that partitioning; the
geographic and behaviour scores are expressions on the row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.scalars import account_column, amount_of, clip01, event_micros, number_or, text_or
from riskweave.operators import graph as G
from riskweave.operators.rolling import chunked_windows, fill_missing_time, native_windows
from riskweave.operators.skew import spread_join, split_heavy
from riskweave.scorers import behaviour, compliance, geo, network, velocity
from riskweave.scorers.velocity import IsolationForest
from riskweave.settings import alert_threshold, resolve


def score_together(
    tx: DataFrame,
    accounts: DataFrame,
    forest: IsolationForest | None = None,
    behaviour_stats: Mapping[str, float] | None = None,
    node_scores: DataFrame | None = None,
    settings: Mapping | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per transaction: five ``<agent>_score`` and four ``<agent>_reason_code`` columns.

    ``tx`` needs the canonical columns; ``keep`` names further ones to carry.
    ``node_scores`` default to the heuristic scores of the graph of ``tx``.
    """
    cfg = resolve(settings)
    hours, hot = cfg["velocity_windows_hours"], int(cfg["hot_key_rows"])
    stats = behaviour_stats or behaviour.amount_stats(tx)
    if node_scores is None:
        node_scores = network.heuristic_scores(G.node_features(G.edges(tx)))
    mean_node = node_scores.agg(F.avg("node_score")).first()[0] or 0.0

    placed = geo.features(tx, tuple(tx.columns))
    base = placed.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        text_or(tx, account_column(tx, "sender"), "__missing__").alias("sender"),
        event_micros(tx).alias("ts"),
        amount_of(tx).alias("amount"),
        number_or(tx, "is_cross_border", 0.0).alias("is_cross_border"),
        F.coalesce(F.col("remittance_corridor").cast("string"), F.lit("None")).alias("_c"),
        clip01(geo.rule_score()).alias("geo_risk_score"),
        geo.reason().alias("geo_risk_reason_code"),
        behaviour.heuristic(tx, stats).alias("behaviour_score"),
        *keep,
    )
    base = fill_missing_time(base, "ts", "transaction_id")
    ordinary, heavy = split_heavy(base, "sender", int(cfg["dense_key_rows"]))

    people = accounts.select(F.col("account_id").alias("sender"), *compliance.ACCOUNT_COLUMNS)
    nodes = node_scores.select(F.col("node").alias("sender"), "node_score", "out_degree")

    rows = native_windows(ordinary, "sender", "ts", "transaction_id", "amount", hours)
    rows = rows.withColumn("corridor_count", F.count("*").over(Window.partitionBy("sender", "_c")))
    rows = rows.join(people, "sender", "left").join(nodes.drop("out_degree"), "sender", "left")
    if heavy is not None:
        more = chunked_windows(heavy, "sender", "ts", "transaction_id", "amount", hours, hot)
        pairs = heavy.groupBy("sender", "_c").agg(F.count("*").alias("corridor_count"))
        more = spread_join(more, pairs, ["sender", "_c"], "corridor_count", "transaction_id", hot)
        more = more.join(people, "sender", "left")
        more = spread_join(more, nodes, ["sender"], "out_degree", "transaction_id", hot).drop("out_degree")
        rows = rows.unionByName(more)
    return _finish(rows, cfg, forest, mean_node, settings, keep)


def _finish(rows, cfg, forest, mean_node, settings, keep) -> DataFrame:
    hours = cfg["velocity_windows_hours"]
    rows = rows.fillna(
        {"kyc_verified": 1, "kyc_risk_grade": "low", "is_pep": 0, "is_sanctioned": 0, "account_age_days": 9999}
    )
    feats = rows.select(
        "transaction_id", "is_cross_border", "corridor_count", *compliance.ACCOUNT_COLUMNS, "geo_risk_score",
        "geo_risk_reason_code", "behaviour_score", "node_score", *velocity.feature_expressions(hours), *keep,
    )
    flagged = feats.select(
        "*", *[flag.alias(f"r_{name}") for name, flag in compliance.flag_columns(feats, cfg).items()]
    )
    modelled = flagged.withColumn("_model", velocity.model_score(flagged, forest))
    spike, spiked = velocity.spike_score(settings)
    limit = alert_threshold("velocity", settings)
    node = F.coalesce(F.col("node_score"), F.lit(mean_node))
    return modelled.select(
        "transaction_id",
        F.greatest(F.col("_model"), spiked).alias("velocity_score"),
        "geo_risk_score",
        "behaviour_score",
        clip01(compliance.rule_score(cfg)).alias("kyc_aml_score"),
        node.alias("graph_score"),
        F.when(spike, "VELOCITY_SPIKE")
        .when(F.col("_model") >= limit, "ISOLATION_ANOMALY")
        .otherwise("NORMAL_VELOCITY")
        .alias("velocity_reason_code"),
        "geo_risk_reason_code",
        compliance.reason().alias("kyc_aml_reason_code"),
        F.when(node >= alert_threshold("graph", settings), "GRAPH_ANOMALY")
        .otherwise("NORMAL_GRAPH")
        .alias("graph_reason_code"),
        *keep,
    )
