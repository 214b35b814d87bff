"""Account graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.operators import communities as C
from riskweave.operators import graph as G
from riskweave.operators.patterns import payment_chains
from riskweave.operators.ranking import temporal_split
from riskweave.operators.timecycles import time_cycles
from riskweave.plans import parts as P
from riskweave.plans import sqltext as S
from riskweave.plans.registry import query
from riskweave.plans.views import tx, tx_dirty
from riskweave.runtime import cut
from riskweave.scorers import attention, layers, network
from riskweave.settings import DEFAULTS

_N = (S.EDGES, S.NODES)


def _edges(spark, d):
    return G.edges(tx(spark, d))


def _features(spark, d):
    return G.node_features(_edges(spark, d))


@query("g1_edges", "SELECT transaction_id, src, dst, round(amount, 2) AS amount, us AS ts FROM e", ctes=(S.EDGES,))
def g1(spark, d):
    return P.rounded(_edges(spark, d).select("transaction_id", "src", "dst", "amount", "ts"), "amount", digits=2)


@query(
    "g1_dropped_edges",
    "SELECT count(sender_account_id) AS edges, count(*) - count(sender_account_id) AS dropped FROM tx_dirty",
    views=("tx_dirty",),
)
def g1_dropped(spark, d):
    return G.edge_report(tx_dirty(spark, d))


@query(
    "g2_degrees_and_sums",
    "SELECT node, out_degree, in_degree, round(out_amount_sum, 2) AS out_amount_sum, round(in_amount_sum, 2) AS in_amount_sum FROM nf",
    ctes=_N,
)
def g2(spark, d):
    cols = ("out_amount_sum", "in_amount_sum")
    return P.rounded(_features(spark, d).select("node", "out_degree", "in_degree", *cols), *cols, digits=2)


@query("g3_amount_means", "SELECT node, round(out_amount_mean, 4) AS out_amount_mean, round(in_amount_mean, 4) AS in_amount_mean FROM nf", ctes=_N)
def g3(spark, d):
    cols = ("out_amount_mean", "in_amount_mean")
    return P.rounded(_features(spark, d).select("node", *cols), *cols, digits=4)


@query("g4_fan_ratios", "SELECT node, round(fan_out_ratio, 6) AS fan_out_ratio, round(fan_in_ratio, 6) AS fan_in_ratio FROM nf", ctes=_N)
def g4(spark, d):
    cols = ("fan_out_ratio", "fan_in_ratio")
    return P.rounded(_features(spark, d).select("node", *cols), *cols)


@query("g5_cross_border_fraction", "SELECT node, round(cross_border_fraction, 6) AS cross_border_fraction FROM nf", ctes=_N)
def g5(spark, d):
    return P.rounded(_features(spark, d).select("node", "cross_border_fraction"), "cross_border_fraction")


@query("g6_fraud_neighbour_fraction", "SELECT node, round(fraud_neighbor_fraction, 6) AS fraud_neighbor_fraction FROM nf", ctes=_N)
def g6(spark, d):
    return P.rounded(_features(spark, d).select("node", "fraud_neighbor_fraction"), "fraud_neighbor_fraction")


_LOGS = ("out_amount_sum", "in_amount_sum", "out_amount_mean", "in_amount_mean")


@query("g7_log_amounts", "SELECT node, " + ", ".join(f"round(ln(1 + {c}), 6) AS {c}_log" for c in _LOGS) + " FROM nf", ctes=_N)
def g7(spark, d):
    cols = [f"{c}_log" for c in _LOGS]
    return P.rounded(_features(spark, d).select("node", *cols), *cols)


_ROUNDS = 8


def _pagerank_sql(rounds: int) -> str:
    out = [
        S.EDGES,
        "de AS (SELECT DISTINCT src, dst FROM e)",
        "dg AS (SELECT src, count(*) AS deg FROM de GROUP BY src)",
        "nn AS (SELECT node, coalesce(deg, 0) AS deg, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n "
        "FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN dg ON src = node)",
        "r0 AS MATERIALIZED (SELECT node, deg, n, 1.0::DOUBLE / n AS pr FROM nn)",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        out.append(
            f"r{i} AS MATERIALIZED (SELECT b.node, b.deg, b.n, 0.85::DOUBLE * (coalesce(c.got, 0) + (SELECT coalesce(sum(pr), 0) FROM {p} WHERE deg = 0) / b.n) + 0.15::DOUBLE / b.n AS pr "
            f"FROM {p} b LEFT JOIN (SELECT de.dst, sum(x.pr / x.deg) AS got FROM de JOIN {p} x ON x.node = de.src GROUP BY de.dst) c ON c.dst = b.node)"
        )
    return ",\n".join(out)


@query("g8_pagerank", f"SELECT node, round(pr, 9) AS pagerank FROM r{_ROUNDS}", ctes=(_pagerank_sql(_ROUNDS),))
def g8(spark, d):
    """A fixed number of rounds, so that both sides stop alike."""
    return P.rounded(G.pagerank(_edges(spark, d), max_iter=_ROUNDS, tol=0.0), "pagerank", digits=9)


_LIMIT, _TOL = 100, 1e-6


def _stopped(limit: int, tol: float) -> str:
    """The operator's stop rule: ranks of the first round whose total change is below nodes * tol."""
    moved = [
        f"SELECT {i} AS k, sum(abs(a.pr - b.pr)) < count(*) * {tol!r}::DOUBLE AS still FROM r{i} a JOIN r{i - 1} b USING (node)"
        for i in range(1, limit + 1)
    ]
    ranks = " UNION ALL ".join(f"SELECT {i} AS k, node, pr FROM r{i}" for i in range(1, limit + 1))
    return f"moved AS ({' UNION ALL '.join(moved)}),\nranks AS ({ranks})"


@query(
    "g8_pagerank_converged",
    "SELECT node, round(pr, 9) AS pagerank FROM ranks WHERE k = (SELECT min(k) FROM moved WHERE still)",
    ctes=(_pagerank_sql(_LIMIT), _stopped(_LIMIT, _TOL)),
)
def g8_converged(spark, d):
    """Run until the operator's own rule stops it."""
    return P.rounded(G.pagerank(_edges(spark, d)), "pagerank", digits=9)


@query("g9_node_labels", "SELECT node, label FROM nf", ctes=_N)
def g9(spark, d):
    return _features(spark, d).select("node", "label")


@query("g10_node_scores", "SELECT node, round(node_score, 6) AS node_score FROM gs", ctes=(*_N, S.GSCORE))
def g10(spark, d):
    return P.rounded(network.heuristic_scores(_features(spark, d)).select("node", "node_score"), "node_score")


@query(
    "g11_graph_alerts",
    """SELECT transaction_id, 'graph' AS agent_name, round(risk_score, 6) AS risk_score, CASE WHEN risk_score >= 0.4 THEN 1 ELSE 0 END AS alert_flag,
 CASE WHEN risk_score >= 0.4 THEN 'GRAPH_ANOMALY' ELSE 'NORMAL_GRAPH' END AS reason_code,
 'Graph analysis (GRAPHSAGE): ' || CASE WHEN risk_score >= 0.4 THEN 'graph anomaly' ELSE 'normal graph' END || '.' AS explanation FROM gra""",
    ctes=S.GRA_ALL,
)
def g11(spark, d):
    out = network.score(tx(spark, d), settings={"graph_alert_threshold": 0.4}).drop("timestamp")
    return P.rounded(out, "risk_score")


_HOP_COLS = ("out_degree", "fan_out_ratio", "cross_border_fraction", "fraud_neighbor_fraction")


def _hop_sql(weight: str) -> str:
    one = ", ".join(f"coalesce(sum(f.{c} * {weight}) / nullif(sum({weight}), 0), 0) AS nbr_{c}" for c in _HOP_COLS)
    two = ", ".join(f"coalesce(sum(f.nbr_{c} * {weight}) / nullif(sum({weight}), 0), 0) AS nbr_nbr_{c}" for c in _HOP_COLS)
    keep = ", ".join(f"coalesce(m.nbr_{c}, 0) AS nbr_{c}" for c in _HOP_COLS)
    return (
        f"h1 AS (SELECT nf.node, {keep} FROM nf LEFT JOIN (SELECT e.dst, {one} FROM e JOIN nf f ON f.node = e.src GROUP BY e.dst) m ON m.dst = nf.node),\n"
        f"h2 AS (SELECT e.dst, {two} FROM e JOIN h1 f ON f.node = e.src GROUP BY e.dst)"
    )


_HOP_SELECT = "SELECT h1.node, " + ", ".join(
    f"round(nbr_{c}, 6) AS nbr_{c}, round(coalesce(nbr_nbr_{c}, 0), 6) AS nbr_nbr_{c}" for c in _HOP_COLS
) + " FROM h1 LEFT JOIN h2 ON h2.dst = h1.node"


def _hops(spark, d, weight):
    e = _edges(spark, d)
    rows = DEFAULTS["hot_key_rows"]
    pairs = cut(G.pair_weights(e, weight))
    one = cut(G.neighbour_means(pairs, G.node_features(e), list(_HOP_COLS), rows))
    two = G.neighbour_means(pairs, one, [f"nbr_{c}" for c in _HOP_COLS], rows)
    cols = [f"{p}{c}" for c in _HOP_COLS for p in ("nbr_", "nbr_nbr_")]
    return P.rounded(two.select("node", *cols), *cols)


@query("g12_neighbour_means", _HOP_SELECT, ctes=(*_N, _hop_sql("1")))
def g12(spark, d):
    return _hops(spark, d, None)


@query("g13_weighted_neighbour_means", _HOP_SELECT, ctes=(*_N, _hop_sql("e.amount")))
def g13(spark, d):
    return _hops(spark, d, "amount")


@query("g12_neighbour_classifier")
def g12_model(spark, d):
    t = tx(spark, d)
    _, scores = network.fit(t)
    return P.rounded(network.score(t, scores).drop("timestamp"), "risk_score")


@query(
    "g12_trained_layers",
    "SELECT node, true AS in_range, true AS loss_fell FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)",
    ctes=(S.EDGES,),
)
def g12_layers(spark, d):
    """Fitted on the earlier four fifths of the payments, scores of the accounts of all."""
    t = tx(spark, d)
    earlier = temporal_split(t, "txn_ts", "transaction_id").filter("is_train = 1").drop("is_train")
    model = layers.fit_layers(earlier, {"graph_max_iter": 12})
    fell = model.losses[-1] < model.losses[0]
    return layers.layer_scores(t, model).select("node", F.col("node_score").between(0.0, 1.0).alias("in_range"), F.lit(fell).alias("loss_fell"))


def _attention(spark, d):
    """(payments, layer fitted on the earlier four fifths of them)."""
    t = tx(spark, d)
    earlier = temporal_split(t, "txn_ts", "transaction_id").filter("is_train = 1").drop("is_train")
    return t, attention.fit_attention(earlier, {"graph_max_iter": 8})


@query(
    "g13_attention_weights",
    "SELECT dst AS payee, count(DISTINCT src) AS payers, 1.0::DOUBLE AS head_0, 1.0::DOUBLE AS head_1, 1.0::DOUBLE AS head_2, 1.0::DOUBLE AS head_3, true AS positive FROM e GROUP BY dst",
    ctes=(S.EDGES,),
)
def g13_weights(spark, d):
    """Per payee: its payers, and the sum of their weights in each head."""
    t, model = _attention(spark, d)
    heads = [f"head_{k}" for k in range(model.net.heads)]
    sums = attention.attention_weights(t, model).groupBy("payee").agg(
        F.count("*").alias("payers"), *[F.round(F.sum(h), 9).alias(h) for h in heads], (F.min(F.least(*heads)) >= 0).alias("positive")
    )
    return sums


@query(
    "g13_attention_scores",
    "SELECT node, true AS in_range, true AS loss_fell FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)",
    ctes=(S.EDGES,),
)
def g13_attention(spark, d):
    """Fitted on the earlier four fifths of the payments, scores of the accounts of all."""
    t, model = _attention(spark, d)
    fell = model.losses[-1] < model.losses[0]
    return attention.attention_scores(t, model).select("node", F.col("node_score").between(0.0, 1.0).alias("in_range"), F.lit(fell).alias("loss_fell"))


@query("g13_weighted_classifier")
def g13_model(spark, d):
    t = tx(spark, d)
    settings = {"graph_model_type": "gat"}
    _, scores = network.fit(t, settings)
    return P.rounded(network.score(t, scores, settings).drop("timestamp"), "risk_score")


@query(
    "g14_fan_patterns",
    """SELECT node, coalesce(r, 0) AS receivers, coalesce(s, 0) AS senders, CASE WHEN coalesce(r, 0) > 50 THEN 1 ELSE 0 END AS fan_out,
 CASE WHEN coalesce(s, 0) > 50 THEN 1 ELSE 0 END AS fan_in FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)
 LEFT JOIN (SELECT src, count(DISTINCT dst) AS r FROM e GROUP BY src) ON src = node
 LEFT JOIN (SELECT dst, count(DISTINCT src) AS s FROM e GROUP BY dst) ON dst = node""",
    ctes=(S.EDGES,),
)
def g14(spark, d):
    return G.fan_patterns(_edges(spark, d), 50)


@query(
    "g15_chains",
    """SELECT m.transaction_id, m.src, m.dst, coalesce(u.n, 0) AS upstream, coalesce(w.n, 0) AS downstream, coalesce(u.n, 0) * coalesce(w.n, 0) AS chains FROM e m
 LEFT JOIN (SELECT b.transaction_id, count(*) AS n FROM e b JOIN e a ON a.dst = b.src AND a.src <> a.dst AND a.src <> b.dst AND a.us < b.us AND a.us >= b.us - 24 * 3600000000 GROUP BY 1) u USING (transaction_id)
 LEFT JOIN (SELECT b.transaction_id, count(*) AS n FROM e b JOIN e c ON c.src = b.dst AND c.src <> c.dst AND c.dst <> b.src AND c.us > b.us AND c.us <= b.us + 24 * 3600000000 GROUP BY 1) w USING (transaction_id)
 WHERE m.src <> m.dst""",
    ctes=(S.EDGES,),
)
def g15(spark, d):
    return payment_chains(_edges(spark, d), 24, DEFAULTS["dense_key_rows"])


@query(
    "g16_cycles",
    """SELECT a.src AS x, b.src AS y, c.src AS z FROM de a JOIN de b ON b.src = a.dst JOIN de c ON c.src = b.dst AND c.dst = a.src
 WHERE a.src <> b.src AND b.src <> c.src AND a.src <> c.src AND a.src < b.src AND a.src < c.src""",
    ctes=(S.EDGES, "de AS (SELECT DISTINCT src, dst FROM e)"),
)
def g16(spark, d):
    return G.payment_cycles(_edges(spark, d))


@query(
    "g16_time_cycles",
    """SELECT node, coalesce(started, 0)::BIGINT AS started, coalesce(passed, 0)::BIGINT AS passed FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)
 LEFT JOIN (SELECT x AS node, count(*) AS started FROM tc GROUP BY x) USING (node)
 LEFT JOIN (SELECT node, count(*) AS passed FROM (SELECT unnest([y, z]) AS node FROM tc) GROUP BY node) USING (node)""",
    ctes=(
        S.EDGES,
        """tc AS (SELECT a.src AS x, b.src AS y, c.src AS z FROM e a JOIN e b ON b.src = a.dst AND b.us > a.us AND b.us <= a.us + 72 * 3600000000
 JOIN e c ON c.src = b.dst AND c.dst = a.src AND c.us > b.us AND c.us <= a.us + 72 * 3600000000 WHERE a.src <> a.dst AND b.src <> b.dst AND c.src <> c.dst)""",
    ),
)
def g16_in_time(spark, d):
    return time_cycles(_edges(spark, d), 72)


@query(
    "g17_triangle_counts",
    """SELECT node, coalesce(t, 0) AS triangles FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN
 (SELECT n, count(*) AS t FROM (SELECT unnest([p.u, p.v, q.v]) AS n FROM un p JOIN un q ON q.u = p.v JOIN un r ON r.u = p.u AND r.v = q.v) GROUP BY n) ON n = node""",
    ctes=(S.EDGES, "un AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e WHERE src <> dst)"),
)
def g17(spark, d):
    return G.triangle_counts(_edges(spark, d))


def _least_label_sql(rounds: int) -> str:
    """Least label of the neighbourhood, ``rounds`` times; links of payments reach every account in far fewer."""
    out = [
        S.EDGES,
        "un AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e)",
        "l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM un)",
    ]
    out += [
        f"l{i} AS MATERIALIZED (SELECT un.a AS node, min(label) AS label FROM un JOIN l{i - 1} ON un.b = l{i - 1}.node GROUP BY un.a)"
        for i in range(1, rounds + 1)
    ]
    return ",\n".join(out)


@query("g17_components", "SELECT node, label AS component FROM l30", ctes=(_least_label_sql(30),))
def g17_components(spark, d):
    """Communities linked by payments; every account has one."""
    return G.components(_edges(spark, d))


def _core_sql(rounds: int, least: int = 1) -> str:
    """Core numbers as the fixed point of the h-index: from the partner count, each account takes the greatest h
    such that h partners have a value of h or more, ``rounds`` times."""
    out = [
        S.EDGES,
        "pl AS MATERIALIZED (SELECT a, b FROM (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst) "
        f"GROUP BY a, b HAVING count(*) >= {least})",
        "c0 AS MATERIALIZED (SELECT a AS node, count(*) AS core FROM pl GROUP BY a)",
    ]
    out += [
        f"c{i} AS MATERIALIZED (SELECT a AS node, max(least(r, core)) AS core FROM (SELECT pl.a, p.core, row_number() OVER (PARTITION BY pl.a ORDER BY p.core DESC) AS r "
        f"FROM pl JOIN c{i - 1} p ON pl.b = p.node) GROUP BY a)"
        for i in range(1, rounds + 1)
    ]
    out.append(f"cores AS MATERIALIZED (SELECT node, coalesce(core, 0)::BIGINT AS core FROM (SELECT src AS node FROM e UNION SELECT dst FROM e) LEFT JOIN c{rounds} USING (node))")
    return ",\n".join(out)


_CORE_ROUNDS = 40


@query("g17_core_numbers", "SELECT node, core FROM cores", ctes=(_core_sql(_CORE_ROUNDS),))
def g17_cores(spark, d):
    return C.core_numbers(_edges(spark, d))


_REPEATED = 4


@query("g17_core_numbers_repeated", "SELECT node, core FROM cores", ctes=(_core_sql(_CORE_ROUNDS, _REPEATED),))
def g17_repeated(spark, d):
    """Partners with several payments only: a sparse graph with accounts in no core."""
    return C.core_numbers(_edges(spark, d), _REPEATED)


def _community_sql(k: int, rounds: int) -> str:
    """Least label of the partners inside the core, ``rounds`` times."""
    out = [
        f"inner_l AS MATERIALIZED (SELECT pl.a, pl.b FROM pl JOIN cores x ON x.node = pl.a AND x.core >= {k} JOIN cores y ON y.node = pl.b AND y.core >= {k})",
        f"k0 AS MATERIALIZED (SELECT node, node AS label FROM cores WHERE core >= {k})",
    ]
    out += [
        f"k{i} AS MATERIALIZED (SELECT p.node, least(p.label, coalesce(min(q.label), p.label)) AS label FROM k{i - 1} p LEFT JOIN inner_l ON p.node = inner_l.a "
        f"LEFT JOIN k{i - 1} q ON q.node = inner_l.b GROUP BY p.node, p.label)"
        for i in range(1, rounds + 1)
    ]
    return ",\n".join(out)


@query(
    "g17_dense_communities",
    "SELECT node, core, label AS community FROM cores JOIN k30 USING (node)",
    ctes=(_core_sql(_CORE_ROUNDS, _REPEATED), _community_sql(2, 30)),
)
def g17_communities(spark, d):
    return C.dense_communities(_edges(spark, d), 2, _REPEATED)
