"""SQL fragments shared by the DuckDB counterparts."""

MEDIUM = "'Qatar->Nepal','UAE->Nepal','Saudi Arabia->Nepal','Bahrain->Nepal','Kuwait->Nepal','Oman->Nepal','Malaysia->Nepal','South Korea->Nepal'"
LOW = "'India->Nepal','Thailand->Nepal'"
HIGH = "'USA->Nepal','UK->Nepal','Australia->Nepal','Japan->Nepal'"
TIER = f"CASE WHEN remittance_corridor IN ({LOW}) THEN 'low' WHEN remittance_corridor IN ({MEDIUM}) THEN 'medium' WHEN remittance_corridor IN ({HIGH}) THEN 'high' END"

GEO_F = f"""geo_f AS (SELECT transaction_id,
 coalesce(sender_country, 'unknown') AS f_sender_country, coalesce(receiver_country, 'unknown') AS f_receiver_country,
 coalesce(remittance_corridor, 'unknown') AS f_remittance_corridor, original_currency AS f_original_currency,
 coalesce(ip_country, 'unknown') AS f_ip_country, CAST(is_cross_border AS DOUBLE) AS f_is_cross_border,
 CAST(ip_is_vpn AS DOUBLE) AS f_ip_is_vpn,
 CAST(CASE {TIER} WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.5 WHEN 'high' THEN 0.85 ELSE 0.1 END AS DOUBLE) AS f_corridor_risk,
 CAST(CASE WHEN ip_country <> sender_country AND is_cross_border = 0 THEN 1 ELSE 0 END AS DOUBLE) AS f_ip_country_mismatch
 FROM tx)"""
GEO = """geo AS (SELECT transaction_id,
 0.45::DOUBLE * f_corridor_risk + 0.25::DOUBLE * f_ip_is_vpn + 0.20::DOUBLE * f_is_cross_border + 0.10::DOUBLE * f_ip_country_mismatch AS risk_score,
 CASE WHEN f_ip_is_vpn > 0 THEN 'VPN_OR_PROXY' WHEN f_ip_country_mismatch > 0 THEN 'IP_COUNTRY_MISMATCH'
 WHEN f_corridor_risk >= 0.85::DOUBLE THEN 'HIGH_RISK_CORRIDOR' WHEN f_is_cross_border > 0 THEN 'CROSS_BORDER' ELSE 'DOMESTIC' END AS reason_code
 FROM geo_f)"""
KYC_J = """kyc_j AS (SELECT t.*, coalesce(a.kyc_verified, 1) AS kyc_verified, coalesce(a.kyc_risk_grade, 'low') AS kyc_risk_grade,
 coalesce(a.is_pep, 0) AS is_pep, coalesce(a.is_sanctioned, 0) AS is_sanctioned,
 coalesce(a.account_age_days, 9999) AS account_age_days
 FROM tx t LEFT JOIN ac a ON t.sender_account_id = a.account_id)"""
KYC_R = """kyc_r AS (SELECT transaction_id, is_pep AS r_pep, is_sanctioned AS r_sanctions,
 CASE WHEN kyc_verified = 0 THEN 1 ELSE 0 END AS r_kyc, CASE WHEN account_age_days < 90 THEN 1 ELSE 0 END AS r_new,
 CASE WHEN kyc_risk_grade = 'high' THEN 1 ELSE 0 END AS r_high,
 CASE WHEN amount_npr >= 900000 AND amount_npr <= 999000 THEN 1 ELSE 0 END AS r_struct,
 CASE WHEN is_cross_border = 1 AND count(*) OVER (PARTITION BY sender_account_id, remittance_corridor) >= 2 THEN 1 ELSE 0 END AS r_layer
 FROM kyc_j)"""
KYC = """kyc AS (SELECT transaction_id, (r_pep * 0.4 + r_sanctions * 1.0 + r_kyc * 0.5 + r_new * 0.3 + r_high * 0.3 + r_struct * 0.6 + r_layer * 0.7)::DOUBLE / 3.8::DOUBLE AS risk_score,
 coalesce(nullif(concat_ws('|', CASE WHEN r_pep = 1 THEN 'PEP' END, CASE WHEN r_sanctions = 1 THEN 'SANCTIONS' END,
 CASE WHEN r_kyc = 1 THEN 'KYC_UNVERIFIED' END, CASE WHEN r_new = 1 THEN 'NEW_ACCOUNT' END,
 CASE WHEN r_high = 1 THEN 'HIGH_RISK_GRADE' END, CASE WHEN r_struct = 1 THEN 'STRUCTURING' END,
 CASE WHEN r_layer = 1 THEN 'LAYERING' END), ''), 'NO_VIOLATIONS') AS reason_code FROM kyc_r)"""
KYC_ALL = (KYC_J, KYC_R, KYC)

VT = "vt AS (SELECT transaction_id, sender_account_id AS s, epoch_us(txn_ts) AS us, amount_npr AS a FROM tx)"
_W = ",\n".join(
    f"count(*) FILTER (WHERE b.us > x.us - {h} * 3600000000) AS c{h}, sum(b.a) FILTER (WHERE b.us > x.us - {h} * 3600000000) AS s{h}"
    for h in (1, 6, 24, 168)
)
VW = f"""vw AS (SELECT x.transaction_id, {_W} FROM vt x JOIN vt b ON b.s = x.s AND (b.us < x.us OR (b.us = x.us AND b.transaction_id <= x.transaction_id))
 GROUP BY x.transaction_id)"""
VL = """vl AS (SELECT transaction_id, a, coalesce((us - lag(us) OVER (PARTITION BY s ORDER BY us, transaction_id)) / 1e6, 86400.0) AS since,
 abs(coalesce((a - nullif(avg(a) OVER (PARTITION BY s), 0)) / nullif(stddev_samp(a) OVER (PARTITION BY s), 0), 0)) AS z FROM vt)"""
VEL = """vel AS (SELECT transaction_id, CASE WHEN c1 >= 3 THEN least(c1 / 10.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS risk_score,
 CASE WHEN c1 >= 3 THEN 'VELOCITY_SPIKE' ELSE 'NORMAL_VELOCITY' END AS reason_code FROM vw)"""
VEL_ALL = (VT, VW, VEL)

BSTAT = "bstat AS (SELECT avg(amount_npr) AS m, stddev_samp(amount_npr) AS sd FROM tx)"
BEH = """beh AS (SELECT transaction_id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-0.5::DOUBLE * abs((amount_npr - m) / sd))) AS risk_score FROM tx, bstat)"""
BEH_ALL = (BSTAT, BEH)

EDGES = "e AS (SELECT transaction_id, sender_account_id AS src, receiver_account_id AS dst, amount_npr AS amount, is_cross_border AS cross_b, is_fraud AS fraud, epoch_us(txn_ts) AS us FROM tx)"
NODES = """outs AS (SELECT src AS node, count(*) AS od, sum(amount) AS oa, sum(cross_b) AS cb, sum(fraud) AS fr, max(fraud) AS lab FROM e GROUP BY src),
ins AS (SELECT dst AS node, count(*) AS ind, sum(amount) AS ia FROM e GROUP BY dst),
n0 AS (SELECT coalesce(o.node, i.node) AS node, coalesce(od, 0)::DOUBLE AS out_degree, coalesce(ind, 0)::DOUBLE AS in_degree,
 coalesce(oa, 0) AS out_amount_sum, coalesce(ia, 0) AS in_amount_sum, coalesce(cb, 0)::DOUBLE AS cb, coalesce(fr, 0)::DOUBLE AS fr,
 coalesce(lab, 0)::DOUBLE AS label FROM outs o FULL JOIN ins i ON o.node = i.node),
nf AS (SELECT node, out_degree, in_degree, out_amount_sum, in_amount_sum,
 coalesce(out_amount_sum / nullif(out_degree, 0), 0) AS out_amount_mean, coalesce(in_amount_sum / nullif(in_degree, 0), 0) AS in_amount_mean,
 out_degree / (in_degree + 1) AS fan_out_ratio, in_degree / (out_degree + 1) AS fan_in_ratio,
 coalesce(cb / nullif(out_degree, 0), 0) AS cross_border_fraction, coalesce(fr / nullif(out_degree + in_degree, 0), 0) AS fraud_neighbor_fraction,
 label FROM n0)"""
GSCORE = """gs AS (SELECT node, 0.3::DOUBLE * least(1, fan_out_ratio / ((SELECT max(fan_out_ratio) FROM nf) + 1e-9)) + 0.3::DOUBLE * least(1, fan_in_ratio / ((SELECT max(fan_in_ratio) FROM nf) + 1e-9))
 + 0.2::DOUBLE * cross_border_fraction + 0.2::DOUBLE * fraud_neighbor_fraction AS node_score FROM nf),
gra AS (SELECT t.transaction_id, gs.node_score AS risk_score FROM tx t JOIN gs ON gs.node = t.sender_account_id)"""
GRA_ALL = (EDGES, NODES, GSCORE)

# Five model-free scores side by side, and their average.
WIDE = """wide AS (SELECT t.transaction_id, t.is_fraud, t.fraud_type, v.risk_score AS velocity_score, g.risk_score AS geo_risk_score,
 b.risk_score AS behaviour_score, k.risk_score AS kyc_aml_score, n.risk_score AS graph_score
 FROM tx t JOIN vel v USING (transaction_id) JOIN geo g USING (transaction_id) JOIN beh b USING (transaction_id)
 JOIN kyc k USING (transaction_id) JOIN gra n USING (transaction_id))"""
WIDE_ALL = (*VEL_ALL, GEO_F, GEO, *BEH_ALL, *KYC_ALL, *GRA_ALL, WIDE)

# Three scores for the metrics: ties in one, distinct values in another.
EVAL = """ev AS (SELECT t.transaction_id, t.is_fraud AS y, t.fraud_type, g.risk_score AS geo_risk_score, b.risk_score AS behaviour_score,
 (g.risk_score + b.risk_score) / 2.0::DOUBLE AS meta_learner_score
 FROM tx t JOIN geo g USING (transaction_id) JOIN beh b USING (transaction_id)),
el AS (SELECT transaction_id, y, 'geo_risk' AS agent_name, geo_risk_score AS s FROM ev UNION ALL
 SELECT transaction_id, y, 'behaviour', behaviour_score FROM ev UNION ALL
 SELECT transaction_id, y, 'meta_learner', meta_learner_score FROM ev)"""
EVAL_ALL = (GEO_F, GEO, *BEH_ALL, EVAL)
CURVE = """cells AS (SELECT agent_name, s, sum(y) AS pos, sum(1 - y) AS neg FROM el GROUP BY agent_name, s),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY agent_name) AS p,
 sum(neg) OVER (PARTITION BY agent_name) AS n FROM cells WINDOW w AS (PARTITION BY agent_name ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"""
CURVE_ALL = (*EVAL_ALL, CURVE)
