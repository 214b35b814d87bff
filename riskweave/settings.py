"""Engine settings: a plain dictionary merged over defaults."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

# Thresholds, rule weights and model sizes that scores depend on.
DEFAULTS: dict[str, Any] = {
    "random_seed": 42,
    "structuring_min_npr": 900_000.0,
    "structuring_max_npr": 999_000.0,
    "new_account_threshold_days": 90,
    "velocity_alert_threshold": 0.7,
    "velocity_windows_hours": (1, 6, 24, 168),
    "velocity_isolation_estimators": 100,
    "velocity_spike_min_transactions": 3,
    "geo_risk_alert_threshold": 0.65,
    "geo_risk_iterations": 300,
    "geo_risk_learning_rate": 0.05,
    "geo_risk_depth": 6,
    "geo_risk_random_seed": 42,
    "kyc_aml_alert_threshold": 0.6,
    "weight_pep_flag": 0.4,
    "weight_sanctions_match": 1.0,
    "weight_kyc_unverified": 0.5,
    "weight_new_account": 0.3,
    "weight_high_risk_grade": 0.3,
    "weight_structuring_pattern": 0.6,
    "weight_layering_pattern": 0.7,
    "behaviour_alert_threshold": 0.7,
    "behaviour_seq_len": 16,
    "behaviour_hidden_dim": 64,
    "behaviour_model_type": "gru",
    "behaviour_max_iter": 60,
    "behaviour_learning_rate": 0.01,
    "graph_alert_threshold": 0.65,
    "graph_model_type": "graphsage",
    "graph_hidden_dim": 16,
    "graph_heads": 4,
    "graph_max_iter": 30,
    "graph_learning_rate": 0.02,
    "meta_learner_alert_threshold": 0.5,
    "meta_learner_model_type": "random_forest",
    "meta_learner_n_estimators": 200,
    "meta_learner_calibration_cv": 3,
    "meta_learner_calibration_val_fraction": 0.2,
    "meta_learner_xgb_learning_rate": 0.05,
    "meta_learner_xgb_subsample": 0.8,
    "meta_learner_xgb_colsample_bytree": 0.8,
    "meta_learner_xgb_default_max_depth": 6,
    "explanation_alert_threshold": 0.5,
}

# Depth of meta forests when the caller sets none; tree depth is what bounds the passes over the training data.
DEFAULTS.update({"meta_learner_max_depth": None, "meta_learner_default_max_depth": 10})

# Engine knobs: how rows are dealt. dense_key_rows also changes the last digits of rolling sums.
DEFAULTS.update(
    {
        # Keys with more rows than this leave the sliding range frames, whose
        # cost per row grows with the frame, for the linear prefix sums.
        "dense_key_rows": 4_000,
        # Keys with more rows than this are split over several tasks in
        # joins and lag windows.
        "hot_key_rows": 5_000_000,
    }
)


def resolve(overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """User settings merged over the defaults."""
    if overrides is not None and not isinstance(overrides, Mapping):
        raise TypeError("settings must be a mapping or None")
    return {**DEFAULTS, **(overrides or {})}


def alert_threshold(agent: str, overrides: Mapping[str, Any] | None = None) -> float:
    """Threshold of one scorer: its own key, then ``alert_threshold``, then 0.5."""
    overrides = overrides or {}
    names = [f"{agent}_alert_threshold"]
    if agent.endswith("_agent"):
        names.append(f"{agent.removesuffix('_agent')}_alert_threshold")
    names.append("alert_threshold")
    for source in (overrides, DEFAULTS):
        for name in names:
            if name in source:
                value = float(source[name])
                if not 0.0 <= value <= 1.0:
                    raise ValueError("alert threshold must be between 0 and 1")
                return value
    return 0.5
