"""Imports every query module, so that the registry is complete."""

from checks import q_cohorts, q_drift, q_explain, q_features, q_history, q_jobs, q_models, q_quality, q_summaries, q_training, q_value  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
