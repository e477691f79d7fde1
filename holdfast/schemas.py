"""Explicit table schemas; nothing is ever inferred from data."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType(),
)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_CUSTOMERS = _struct(
    customer_id=_S, gender=_S, senior_citizen=_I, partner=_S, dependents=_S, tenure=_I, phone_service=_S,
    multiple_lines=_S, internet_service=_S, online_security=_S, online_backup=_S, device_protection=_S,
    tech_support=_S, streaming_tv=_S, streaming_movies=_S, contract=_S, paperless_billing=_S,
    payment_method=_S, monthly_charges=_D, total_charges=_D, churn=_S,
)
# a CSV file holds total_charges as text, since blanks occur
CUSTOMER_CSV = T.StructType(
    [T.StructField(f.name, _S if f.name == "total_charges" else f.dataType) for f in RAW_CUSTOMERS]
    + [T.StructField("_corrupt_record", _S)]
)
PROCESSED_CUSTOMERS = _struct(
    customer_id=_S, tenure_group=_S, charge_per_month=_D, services_count=_I, contract_risk_score=_I,
    payment_risk_score=_I, churn_label=_I, churn_probability=_D, risk_segment=_S,
)
RETENTION_COLUMNS = {
    "retention_priority": "string",
    "recommended_action": "string",
    "estimated_revenue_at_risk": "double",
    "days_since_last_score": "int",
}
CHURN_PREDICTIONS = _struct(
    customer_id=_S, churn_probability=_D, risk_segment=_S, model_version=_S, predicted_at=_TS,
    retention_priority=_S, recommended_action=_S, estimated_revenue_at_risk=_D, days_since_last_score=_I,
)
PREDICTION_HISTORY = _struct(
    customer_id=_S, churn_probability=_D, risk_segment=_S, model_version=_S, predicted_at=_TS, archived_at=_TS, id=_L,
)
MODEL_REGISTRY = _struct(
    id=_L, model_name=_S, model_version=_S, accuracy=_D, auc_score=_D, f1_score=_D, trained_at=_TS, is_active=_B,
)
PIPELINE_RUNS = _struct(
    id=_L, pipeline_name=_S, status=_S, rows_processed=_L, duration_seconds=_D, details=_S, run_at=_TS,
)
ALERTS = _struct(id=_L, alert_type=_S, severity=_S, message=_S, created_at=_TS)
TABLES = {
    "raw_customers": RAW_CUSTOMERS,
    "processed_customers": PROCESSED_CUSTOMERS,
    "churn_predictions": CHURN_PREDICTIONS,
    "churn_predictions_history": PREDICTION_HISTORY,
    "model_registry": MODEL_REGISTRY,
    "pipeline_runs": PIPELINE_RUNS,
    "alerts": ALERTS,
}
