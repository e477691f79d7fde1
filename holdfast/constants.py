"""Every number, label and text below must equal the published behaviour."""

# --- columns ---------------------------------------------------------------
REQUIRED_COLUMNS = [
    "customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure", "phone_service",
    "multiple_lines", "internet_service", "online_security", "online_backup", "device_protection",
    "tech_support", "streaming_tv", "streaming_movies", "contract", "paperless_billing",
    "payment_method", "monthly_charges", "total_charges", "churn",
]
NUMERIC_COLUMNS = ["tenure", "monthly_charges", "total_charges"]
CATEGORICAL_COLUMNS = [
    "gender", "partner", "dependents", "phone_service", "multiple_lines", "internet_service",
    "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
    "streaming_movies", "contract", "paperless_billing", "payment_method",
]
ADDON_COLUMNS = [
    "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv",
    "streaming_movies",
]
MODEL_FEATURES = [
    "charge_per_month", "services_count", "contract_risk_score", "payment_risk_score",
    "tenure_group_Established Customer", "tenure_group_Growing Customer",
    "tenure_group_Loyal Customer", "tenure_group_New Customer",
]

# --- category levels -------------------------------------------------------
CONTRACTS = ["Month-to-month", "One year", "Two year"]
_YES_NO = ["No", "Yes"]
_ADDON = ["No", "No internet service", "Yes"]
CATEGORY_LEVELS = {
    "gender": ["Female", "Male"],
    "partner": _YES_NO,
    "dependents": _YES_NO,
    "phone_service": _YES_NO,
    "multiple_lines": ["No", "No phone service", "Yes"],
    "internet_service": ["DSL", "Fiber optic", "No"],
    **{c: _ADDON for c in ADDON_COLUMNS},
    "contract": CONTRACTS,
    "paperless_billing": _YES_NO,
    "payment_method": [
        "Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check",
    ],
}

# --- bins (inclusive upper bounds; the last label is open ended) -------------
TENURE_BOUNDS = [12, 24, 48]
TENURE_LABELS_MODEL = [
    "New Customer", "Growing Customer", "Established Customer", "Loyal Customer",
]
TENURE_LABELS_SQL = ["0-12", "12-24", "24-48", "48+"]
TENURE_MAX = 72
CHARGE_TIER_BOUNDS = [35, 70]
CHARGE_TIERS = ["low", "medium", "high"]

# --- risk ------------------------------------------------------------------
CONTRACT_RISK = {"Month-to-month": 3, "One year": 2, "Two year": 1}
PAYMENT_RISK = {
    "Electronic check": 3,
    "Mailed check": 2,
    "Bank transfer (automatic)": 1,
    "Credit card (automatic)": 1,
}
HIGH_THRESHOLD = 0.7
MEDIUM_THRESHOLD = 0.4
SEGMENTS = ["High", "Medium", "Low"]
LEVEL_ORDER = ["Low", "Medium", "High"]
RETENTION_UPPER = 70
RETENTION_LOWER = 40
RECOMMENDED_ACTIONS = {
    ("High", "Tier1"): "Priority outreach: offer loyalty discount + contract upgrade incentive",
    ("High", "Tier2"): "Standard outreach: satisfaction survey + modest loyalty discount",
    ("High", "Tier3"): "Low-cost outreach: email survey, monitor for escalation",
    ("Medium", None): "Monitor closely; consider proactive engagement before next cycle",
    ("Low", None): "No action needed - monitor periodically",
}
RETENTION_ACTIONS = {
    "High": [
        "Offer a loyalty discount or incentive to switch to a longer-term contract",
        "Assign a customer success rep for proactive outreach this week",
        "Offer a free service add-on (e.g. online security) to increase switching cost",
    ],
    "Medium": [
        "Send a satisfaction survey to identify pain points",
        "Highlight underused services or bundle benefits",
        "Offer a modest loyalty discount tied to contract renewal",
    ],
    "Low": ["No immediate action needed — monitor at the next billing cycle"],
}

# --- value and campaigns -----------------------------------------------------
CLV_MONTH_CAP = 60
CAMPAIGN_COST = 15.0
SUCCESS_RATE = 0.30
MONTHS_PER_YEAR = 12

# --- drift, monitoring, lifecycle ---------------------------------------------
PSI_BUCKETS = 10
PSI_EPSILON = 1e-4
PSI_MODERATE = 0.1
PSI_SIGNIFICANT = 0.2
CHURN_RATE_DRIFT_POINTS = 5.0
SEASONAL_SPREAD_POINTS = 5.0
SCORE_DRIFT_ALERT = 0.1
SEGMENT_SHARE_MIN = 1.0
SEGMENT_SHARE_MAX = 95.0
STALE_DAYS = 7
PROMOTE_AUC_DELTA = 0.01
AUC_FLOOR = 0.85
# 30.44 average days per month, in whole seconds
SECONDS_PER_MONTH = 2_630_016

# --- request validation ----------------------------------------------------
REQUEST_TENURE_MAX = 100
TOTAL_CHARGES_TOLERANCE = 10.0

# --- texts -----------------------------------------------------------------
DRIVER_INSIGHTS = {
    "charge_per_month": "Charge-per-month is the single largest churn driver — target proactive discount or loyalty offers at customers with high historical spend and early risk signals.",
    "tenure_group_New Customer": "New customers (under ~12 months) churn far more than established ones — invest in a structured onboarding / early-engagement program for the first 90 days.",
    "tenure_group_Growing Customer": "Growing-tenure customers (roughly 1-2 years) are a moderate-risk group — a periodic check-in or loyalty milestone offer can reinforce the relationship before it forms.",
    "tenure_group_Established Customer": "Established customers (roughly 2-4 years) are comparatively low risk — maintain service quality rather than heavy discounting.",
    "tenure_group_Loyal Customer": "Loyal customers (4+ years) are the lowest-risk group — focus retention spend elsewhere and consider them for referral/advocacy programs instead.",
    "contract_risk_score": "Contract type is a major lever — incentivize switching from month-to-month to one- or two-year contracts with a meaningful signup discount.",
    "payment_risk_score": "Payment method correlates with churn — encourage enrollment in autopay (bank transfer or credit card) over manual payment methods like electronic/mailed check.",
    "services_count": "Customers with fewer add-on services churn more — bundle or trial promotions that increase service attachment raise switching cost and lower churn risk.",
}
DEFAULT_INSIGHT = "This feature has a measurable effect on churn risk — investigate further."
PROFILE_DEFAULT = "No standout risk levers — this segment looks broadly healthy."
