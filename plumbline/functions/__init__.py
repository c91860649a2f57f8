from plumbline.functions.scalars import (
    calendar_parts,
    customer_segment,
    elapsed_days,
    lookup,
    normalise_names,
    parse_timestamp,
    pct_change,
    plan_value_score,
    recency_score,
    risk_category,
    safe_ratio,
)

__all__ = [
    "calendar_parts", "customer_segment", "elapsed_days", "lookup", "normalise_names", "parse_timestamp",
    "pct_change", "plan_value_score", "recency_score", "risk_category", "safe_ratio",
]
