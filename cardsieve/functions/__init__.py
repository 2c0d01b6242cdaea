"""Column functions: everything here returns Spark columns and stays inside code generation."""

from .amounts import amount_flags, brand_score, currency_inference, ratio, robust_divide
from .bands import band_order, banded, percentile_class, quantile_bucket
from .calendar import calendar_flags, days_between, event_label, fiscal_year, hour_band, risk_hours, time_features, working_hours
from .labels import approval_status, classify_by_keywords, code_flag, key_concat, keyword_flag, label_map
from .parsing import parse_amount, parse_count_lines, parse_date, parse_labelled_body, parse_localized_timestamp, parse_subject, signature_name, timestamp_of
from .scores import composite_score, interaction_flags, risk_profile, threshold_flags, weighted_score
from .text import fixed_width, normalize_names, normalize_text, normalize_value, row_hash

__all__ = [
    "amount_flags", "approval_status", "band_order", "banded", "brand_score", "calendar_flags", "classify_by_keywords", "code_flag", "composite_score", "currency_inference", "days_between", "event_label", "fiscal_year", "fixed_width", "hour_band", "interaction_flags", "key_concat", "keyword_flag", "label_map", "normalize_names", "normalize_text", "normalize_value", "parse_amount", "parse_count_lines", "parse_date", "parse_labelled_body", "parse_localized_timestamp", "parse_subject", "percentile_class", "quantile_bucket", "ratio", "risk_hours", "risk_profile", "robust_divide", "row_hash", "signature_name", "threshold_flags", "time_features", "timestamp_of", "weighted_score", "working_hours",
]
