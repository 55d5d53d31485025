"""Data quality on Spark: scans that report problems and fixes that return a new table."""

from .operators.casts import cast_columns, category_domain
from .operators.categories import apply_mapping, category_columns, harmonise, harmonise_mapping, mapping_effect, variant_groups
from .operators.columns import (
    columns_report, empty_columns, mixed_content, numeric_as_text, rename_clean, rename_columns, sample_values, type_findings,
)
from .operators.correlation import correlation_matrix, correlation_pairs, high_correlations
from .operators.cross_column import cross_column_report, cross_column_samples, fix_cross_column
from .operators.date_ranges import date_range_report, date_range_samples, fix_date_range
from .operators.dates import detect_dates, fit_dates, parse_dates, parse_report
from .operators.duplicates import (
    deduplication_impact, drop_duplicate_rows, duplicate_count, duplicate_samples, identity_duplicates,
)
from .operators.fuzzy import fuzzy_duplicates, fuzzy_report, fuzzy_samples
from .operators.missing import (
    correlated_missing, disguised_report, distribution_change, fill_options, fit_missing, fix_missing, hide_disguised,
    missing_report, missing_rows, missing_summary, mode_values, rows_lost, top_values_change,
)
from .operators.multivariate import fit_mahalanobis, mahalanobis_report, mahalanobis_samples
from .operators.outliers import (
    fit_outlier_fix, fit_outliers, fix_outliers, outlier_report, outlier_samples, outlier_totals, skipped_columns,
)
from .operators.patterns import check_pattern, detect_patterns, pattern_violations
from .operators.profile import (
    categorical_describe, categorical_summary, column_info, fix_effect, min_max, numeric_describe, numeric_summary, overview, preview, status,
)
from .operators.rules import Rule, fix_violations, rule_samples, rules_summary, run_rules, suggest_rules, violating_rows
from .operators.scaling import fit_scale, fix_scale, scaling_report
from .operators.text_values import (
    case_variant_groups, case_variants, clean_text, special_scan, text_samples, text_value_report, whitespace_scan,
)
from .operators.transforms import fit_transform, fix_skew, skew_change, skewness, skewness_report
from .plans.observed import write_fixed
from .plans.result import FixResult
from .plans.scan_all import issue_count, issue_report, scan_all
from .plans.state import ColumnState, TableState, fit_state, remembered
from .plans.stats import numeric_stats
from .sources.readers import load, write_table
from .sources.versions import VersionHistory
from .streaming.row_local import apply_fits

__all__ = [name for name in dir() if not name.startswith("_")]
