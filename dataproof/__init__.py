"""Reproducible dataset evidence on Spark: profile, query, chart, compare, research, report."""

from dataproof.operators.charts import Chart, chart_data
from dataproof.operators.compare import Comparison, compare_datasets, key_overlap, schema_diff
from dataproof.operators.profile import Profile, column_statistics, profile_dataset
from dataproof.operators.reports import build_reports, verify_reports
from dataproof.operators.research import (
    Research,
    correlations,
    duplicate_rows,
    monthly_trend,
    outliers,
    research_dataset,
)
from dataproof.plans.read_only import PolicyError
from dataproof.plans.select import SelectResult, safe_select
from dataproof.session import build_session, shared_dir
from dataproof.sources.artifacts import get_artifacts, put_artifacts, verify_artifacts
from dataproof.sources.manifest import dataset_manifest
from dataproof.sources.readers import read_dataset
from dataproof.sources.urls import redact_url, screen_source_urls
from dataproof.sources.validation import validate_files

__all__ = [
    "Chart",
    "Comparison",
    "PolicyError",
    "Profile",
    "Research",
    "SelectResult",
    "build_reports",
    "build_session",
    "chart_data",
    "column_statistics",
    "compare_datasets",
    "correlations",
    "dataset_manifest",
    "duplicate_rows",
    "get_artifacts",
    "key_overlap",
    "monthly_trend",
    "outliers",
    "profile_dataset",
    "put_artifacts",
    "read_dataset",
    "redact_url",
    "research_dataset",
    "safe_select",
    "schema_diff",
    "screen_source_urls",
    "shared_dir",
    "validate_files",
    "verify_artifacts",
    "verify_reports",
]
