"""Typed errors with stable codes (raised at plan-build time, before any job runs)."""

from __future__ import annotations


class TermLensError(Exception):
    """Base error; ``code`` is a stable machine-readable identifier."""

    code = "termlens_error"


class UnsupportedFormatError(TermLensError, ValueError):
    code = "unsupported_format"


class MissingDicTermColumnError(TermLensError, ValueError):
    code = "missing_dicterm_column"


class NoCategoryColumnsError(TermLensError, ValueError):
    code = "no_category_columns"


class NoTextColumnError(TermLensError, ValueError):
    code = "no_text_column"


class AnalysisConfigError(TermLensError, ValueError):
    code = "analysis_config_error"


class UnknownCategoryError(TermLensError, KeyError):
    code = "unknown_category"


class UnknownColumnError(TermLensError, KeyError):
    code = "unknown_column"


class StatisticsError(TermLensError, ValueError):
    code = "statistics_error"


def require_columns(df_columns: list[str], wanted: list[str] | tuple[str, ...]) -> None:
    """Raise :class:`UnknownColumnError` if any wanted column is absent (case-insensitive, as Spark)."""
    have = {c.lower() for c in df_columns}
    missing = [c for c in wanted if c.lower() not in have]
    if missing:
        raise UnknownColumnError(f"unknown column(s): {missing}; available: {list(df_columns)}")
