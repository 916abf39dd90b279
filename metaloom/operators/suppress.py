"""Suppression: which tables, columns and files are noise. Rows stay, with the reason beside them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.text import any_of, matches_glob, matches_path

TABLE_NOISE = ["*_audit", "*_history", "*_log", "*_journal", "tmp_*", "bkp_*", "bak_*", "vw_*_audit"]
COLUMN_NOISE = ["created_at", "updated_at", "modified_at", "*_at", "*_ts", "*_timestamp", "etag", "row_version", "version", "_partition_*", "sys_*", "tenant_id", "is_deleted", "deleted_at", "created_by", "updated_by", "modified_by"]
#: Beginnings of column names that carry meaning whatever their endings are.
MEANINGFUL = ["birth", "expiry", "expiration", "valuation", "issue", "maturity", "settlement", "value", "as_of", "effective", "report"]
PATH_NOISE = ["tests/**", "test/**", "mocks/**", "fixtures/**", "migrations/**", "vendor/**", "examples/**", "**/__pycache__/**", "**/test_*.py", "**/*_test.py", "**/conftest.py"]
GENERATED = ["# DO NOT EDIT", "# Generated by", "# AUTOGENERATED", "# This file was automatically generated"]


def _first(c: Column, patterns: list[str], match, what: str) -> Column:
    """Reason by the first pattern that matches; null where none does."""
    return F.coalesce(*[F.when(match(c, [p]), F.lit(f"{what} {p}")) for p in patterns], F.lit(None).cast("string"))


def table_reason(name: Column, exclude: list[str] = (), include: list[str] = ()) -> Column:
    """the user's exclusions come first, then the user's inclusions, then the defaults; null keeps."""
    return F.coalesce(_first(name, list(exclude), matches_glob, "excluded by"), F.when(~matches_glob(name, list(include)), _first(name, TABLE_NOISE, matches_glob, "noise")))


def column_reason(name: Column, exclude: list[str] = (), include: list[str] = ()) -> Column:
    """as tables, but a meaningful beginning exempts from the defaults too."""
    exempt = matches_glob(name, list(include)) | any_of([F.startswith(F.lower(name), F.lit(p)) for p in MEANINGFUL])
    return F.coalesce(_first(name, list(exclude), matches_glob, "excluded by"), F.when(~exempt, _first(name, COLUMN_NOISE, matches_glob, "noise")))


def file_reason(path: Column, text: Column, exclude: list[str] = ()) -> Column:
    """the user's paths, the default paths, then marks of generated code in the first five lines."""
    place = F.translate(path, "\\", "/")
    head = F.array_join(F.slice(F.split(text, r"\r\n|\r|\n"), 1, 5), "\n")
    mark = F.coalesce(*[F.when(F.contains(head, F.lit(m)), F.lit(f"generated {m}")) for m in GENERATED])
    return F.coalesce(_first(place, list(exclude), matches_path, "excluded by"), _first(place, PATH_NOISE, matches_path, "noise"), mark)
