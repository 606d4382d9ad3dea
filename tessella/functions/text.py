"""Column functions on names, flags and numbers in reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DASH = "—"
# The words that switch a setting on, and the time suffix of names.
TRUE = ("1", "true", "yes", "on")
TIME = "_[0-9]{4}-[0-9]{2}-[0-9]{2}_[0-9]+$"


def truthy(x: Column) -> Column:
    """Whether a setting is switched on; NULL is off."""
    return F.coalesce(F.lower(F.trim(x)).isin(*TRUE), F.lit(False))


def none_or(x: Column) -> Column:
    """NULL for "none" in any case and for the empty string."""
    return F.when(~F.lower(x).isin("none", ""), x)


def fixed4(x: Column) -> Column:
    """Four decimals, a dash for NULL."""
    return F.when(x.isNull(), DASH).otherwise(F.format_string("%.4f", x))


def without_time(name: Column) -> Column:
    """A name without a trailing _YYYY-MM-DD_n."""
    return F.regexp_replace(name, TIME, "")


def label_of(x: Column) -> Column:
    """The label of label=path, else the path's last part."""
    return F.when(x.contains("="), F.substring_index(x, "=", 1)).otherwise(F.substring_index(x, "/", -1))


def path_of(x: Column) -> Column:
    """The path of label=path."""
    return F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise(x)


def without_suffix(name: Column, suffix: str) -> Column:
    """A name without its suffix, where it has it."""
    return F.when(name.endswith(suffix), F.left(name, F.length(name) - len(suffix))).otherwise(name)


def asset_name(stem: Column, kind: Column, extension: str) -> Column:
    """stem_kind.extension; no kind, no mark of it."""
    return F.concat(F.concat_ws("_", stem, F.nullif(kind, F.lit(""))), F.lit(f".{extension}"))
