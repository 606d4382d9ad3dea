"""Reports as Markdown tables. A report has as many rows as models or runs, so its lines are gathered into one text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import DASH


def number(x: Column, digits: int, missing: str = DASH, before: str = "", after: str = "") -> Column:
    """A number of so many decimals with something around it, or what stands for NULL."""
    return F.when(x.isNull(), missing).otherwise(F.format_string(f"{before}%.{digits}f{after}", x))


def signed(x: Column, digits: int, missing: str = "") -> Column:
    return F.when(x.isNull(), missing).otherwise(F.format_string(f"%+.{digits}f", x))


def markdown(df: DataFrame, cells: dict[str, Column], order: Sequence[Column | str], head: Sequence[str] = ()) -> DataFrame:
    """One row, report: heading lines, the titles, and a line for each row of df in the given order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells.values()), F.lit(" |"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.select(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], line.alias("line")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"])
    return rows.agg(F.concat_ws("\n", *map(F.lit, head), F.lit("| " + " | ".join(cells) + " |"), F.lit("|" + "---|" * len(cells)), lines).alias("report"))


def metric_table(values: dict[str, Column], digits: int = 4) -> Column:
    """A table of two columns in one text, its numbers to the right; NULL is a dash."""
    lines = [F.concat(F.lit(f"| {name} | "), number(x, digits), F.lit(" |")) for name, x in values.items()]
    return F.concat_ws("\n", F.lit("| metric | value |"), F.lit("|--------|------:|"), *lines)


def facts(values: dict[str, Column]) -> Column:
    """One line for each fact that isn't NULL."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"**{name}:** "), x.cast("string")) for name, x in values.items()])


def curve(values: Column, digits: int = 4) -> Column:
    """A curve's values in brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.format_string(f"%.{digits}f", v)), ", "), F.lit("]"))


def sections(title: Column, parts: dict[str, Column]) -> Column:
    """A document: its title, then each part under its heading, an empty heading for none; a part that is NULL is left out with its heading."""
    some = [F.concat(F.lit(f"## {head}\n\n" if head else ""), body) for head, body in parts.items()]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *some)
