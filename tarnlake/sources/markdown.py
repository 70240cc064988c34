"""SNK-12: records to Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.functions.text import blank_to_null


def titled(title: Column, text: Column, default: str = "Untitled") -> Column:
    """Heading, blank line, text."""
    return F.concat(F.lit("# "), F.coalesce(blank_to_null(title), F.lit(default)), F.lit("\n\n"), F.coalesce(F.trim(text), F.lit("")), F.lit("\n"))


def with_metadata(title: Column, fields: dict[str, Column], text: Column) -> Column:
    """Heading, a list of the fields that have a value, and the text under ``## Content``."""
    rows = F.filter(F.array(*[F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"- {k}: "), v.cast("string"))) for k, v in fields.items()]), lambda x: x.isNotNull())
    meta = F.when(F.size(rows) > 0, F.concat(F.array_join(rows, "\n"), F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# "), F.coalesce(blank_to_null(title), F.lit("Untitled")), F.lit("\n\n"), meta, F.lit("## Content\n\n"), F.coalesce(F.trim(text), F.lit("")), F.lit("\n"))
