"""Metadata of any shape as VARIANT values: parsed once, read by path, without a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import safe_text


def metadata(c: Column) -> Column:
    """JSON text as a variant; what is null, malformed or not an object is an empty object."""
    v = F.try_parse_json(safe_text(c))
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), v), F.parse_json(F.lit("{}")))


def field(meta: Column, path: str, kind: str = "string") -> Column:
    """The value at a path ($.a.b[0]); null where there is none or it isn't of that kind.  Objects and lists read as text are JSON."""
    return F.try_variant_get(meta, path, kind)


def member(meta: Column, name: str) -> Column:
    """A member of the object as text; its name may have any signs but quotes of both kinds."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"no path names a member with both quotes: {name}")
    return field(meta, f"$[{quote}{name}{quote}]")


def overlaid(rows: DataFrame, meta_col: str, columns: Sequence[str]) -> DataFrame:
    """rows in which null or empty values of the columns are the metadata's; columns that rows lack are the metadata's throughout.

    Metadata is parsed once a row.
    """
    meta = F.col("parsed_metadata")
    taken = {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), member(meta, c)) if c in rows.columns else member(meta, c) for c in columns}
    return rows.withColumn("parsed_metadata", metadata(F.col(meta_col))).withColumns(taken).drop("parsed_metadata")


def members(rows: DataFrame, meta_col: str) -> DataFrame:
    """(name, kind, n): the members that the metadata objects have, their kinds as SQL types, and in how many rows."""
    parsed = rows.select(metadata(F.col(meta_col)).alias("m"))
    listed = parsed.select(F.explode(F.map_entries(F.try_variant_get("m", "$", "map<string,variant>"))).alias("e"))
    return listed.groupBy(F.col("e.key").alias("name"), F.schema_of_variant("e.value").alias("kind")).agg(F.count("*").alias("n"))
