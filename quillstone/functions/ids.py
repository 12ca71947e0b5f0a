"""Identities, digests and validated scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_nonblank, normalize_space, safe_text, slug, strip


def sha1_prefix(c: Column, n: int = 40) -> Column:
    return F.substring(F.sha1(safe_text(c)), 1, n)


def valid_sha1(c: Column) -> Column:
    """A 40-digit hex digest, lower-cased; else empty."""
    s = F.lower(strip(c))
    return F.when(s.rlike("^[0-9a-f]{40}$"), s).otherwise("")


def whole_number(c: Column) -> Column:
    """The number without its fraction; null if it isn't one."""
    return strip(c).try_cast("double").try_cast("long")


def posix_path(c: Column) -> Column:
    return F.regexp_replace(F.replace(strip(c), F.lit("\\"), F.lit("/")), r"^\./+", "")


def fingerprint(name: Column, brand: Column, series: Column, spec: Column, manufacturer: Column) -> Column:
    """First 20 hex digits of the SHA-1 of the five fields, white space collapsed, lower-cased, joined by ||."""
    return F.substring(F.sha1(F.lower(F.concat_ws("||", *map(normalize_space, (name, brand, series, spec, manufacturer))))), 1, 20)


def locator(file: Column, sheet: Column, row: Column) -> Column:
    return F.concat_ws("||", strip(file), strip(sheet), strip(row))


def pdf_source_id(sha1: Column) -> Column:
    return F.concat(F.lit("pdf__"), sha1)


def image_source_id(sha1: Column, image_id: Column) -> Column:
    return F.concat(F.lit("imgsrc__"), first_nonblank(sha1, image_id))


def product_source_id(product_id: Column, field: Column) -> Column:
    return F.concat(F.lit("product__"), product_id, F.when(strip(field) != "", F.concat(F.lit("__"), strip(field))).otherwise(""))


def source_id(source_type: Column, sha1: Column) -> Column:
    """The id of a planned source from its type and digest."""
    return F.concat(F.when(source_type == "quality_report", "pdf__").when(source_type == "image", "imgsrc__")
                    .when(source_type == "product_excel", "product_excel__").otherwise("source__"), sha1)


def field_doc_id(product_id: Column, field: Column, number: Column) -> Column:
    return F.format_string("%s__field__%s__%03d", product_id, field, number)


def supplement_doc_id(canonical: Column, tag: str, sha1: Column, local: Column, section: Column, number: Column) -> Column:
    return F.format_string(f"supp__%s__{tag}__%s__%s__%s__%03d", canonical, F.substring(sha1, 1, 12), local, slug(section, 48), number)


def new_product_doc_id(canonical: Column, sha1: Column, name: Column, section: Column, number: Column) -> Column:
    return F.format_string("newprod__%s__%s__%s__%s__%03d", canonical, F.substring(sha1, 1, 12), slug(name, 48), slug(section, 48), number)


def image_id(readable: Column, sha1: Column) -> Column:
    return F.concat(F.lit("img_"), slug(readable), F.lit("_"), F.substring(sha1, 1, 12))


def preview_source_id(prefix: Column, sha1: Column) -> Column:
    return F.concat(F.substring(slug(prefix), 1, 64), F.lit("__"), F.substring(sha1, 1, 12))


def row_number_of(id_: Column) -> Column:
    """The row number at the end of an id like x_r12; null if it has none."""
    return F.regexp_extract(safe_text(id_), r"_r(\d+)$", 1).try_cast("int")


def valid_vector(v: Column, dimensions: int) -> Column:
    """Whether a vector has the wanted size and only finite numbers."""
    return v.isNotNull() & (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def sniff_media(b: Column) -> Column:
    """Media type from a file's first bytes."""
    h = F.hex(F.substring(b, 1, 12))
    return (F.when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("474946"), "image/gif")
            .when(h.startswith("424D"), "image/bmp").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")
            .otherwise("application/octet-stream"))
