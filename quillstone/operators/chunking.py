"""Cutting texts into chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import normalize_text, once, strip

DEFAULT_SIZE = 900
#: Where a window may be cut, in order of preference.
SEPARATORS = ("\n\n", "\n", "；", "。", "，", ",", "、", " ")

#: What `strip` takes from the ends of a text, character by character: control characters, U+0085 and the separators of Unicode.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def sliding(text: Column, size: int = DEFAULT_SIZE, overlap: int = 120) -> Column:
    """Windows of `size` characters (100 at least) that begin size - overlap apart until the text ends; blank texts give none."""
    size = max(100, int(size or DEFAULT_SIZE))
    step = max(1, size - max(0, min(overlap, size - 1)))

    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.char_length(s) - 1, F.lit(0)), F.lit(step))
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(s, i + 1, F.lit(size))))

    return once(strip(text), cut)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = DEFAULT_SIZE, overlap: int = 120) -> DataFrame:
    """One row per chunk: id, chunk_index, chunk_total, chunk, char_count, sha1 and flags."""
    cut = exploded(docs, sliding(F.col(text_col), size, overlap), [id_col])
    limit = max(size, DEFAULT_SIZE) * 1.2
    return cut.select(id_col, "chunk_index", "chunk", F.char_length("chunk").alias("char_count"), F.sha1("chunk").alias("sha1"),
                      (strip(F.col("chunk")) == "").alias("is_empty"), (F.char_length("chunk") < 20).alias("too_short"), (F.char_length("chunk") > limit).alias("too_long"))


def exploded(rows: DataFrame, pieces: Column, keep: Sequence[str], name: str = "chunk") -> DataFrame:
    """The kept columns with chunk_index and each piece; an outer generator, since a plain one would have the pieces made twice."""
    return rows.select(*keep, F.posexplode_outer(pieces).alias("chunk_index", name)).where(F.col(name).isNotNull())


def repeat_flags(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds is_repeat: whether the same digest came before, by id and chunk."""
    order = Window.partitionBy("sha1").orderBy(id_col, "chunk_index")
    return rows.withColumn("is_repeat", F.row_number().over(order) > 1)


def chunk_stats(rows: DataFrame) -> DataFrame:
    """One row: chunks, empty, short and long ones, and distinct digests that repeat."""
    by_digest = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.count_if("is_empty").alias("e"), F.count_if("too_short").alias("s"), F.count_if("too_long").alias("l"))
    return by_digest.agg(F.sum("n").alias("chunk_count"), F.sum("e").alias("empty_text"), F.sum("s").alias("too_short"), F.sum("l").alias("too_long"),
                         F.count_if(F.col("n") > 1).alias("duplicate_hashes"))


def end_of_window(window: Column, separators: Sequence[str]) -> Column:
    """Characters of a window up to and with the last occurrence of the first separator it holds beyond its start; else all of them."""
    ends = []
    for s in separators:
        kept = F.char_length(window) - F.char_length(F.substring_index(window, s, -1))
        ends.append(F.when(F.contains(window, F.lit(s)) & (kept > len(s)), kept))
    return F.coalesce(*ends, F.char_length(window))


def windows(text: Column, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> Column:
    """A stripped text as windows of at most `size` characters that end at separators; each next one begins `overlap` before the end, one character on at least.

    Windows follow from one another, so they are a fold over a number of steps.  As a
    rule twice the windows of full length will do; texts that take more are folded again
    with 16 times as many steps, and then with as many as they have characters.
    """
    def folded(t: Column) -> Column:
        body, n = t["body"], t["n"]

        def fold(steps: Column) -> Column:
            def step(state: Column, _: Column) -> Column:
                def grown(window: Column) -> Column:
                    final = state["start"] + size >= n

                    def added(end: Column) -> Column:
                        piece = F.array_remove(F.array(F.btrim(F.substring(window, F.lit(1), end), F.lit(SPACES))), "")
                        after = F.when(final, n).otherwise(F.greatest(state["start"] + end - overlap, state["start"] + 1))
                        return F.struct(F.concat(state["pieces"], piece).alias("pieces"), after.alias("start"))

                    return once(F.when(final, F.char_length(window)).otherwise(end_of_window(window, separators)), added)

                return F.when(state["start"] >= n, state).otherwise(once(F.substring(body, state["start"] + 1, F.lit(size)), grown))

            return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("start")), step)

        few = (n / max(1, size - overlap)).cast("int") * 2 + 4
        many = once(fold(F.least(16 * few, n)), lambda r: F.when(r["start"] >= n, r["pieces"]).otherwise(fold(n)["pieces"]))
        return once(fold(few), lambda r: F.when(r["start"] >= n, r["pieces"]).otherwise(many))

    # The length is counted once, not in every step.
    return once(F.struct(text.alias("body"), F.char_length(text).alias("n")), folded)


def separated(text: Column, size: int = 950, overlap: int = 120, threshold: int | None = None) -> Column:
    """The stripped text's `windows`; texts up to `threshold` characters (the size if not given) stay whole, blank ones give none."""
    def cut(s: Column) -> Column:
        whole = F.char_length(s) <= (size if threshold is None else max(size, threshold))
        return F.when(s == "", F.array().cast("array<string>")).when(whole, F.array(s)).otherwise(windows(s, size, overlap))

    return once(strip(text), cut)


def packed(segments: Column, size: int, overlap: int) -> Column:
    """An array of (text, page) in order as chunks (text, first, last): neighbours are joined by an empty line while that has at most `size` characters.

    Else a chunk ends, and its last `overlap` characters, stripped, lead the next one if
    they and the segment fit; that chunk's first page is the one where they come from.
    """
    chunk = "struct<text: string, first: int, last: int>"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("open"))

    def of(text: Column, first: Column, last: Column) -> Column:
        return F.struct(text.alias("text"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def add(state: Column, segment: Column) -> Column:
        done, held, page = state["done"], state["open"], segment["page"]
        together = F.concat(held["text"], F.lit("\n\n"), segment["text"])
        tail = strip(F.right(held["text"], F.lit(overlap)))
        led = F.concat(tail, F.lit("\n\n"), segment["text"])
        opened = F.when((tail != "") & (F.char_length(led) <= size), of(led, held["last"], page)).otherwise(of(segment["text"], page, page))
        return (F.when(held.isNull(), F.struct(done.alias("done"), of(segment["text"], page, page).alias("open")))
                .when(F.char_length(together) <= size, F.struct(done.alias("done"), of(together, held["first"], page).alias("open")))
                .otherwise(F.struct(F.concat(done, F.array(held)).alias("done"), opened.alias("open"))))

    return F.aggregate(segments, start, add, lambda r: F.when(r["open"].isNull(), r["done"]).otherwise(F.concat(r["done"], F.array(r["open"]))))


def packed_pages(pages: DataFrame, id_col: str, page_col: str = "page", text_col: str = "text", size: int = 950, overlap: int = 120) -> DataFrame:
    """Pages of each document packed into chunks: (id, chunk_index, chunk, page_start, page_end).

    Page texts are normalised and long ones cut where they are; a document's pieces, no longer than
    `size` each, then meet in one row.  Pages of one number follow one another by their pieces.
    """
    cut = exploded(pages, separated(normalize_text(F.col(text_col)), size, overlap), [id_col, page_col], "piece")
    lists = cut.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(page_col).cast("int").alias("page"), "chunk_index", F.col("piece").alias("text")))).alias("segments"))
    out = exploded(lists, packed(F.col("segments"), size, overlap), [id_col])
    return out.select(id_col, "chunk_index", F.col("chunk.text").alias("chunk"), F.col("chunk.first").alias("page_start"), F.col("chunk.last").alias("page_end"))


def fan_out(products: DataFrame, id_col: str, fields: Sequence[str], threshold: int = 900) -> DataFrame:
    """Documents of each product: one of all fields, and one per non-empty field, split if long.

    (id, doc_type, field_name, chunk_index, doc_id, text, needs_review); a product with at most a third of its fields needs review.
    """
    filled = F.array_compact(F.array(*(F.when(strip(F.col(f)) != "", F.concat(F.lit(f"{f}："), strip(F.col(f)))) for f in fields)))
    review = F.size(filled) <= len(fields) // 3
    full = products.select(id_col, F.lit("product_full").alias("doc_type"), F.lit("full").alias("field_name"), F.lit(0).alias("chunk_index"),
                           F.concat(F.col(id_col).cast("string"), F.lit("__product_full")).alias("doc_id"), F.array_join(filled, "\n").alias("text"), review.alias("needs_review"))
    each = products.select(id_col, review.alias("needs_review"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), strip(F.col(f)).alias("value")) for f in fields))).alias("x"))
    filled_fields = each.where("x.value <> ''").select(id_col, "needs_review", "x.field_name", "x.value")
    parts = (exploded(filled_fields, separated(F.col("value"), threshold=threshold), [id_col, "needs_review", "field_name"], "text")
             .select(id_col, F.lit("product_field").alias("doc_type"), "field_name", "chunk_index",
                     F.format_string("%s__field__%s__%03d", F.col(id_col).cast("string"), "field_name", F.col("chunk_index") + 1).alias("doc_id"), "text", "needs_review"))
    return full.unionByName(parts)


def batches(rows: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Adds batch_no: rows in order, `size` to a batch, within each partition of the key `source`."""
    return rows.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy("source").orderBy(*order)) - 1) / size))


def iter_batches(rows: Sequence, size: int) -> Iterator[Sequence]:
    """Slices of a driver-side list for a provider's request size."""
    return (rows[i:i + size] for i in range(0, len(rows), size))
