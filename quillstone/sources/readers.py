"""Readers: JSON lists, JSON lines, CSV, files, manifests, url maps, workbooks and PDF pages.

All readers take any path that Spark reads.  Strict readers fail on a bad row and
lenient ones drop it.  Workbooks and PDFs need openpyxl and pypdf on the executors.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.functions.extract import text_quality
from quillstone.functions.ids import posix_path, sniff_media
from quillstone.functions.text import normalize_space, normalize_text, once, strip

CORRUPT = "_corrupt_record"


def with_corrupt(schema: StructType | str) -> StructType:
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return StructType([*schema.fields]).add(CORRUPT, "string")


def json_list(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """A file that holds one JSON list of objects."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of non-blank lines that aren't JSON objects."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    parsed = F.try_parse_json(F.col("text"))
    return lines.where((strip(F.col("text")) != "") & (parsed.isNull() | ~F.schema_of_variant(F.coalesce(parsed, F.parse_json(F.lit("0")))).startswith("OBJECT")))


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with a header, all text; a byte order mark is dropped, empty cells are empty texts."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path).na.fill("")


def optional(read, spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What the reader gives, or an empty table if the path doesn't exist."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return read(spark, path, schema) if there else spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str, suffixes: Sequence[str], content: bool = False) -> DataFrame:
    """(path, name, length, modificationTime[, content]) of files below a path by suffix, without office temporary files."""
    glob = "*.{" + ",".join([*suffixes, *(s.upper() for s in suffixes)]) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    cols = ["path", name.alias("name"), "length", "modificationTime", *(["content"] if content else [])]
    return found.select(*cols).where(~F.col("name").startswith("~$"))


def hashed_files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """Files with the SHA-1 of their content."""
    return files(spark, path, suffixes, content=True).withColumn("source_sha1", F.sha1("content")).drop("content")


def url_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, url) from one JSON object of path -> url or path -> {image_path, image_url}."""
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    inner = F.from_json(F.when(F.col("v").startswith("{"), F.col("v")), "image_path string, image_url string")
    return entries.select(posix_path(F.coalesce(inner["image_path"], F.col("k"))).alias("path"), F.coalesce(inner["image_url"], F.when(~F.col("v").startswith("{"), F.col("v")), F.lit("")).alias("url"))


def image_index(products: DataFrame) -> DataFrame:
    """(product_id, primary_path, paths): the primary image first, each path once."""
    paths = F.array_distinct(F.filter(F.concat(F.array("primary_image_path"), "image_paths"), lambda p: strip(p) != ""))
    return products.where(strip(F.col("product_id")) != "").select("product_id", F.col("primary_image_path").alias("primary_path"), paths.alias("paths"))


def legacy_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a manifest that is a JSON list or an object of path -> record; the last of a path wins."""
    text = spark.read.option("wholetext", True).text(path)
    listed = text.where(F.trim("value").startswith("[")).select(F.posexplode(F.from_json("value", f"array<struct<{schema_fields(schema)}>>")).alias("seq", "r"))
    keyed = text.where(F.trim("value").startswith("{")).select(F.posexplode(F.map_values(F.from_json("value", f"map<string,struct<{schema_fields(schema)}>>"))).alias("seq", "r"))
    rows = listed.unionByName(keyed)
    return rows.groupBy("r.relative_path").agg(F.max_by("r", "seq").alias("r")).select("r.*").orderBy("relative_path")


def schema_fields(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def payload_rows(spark: SparkSession, path: str, field: str, row_schema: str) -> DataFrame:
    """Rows of an array inside one JSON object, such as rows or candidates."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"struct<{field}: array<struct<{schema_fields(row_schema)}>>>")[field]).alias("r")).select("r.*")


def ordered_union(parts: Sequence[DataFrame], limit: int | None, order: str) -> DataFrame:
    """Sources one after the other with one limit over all; the limit is the feature's."""
    tagged = [p.withColumn("source_order", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out if limit is None else out.orderBy("source_order", order).limit(limit)


def table_name(spark: SparkSession, candidates: Sequence[str], needs: str | None = None) -> str:
    """The first existing table, which must have the column `needs` if one is named."""
    for name in candidates:
        if spark.catalog.tableExists(name) and (needs is None or needs in spark.table(name).columns):
            return name
    raise LookupError(f"none of {', '.join(candidates)} exists" + (f" with a column {needs}" if needs else ""))


def vector_dimension(df: DataFrame, column: str = "embedding") -> int | None:
    """The one size of a vector column; null if it has none or several."""
    row = df.agg(F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")).first()
    return row["lo"] if row["lo"] is not None and row["lo"] == row["hi"] else None


#: Schema of the previewed documents.
PREVIEW = "document_id string, title string, source_id string, text string, text_length int"


def csv_records(raw: Column) -> Column:
    """The records of a CSV text as arrays of cells; quoted cells may hold commas, doubled quotes and line ends; blank records go."""
    lines = F.regexp_extract_all(F.concat(raw, F.lit("\n")), F.lit(r'((?:"(?:[^"]|"")*+"|[^"\r\n])*+)(?:\r\n|\n|\r)'), 1)

    def cells(line: Column) -> Column:
        found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'((?:\s*+"(?:[^"]|"")*+"[^,]*+)|[^,]*+),'), 1)
        return F.transform(found, lambda c: F.when(strip(c).startswith('"'), F.replace(F.regexp_replace(strip(c), r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))

    return F.transform(F.filter(lines, lambda x: strip(x) != ""), cells)


def preview(kind: Column, raw: Column, title: Column, source_id: Column) -> Column:
    """Documents of a pasted source: plain text gives one, JSON one per object of a list, CSV one per row with `header：cell` lines."""
    items = F.coalesce(F.from_json(F.when(F.trim(raw).startswith("["), raw), "array<string>"), F.when(F.trim(raw).startswith("{"), F.array(raw)), F.array().cast("array<string>"))

    def rows(records: Column) -> Column:
        head = F.try_element_at(records, F.lit(1))
        pairs = F.transform(F.slice(records, 2, 1 << 30), lambda row: F.zip_with(head, row, lambda h, c: F.when(strip(c) != "", F.concat(strip(h), F.lit("："), strip(c)))))
        return F.transform(pairs, lambda p: F.array_join(F.filter(p, lambda x: x.isNotNull()), "\n"))

    texts = F.when(kind == "json", items).when(kind == "csv", once(csv_records(raw), rows)).otherwise(F.array(raw))
    kept = F.filter(F.transform(texts, strip), lambda x: x != "")
    return F.transform(kept, lambda x, i: F.struct(F.format_string("%s__doc_%04d", source_id, i + 1).alias("document_id"), title.alias("title"), source_id.alias("source_id"), x.alias("text"),
                                                    F.char_length(x).alias("text_length")))


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, column, value) of every workbook below a path; merged cells repeat their first cell's value."""
    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from openpyxl import load_workbook

        for batch in parts:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for sheet in load_workbook(io.BytesIO(content), data_only=True).worksheets:
                    merged = {(r, c): sheet.cell(m.min_row, m.min_col).value for m in sheet.merged_cells.ranges for r in range(m.min_row, m.max_row + 1) for c in range(m.min_col, m.max_col + 1)}
                    for row in sheet.iter_rows():
                        for cell in row:
                            value = merged.get((cell.row, cell.column), cell.value)
                            if value is not None:
                                rows.append((where, sheet.title, cell.row, cell.column, str(value)))
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "column", "value"])

    return files(spark, path, ["xlsx", "xlsm"], content=True).select("path", "content").mapInPandas(cells, "path string, sheet string, row int, column int, value string")


#: Words that headers have.
HEADER_WORDS = ("产品", "包装", "规格", "档次", "定位", "图片", "渠道", "酒质", "酒厂", "寓意", "竞品", "卖点", "设计理念", "故事", "香型")


def header_rows(cells: DataFrame, aliases: dict[str, str], first_rows: int = 10) -> DataFrame:
    """(path, sheet, header_row): the row of the first ten that best looks like a header.

    One point for each distinct text (12 at most), 8 for each mapped cell, 2 for each other
    cell of up to 20 characters with a header's word, -2 for each of 50 or more; -20 for four
    cells or more with at most two texts, -50 in all for six or more of one text.  The
    first row of most points, then most mapped cells, with 10 points and two mapped cells.
    """
    v = strip(F.col("value"))
    known = F.lower(normalize_space(F.col("value"))).isin(*aliases)
    said = v.rlike("|".join(HEADER_WORDS)) & (F.char_length(v) <= 20)
    row = cells.where((F.col("row") <= first_rows) & (v != "")).groupBy("path", "sheet", "row").agg(
        F.count_if(known).alias("mapped"), F.count_if(~known & said).alias("said"), F.count_if(F.char_length(v) >= 50).alias("long"), F.countDistinct(v).alias("kinds"), F.count("*").alias("n"))
    points = F.least("kinds", F.lit(12)) + 8 * F.col("mapped") + 2 * F.col("said") - 2 * F.col("long") - F.when((F.col("kinds") <= 2) & (F.col("n") >= 4), 20).otherwise(0)
    one = (F.col("kinds") == 1) & (F.col("n") >= 6)
    scored = row.select("path", "sheet", "row", F.when(one, -50).otherwise(points).alias("score"), F.when(one, 0).otherwise(F.col("mapped")).alias("mapped"))
    best = scored.groupBy("path", "sheet").agg(F.max(F.struct("score", "mapped", (-F.col("row")).alias("up"))).alias("b"))
    return best.where("b.score >= 10 AND b.mapped >= 2").select("path", "sheet", (-F.col("b.up")).alias("header_row"))


def sheet_records(cells: DataFrame, aliases: dict[str, str], name_field: str = "product_name") -> DataFrame:
    """(path, sheet, row, fields map, extra map) below each sheet's header; rows without a product name go."""
    heads = header_rows(cells, aliases)
    mapping = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    titles = cells.join(heads, ["path", "sheet"]).where(F.col("row") == F.col("header_row")).select("path", "sheet", "column", "header_row", F.col("value").alias("header"),
                                                                                                     mapping[F.lower(normalize_space(F.col("value")))].alias("field"))
    body = cells.join(titles, ["path", "sheet", "column"]).where(F.col("row") > F.col("header_row"))
    entry = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value")))
    extra = F.collect_list(F.when(F.col("field").isNull(), F.struct("header", "value")))
    rows = body.dropDuplicates(["path", "sheet", "row", "header"]).groupBy("path", "sheet", "row").agg(
        F.map_from_entries(F.array_distinct(entry)).alias("fields"), F.map_from_entries(F.array_distinct(extra)).alias("extra"))
    return rows.where(strip(F.col("fields")[name_field]) != "")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text) of every PDF below a path; pages that can't be read are empty."""
    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for batch in parts:
            rows = []
            for where, content in zip(batch["path"], batch["content"], strict=True):
                for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
                    try:
                        text = page.extract_text() or ""
                    except Exception:  # a damaged page counts as empty
                        text = ""
                    rows.append((where, number, text))
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    found = files(spark, path, ["pdf"], content=True).select("path", "content").mapInPandas(pages, "path string, page int, text string")
    return found.withColumn("text", normalize_text(F.col("text"), wide_spaces=True))


def ocr_pages(pages: DataFrame, provider_ocr, id_col: str = "path") -> DataFrame:
    """Pages with OCR text where the file's own text is too poor; provider_ocr takes (path, page) and returns text.

    Quality is judged per file over all of its pages; only pages of poor files reach the provider.
    """
    whole = pages.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("all"))
    poor = whole.select(id_col, (~text_quality(F.col("all"))).alias("poor"))
    marked = pages.join(poor, id_col)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            yield rows.assign(text=[provider_ocr(p, n) for p, n in zip(rows[id_col], rows["page"], strict=True)])

    kind = pages.schema[id_col].dataType.simpleString()
    fine = marked.where("NOT poor").select(id_col, "page", "text")
    return fine.unionByName(marked.where("poor").select(id_col, "page", "text").mapInPandas(read, f"{id_col} {kind}, page int, text string"))


def embedded_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, column, image, image_sha1) of pictures anchored in workbooks."""
    def pictures(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from openpyxl import load_workbook

        for batch in parts:
            rows = []
            for where, content in zip(batch["path"], batch["content"], strict=True):
                for sheet in load_workbook(io.BytesIO(content)).worksheets:
                    for picture in getattr(sheet, "_images", []):
                        start = picture.anchor._from
                        rows.append((where, sheet.title, start.row + 1, start.col + 1, picture._data()))
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "column", "image"])

    found = files(spark, path, ["xlsx", "xlsm"], content=True).select("path", "content").mapInPandas(pictures, "path string, sheet string, row int, column int, image binary")
    return found.withColumn("image_sha1", F.sha1("image"))


def bound_images(images: DataFrame, products: DataFrame) -> DataFrame:
    """Images with the product of their cell's row: status matched or unmatched, and the media type of the bytes."""
    keys = products.select(F.col("source_file").alias("path"), F.col("source_sheet").alias("sheet"), F.col("source_row").cast("int").alias("row"), "product_id")
    return images.join(keys, ["path", "sheet", "row"], "left").withColumns({"status": F.when(F.col("product_id").isNotNull(), "matched").otherwise("unmatched"), "media_type": sniff_media(F.col("image"))})


def needs_mapping(cells: DataFrame, most_rows: int = 5, most_cells: int = 12) -> DataFrame:
    """One row per sheet that has no products yet: rows and a preview of the first of them (the preview's size is the feature)."""
    row = cells.where(strip(F.col("value")) != "").groupBy("path", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("c"))
    row = row.withColumn("shown", F.slice(F.transform("c", lambda x: x["value"]), 1, most_cells))
    first = F.min_by("row", "row")
    counts = row.groupBy("path", "sheet").agg(F.count("*").alias("row_count"), first.alias("first_row"))
    ahead = row.join(counts.select("path", "sheet", "first_row"), ["path", "sheet"]).where(F.col("row") < F.col("first_row") + most_rows)
    previews = ahead.groupBy("path", "sheet").agg(F.array_sort(F.collect_list(F.struct("row", "shown"))).alias("preview"))
    source = F.concat(F.lit("product_excel__"), F.substring(F.sha1(F.concat("path", F.lit("::"), "sheet")), 1, 24))
    return counts.join(previews, ["path", "sheet"]).select("path", "sheet", source.alias("source_doc_id"), F.lit("needs_mapping").alias("status"), "row_count", "preview")
