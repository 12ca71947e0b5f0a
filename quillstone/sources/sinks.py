"""Writers: JSON lines, CSV with a byte order mark, keyed tables, batch artifacts and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from quillstone.operators.manifest import normalize, upsert


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_manifest(records: DataFrame, path: str) -> None:
    """Append normalised records to the log."""
    normalize(records).write.mode("append").json(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nested columns as JSON; each file's first header begins with a byte order mark."""
    flat = df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema.fields))
    if flat.columns:
        flat = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    flat.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def upsert_table(spark: SparkSession, new: DataFrame, name: str, id_col: str = "id") -> None:
    """Put new rows in place of old ones of the same id; the table is written anew beside itself, then swapped."""
    if not spark.catalog.tableExists(name):
        new.dropDuplicates([id_col]).write.saveAsTable(name)
        return
    merged = upsert(spark.table(name), new.dropDuplicates([id_col]), id_col)
    merged.write.mode("overwrite").saveAsTable(f"{name}__next")
    spark.table(f"{name}__next").write.mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}__next")


def delete_and_verify(spark: SparkSession, ids: DataFrame, name: str, id_col: str = "id") -> DataFrame:
    """Delete ids from a table; (id, status): deleted, already_missing or failed."""
    asked = ids.select(id_col).distinct()
    before = spark.table(name).select(id_col, F.lit(True).alias("was")).distinct()
    spark.table(name).join(asked, id_col, "left_anti").write.mode("overwrite").saveAsTable(f"{name}__next")
    status = asked.join(before, id_col, "left").join(spark.table(f"{name}__next").select(id_col, F.lit(True).alias("still")).distinct(), id_col, "left").select(
        id_col, F.when(F.col("still"), "failed").when(F.col("was"), "deleted").otherwise("already_missing").alias("status"))
    status.write.mode("overwrite").saveAsTable(f"{name}__status")
    spark.table(f"{name}__next").write.mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}__next")
    return spark.table(f"{name}__status")


def artifact(df: DataFrame, root: str, batch_id: str, stage: str) -> str:
    """Write a stage's rows in the batch's folder; names that would leave it are refused."""
    if any(p in ("", ".", "..") or "/" in p for p in (batch_id, stage)):
        raise ValueError("batch and stage must be plain names")
    path = f"{root.rstrip('/')}/{batch_id}/{stage}"
    df.write.mode("overwrite").json(path)
    return path


def last_runs(log: DataFrame, n: int = 20) -> DataFrame:
    """The n latest run records: a report."""
    return log.orderBy(F.desc("started_at")).limit(n)


def report(title: str, counts: DataFrame, columns: Sequence[str], most: int = 1000) -> str:
    """A Markdown table of an aggregate, at most `most` rows, for people."""
    rows = counts.select(*columns).limit(most).collect()
    head = f"# {title}\n\n| {' | '.join(columns)} |\n| {' | '.join('---' for _ in columns)} |\n"
    return head + "".join(f"| {' | '.join(str(v) for v in r)} |\n" for r in rows)


def object_urls(files: DataFrame, base: str, prefix: str = "", path_col: str = "path") -> DataFrame:
    """Adds key and url: where each file would be in an object store, percent-encoded."""
    key = F.concat(F.lit(prefix), F.regexp_replace(path_col, r"^[./]+", ""))
    quoted = F.replace(F.replace(F.url_encode(key), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return files.withColumn("key", key).withColumn("url", F.concat(F.lit(base.rstrip("/") + "/"), quoted))


def review_workbook(rows: DataFrame, path: str, choices: dict[str, Sequence[str]], most: int = 100_000) -> None:
    """A workbook for people with drop-down choices; refused above `most` rows, since it is made on the driver."""
    from openpyxl import Workbook
    from openpyxl.worksheet.datavalidation import DataValidation

    got = rows.limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"a workbook holds at most {most} rows")
    book = Workbook()
    sheet = book.active
    sheet.append(list(got.columns))
    for r in got.itertuples(index=False):
        sheet.append([str(v) if isinstance(v, (list, dict)) else v for v in r])
    for column, values in choices.items():
        rule = DataValidation(type="list", formula1='"' + ",".join(values) + '"')
        sheet.add_data_validation(rule)
        letter = sheet.cell(1, list(got.columns).index(column) + 1).column_letter
        rule.add(f"{letter}2:{letter}{len(got) + 1}")
    book.save(path)
