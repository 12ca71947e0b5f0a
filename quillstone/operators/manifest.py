"""The append-only manifest of ingested sources: normalisation, latest state, rollups, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import safe_text, strip

#: The manifest's fields by kind.
TEXT_FIELDS = ("source_doc_id", "source_path", "source_sha1", "source_type", "product_id", "embedding_model", "status", "status_detail", "event_type", "push_status",
               "push_detail", "pushed_at", "verify_status", "retrieval_status", "verified_at", "delete_mode", "delete_status", "deleted_at", "created_at", "updated_at")
LIST_FIELDS = ("generated_doc_ids", "vector_tables", "pushed_doc_ids", "verified_doc_ids", "missing_doc_ids", "target_indexes", "requested_doc_ids", "deleted_doc_ids",
               "already_missing_doc_ids", "failed_doc_ids")
DEFAULTS = {"product_id": "unknown", "status": "planned"}


def normalize(records: DataFrame) -> DataFrame:
    """The closed field list: unknown columns go, texts are stripped, lists lose blanks, counts become whole numbers, times default to now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    out = []
    for f in TEXT_FIELDS:
        c = strip(F.col(f)) if f in records.columns else F.lit("")
        other = now if f in ("created_at", "updated_at") else F.lit(DEFAULTS.get(f, ""))
        out.append(F.when(c != "", c).otherwise(other).alias(f))
    for f in LIST_FIELDS:
        c = F.coalesce(F.col(f), F.array().cast("array<string>")) if f in records.columns else F.array().cast("array<string>")
        out.append(F.filter(F.transform(c, strip), lambda x: x != "").alias(f))
    count = F.coalesce(safe_text(F.col("warning_count")).try_cast("int"), F.lit(0)) if "warning_count" in records.columns else F.lit(0)
    return records.select(*out, count.alias("warning_count"))


def latest(records: DataFrame, key: Sequence[str], time: str = "updated_at", tie: str = "seq") -> DataFrame:
    """The last record of each key by time, then by tie."""
    order = F.struct(F.col(time), F.col(tie))
    return records.groupBy(*key).agg(F.max_by(F.struct(*[c for c in records.columns if c not in key]), order).alias("r")).select(*key, "r.*")


def lookup(records: DataFrame, source_doc_id: str = "", source_sha1: str = "", source_path: str = "") -> DataFrame:
    """Records that match any of the given keys."""
    tests = [F.col(c) == v for c, v in (("source_doc_id", source_doc_id), ("source_path", source_path)) if v]
    if source_sha1:
        tests.append(F.lower("source_sha1") == source_sha1.lower())
    out = F.lit(False)
    for t in tests:
        out = out | t
    return records.where(out)


def rollup(records: DataFrame) -> DataFrame:
    """Counts by status and by type in long form: (what, value, n)."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.when(strip(F.col(c)) != "", strip(F.col(c))).otherwise("unknown").alias("value")) for c in ("status", "source_type"))))
    return records.select(each.alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def several(records: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct non-blank value: (key, n_values, n_records)."""
    clean = records.where((strip(F.col(key)) != "") & (strip(F.col(value)) != ""))
    pairs = clean.groupBy(key, value).agg(F.count("*").alias("n"))
    return pairs.groupBy(key).agg(F.count("*").alias("n_values"), F.sum("n").alias("n_records")).where("n_values > 1")


def plan_actions(plan: DataFrame, manifest: DataFrame) -> DataFrame:
    """What to do with each planned source: new, unchanged, changed, duplicate_content or unknown.

    Both have source_doc_id, source_sha1 and source_path; the manifest also status, updated_at and seq.
    """
    doc = latest(manifest.where(strip(F.col("source_doc_id")) != ""), ["source_doc_id"]).select("source_doc_id", F.lower("source_sha1").alias("doc_sha1"), F.col("status").alias("doc_status"))
    path = latest(manifest.where(strip(F.col("source_path")) != ""), ["source_path"]).select("source_path", F.lower("source_sha1").alias("path_sha1"))
    sha = (manifest.where(strip(F.col("source_sha1")) != "").groupBy(F.lower("source_sha1").alias("sha_key"))
           .agg(F.max((F.col("status") == "success").cast("int")).alias("sha_ok")))
    mine = F.lower(strip(F.col("source_sha1")))
    joined = plan.withColumn("sha_key", mine).join(doc, "source_doc_id", "left").join(path, "source_path", "left").join(sha, "sha_key", "left")
    action = (F.when((strip(F.col("source_doc_id")) == "") | (F.col("sha_key") == ""), "unknown")
              .when(F.col("doc_sha1") == F.col("sha_key"), F.when(F.col("doc_status") == "success", "unchanged").otherwise("new"))
              .when(F.col("doc_sha1").isNotNull(), "changed").when(F.col("path_sha1") != F.col("sha_key"), "changed")
              .when(F.col("sha_ok") == 1, "duplicate_content").when(F.col("sha_ok").isNotNull(), "unknown").otherwise("new"))
    return joined.withColumn("suggested_action", action).withColumns({"is_seen_source_doc_id": F.col("doc_sha1").isNotNull(), "is_seen_source_sha1": F.col("sha_ok").isNotNull()}) \
        .drop("sha_key", "doc_sha1", "doc_status", "path_sha1", "sha_ok")


def to_process(plan: DataFrame, force: bool = False) -> DataFrame:
    """Sources that still need work."""
    return plan if force else plan.where(~F.col("suggested_action").isin("unchanged", "duplicate_content"))


def source_type(path: Column, explicit_file: bool = False) -> Column:
    """The kind of source a path names; null for temporary files and anything else."""
    name, first, suffix = F.element_at(F.split(path, "/"), -1), F.split(path, "/")[0], F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    sheet, pdf = suffix.isin("xlsx", "xls", "xlsm"), suffix == "pdf"
    if not explicit_file:
        sheet, pdf = sheet & first.isin("素材", "产品信息"), pdf & (first == "质检报告")
    return F.when(name.startswith("~$"), None).when(sheet, "product_excel").when(pdf, "quality_report_pdf")


def impacts(kind: Column) -> Column:
    return (F.when(kind == "product_excel", F.array(*map(F.lit, ("product_text", "image_text", "image_vector"))))
            .when(kind == "quality_report_pdf", F.array(*map(F.lit, ("quality_report", "product_text")))).otherwise(F.array().cast("array<string>")))


def vector_tables(kind: Column) -> Column:
    return (F.when(kind == "product_excel", F.array(*map(F.lit, ("text_docs", "image_text_docs", "image_vectors"))))
            .when(kind == "quality_report_pdf", F.array(F.lit("text_docs"))).otherwise(F.array().cast("array<string>")))


def embedding_plan(docs: DataFrame, existing: DataFrame, model: str, force: bool = False) -> DataFrame:
    """Documents to embed with their status new, changed or existing; those embedded with the same content are skipped unless forced.

    docs has doc_id and content_sha1; existing also embedding_model.
    """
    own = existing.where((F.col("embedding_model") == model) & (strip(F.col("content_sha1")) != ""))
    exact = own.select("doc_id", "content_sha1", F.lit(True).alias("same")).distinct()
    known = own.select("doc_id", F.lit(True).alias("known")).distinct()
    joined = docs.join(exact, ["doc_id", "content_sha1"], "left").join(known, "doc_id", "left")
    status = F.when(F.col("same"), "existing").when(F.col("known"), "changed").otherwise("new")
    out = joined.withColumn("embedding_plan_status", status).drop("same", "known")
    return out if force else out.where(F.col("embedding_plan_status") != "existing")


def push_plan(records: DataFrame, stored: DataFrame, force: bool = False, skip_existing: bool = True) -> DataFrame:
    """Each record's fate: new, upsert or skip; is_duplicate tells ids that the batch holds more than once."""
    there = stored.select("doc_id", F.lit(True).alias("there")).distinct()
    again = records.groupBy("doc_id").agg((F.count("*") > 1).alias("is_duplicate"))
    known = F.lit("upsert" if force or not skip_existing else "skip")
    return records.join(there, "doc_id", "left").join(again, "doc_id").withColumn("push_action", F.when(F.col("there"), known).otherwise("new")).drop("there")


def found_missing(requested: DataFrame, stored: DataFrame, required: Sequence[str]) -> DataFrame:
    """Requested ids with status found or missing and the number of required fields that are empty."""
    gaps = sum((F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", 1).otherwise(0) for c in required), F.lit(0))
    got = stored.select("doc_id", gaps.alias("warnings"), F.lit(True).alias("there"))
    return requested.select("doc_id").join(got, "doc_id", "left").select("doc_id", F.when(F.col("there"), "found").otherwise("missing").alias("status"),
                                                                         F.coalesce("warnings", F.lit(0)).alias("warnings"))


def target_diff(targets: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, status): target ids not stored are missing; stored ids that are no target are unknown."""
    missing = targets.select("doc_id").distinct().join(stored.select("doc_id"), "doc_id", "left_anti").withColumn("status", F.lit("missing"))
    unknown = stored.select("doc_id").distinct().join(targets.select("doc_id"), "doc_id", "left_anti").withColumn("status", F.lit("unknown"))
    return missing.unionByName(unknown)


def unique_assignment(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, source_id): documents that exactly one source claims through any of their keys; others have null.

    docs has doc_id and keys array<string>; keys has key and source_id.
    """
    each = docs.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).where(strip(F.col("key")) != "")
    claims = each.join(keys, "key").groupBy("doc_id").agg(F.min("source_id").alias("lo"), F.max("source_id").alias("hi"))
    return docs.select("doc_id").distinct().join(claims, "doc_id", "left").select("doc_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("source_id"))


def select_records(records: DataFrame, source_doc_id: str = "", source_sha1: str = "", doc_ids: Sequence[str] = ()) -> DataFrame:
    """Records of a source, of a digest, or that generated or pushed any of the ids."""
    test = F.lit(False)
    if source_doc_id:
        test = test | (F.col("source_doc_id") == source_doc_id)
    if source_sha1:
        test = test | (F.col("source_sha1") == source_sha1)
    if doc_ids:
        test = test | F.arrays_overlap(F.concat("generated_doc_ids", "pushed_doc_ids"), F.array(*map(F.lit, doc_ids)))
    return records.where(test)


MODES = ("inspect", "delete-source", "rollback-push", "update-source")


def change_plan(mode: str, records: DataFrame, targets: DataFrame, stored: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """One row: the counts, risks and blockers of a change and whether it is safe to execute.

    records are manifest rows; targets, stored and extra have doc_id.  Only counts are gathered, never the ids.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    products = records.agg(F.countDistinct("product_id").alias("n_products"))
    wanted = targets.agg(F.countDistinct("doc_id").alias("n_targets"))
    missing = targets.select("doc_id").distinct().join(stored.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_missing")) if stored is not None else None
    unknown = extra.select("doc_id").distinct().join(targets.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n_unknown")) if extra is not None else None
    one = products.crossJoin(wanted)  # all sides are single rows
    one = one.crossJoin(missing) if missing is not None else one.withColumn("n_missing", F.lit(0).cast("long"))
    one = one.crossJoin(unknown) if unknown is not None else one.withColumn("n_unknown", F.lit(0).cast("long"))
    risks = F.array_compact(F.array(F.when(F.col("n_unknown") > 0, "the store has ids of this source that the manifest lacks"), F.when(F.col("n_missing") > 0, "target ids are not stored"),
                                    F.when(F.col("n_products") > 1, "several products are involved")))
    blockers = F.array_compact(F.array(F.when(F.col("n_unknown") > 0, "untracked ids"), F.when((F.col("n_targets") == 0) & F.lit(mode in MODES[1:3]), "no target ids")))
    safe = (F.size("blockers") == 0) & (F.col("n_targets") > 0) & F.lit(mode in MODES[1:3])
    return one.withColumns({"mode": F.lit(mode), "risks": risks, "blockers": blockers}).withColumn("safe_to_execute", safe)


def refusals(plan: DataFrame, require_mode: str = "") -> DataFrame:
    """Adds the reasons why a change plan must not be executed."""
    tests = [(~F.col("mode").isin(*MODES[1:3]), "mode must delete or roll back"), (~F.coalesce(F.col("safe_to_execute"), F.lit(False)), "plan isn't safe"),
             (F.size("blockers") > 0, "blockers must be empty"), (F.col("n_targets") == 0, "target ids must not be empty")]
    if require_mode:
        tests.append((F.col("mode") != require_mode, f"mode must be {require_mode}"))
    return plan.withColumn("refusals", F.array_compact(F.array(*(F.when(t, why) for t, why in tests))))


def outcome(requested: Column, failed: Column, ok: Column) -> Column:
    """success, partial or failed from counts of a delete or push."""
    return F.when(requested == 0, "failed").when(failed == 0, "success").when((ok == 0) & (failed == requested), "failed").otherwise("partial")


def severity(*statuses: Column) -> Column:
    """The worst of blocked, warning and pass."""
    worst = F.greatest(*(F.when(s == "blocked", 2).when(s == "warning", 1).otherwise(0) for s in statuses))
    return F.when(worst == 2, "blocked").when(worst == 1, "warning").otherwise("pass")


def delete_by_ids(rows: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The table without the given ids."""
    return rows.join(ids.select(id_col).distinct(), id_col, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The table with new rows in place of old ones of the same id."""
    return delete_by_ids(rows, new, id_col).unionByName(new, allowMissingColumns=True)
