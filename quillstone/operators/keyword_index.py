"""A stored inverted index for BM25: posting blocks with maxima, searched block by block, grown by segments.

Documents are dealt to segments of about 8,192 and within them to 64 ranges by a hash
of their id.  A row of the index is a term in a segment: its postings in order of
range, and for each range (a block) the largest term frequency and the shortest
document, which bound what the block can add to a score whatever the corpus's
statistics have become.  Rows lie in folders by a hash of the term and are sorted by
term, so a search reads the blocks of its own words and never the documents.  In a
segment a query takes the ranges of the largest summed bounds first and leaves those
that can't reach its k-th score.  The documents themselves are the postings of an empty
term, with their lengths for frequencies, so one write adds a segment whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.text import tokens

#: Documents in a segment, ranges in a segment, folders of terms, and segments whose rows of one folder are written together.
SEGMENT, RANGES, FOLDERS, LOT = 8192, 64, 64, 64
#: Query terms that are broadcast at a time, and how many are pushed down to the scan as a list.
TERMS, PUSHED = 200_000, 2000
#: The term that every document has.
EVERY = ""
#: Scores are compared after rounding to six digits, so bounds leave room for that.
SLACK = 2e-6


class KeywordIndex(NamedTuple):
    """Where the index lies and the type of its ids."""

    path: str
    id_type: str

    def postings(self, spark: SparkSession) -> DataFrame:
        schema = (f"segment long, term string, df long, total long, ranges array<int>, sizes array<int>, most array<int>, shortest array<int>, "
                  f"ids array<{self.id_type}>, tfs array<int>, lens array<int>, folder int")
        return spark.read.schema(schema).parquet(f"{self.path}/postings")

    def documents(self, spark: SparkSession) -> DataFrame:
        """segment, id, len of every document ever added."""
        rows = self.segments(spark).select("segment", F.explode(F.arrays_zip("ids", "lens")).alias("d"))
        return rows.select("segment", F.col("d.ids").alias("id"), F.col("d.lens").alias("len"))

    def segments(self, spark: SparkSession) -> DataFrame:
        """The rows of the empty term: df documents of total length in each segment."""
        return self.postings(spark).where((F.col("folder") == folder_of(F.lit(EVERY))) & (F.col("term") == EVERY))

    def gone(self, spark: SparkSession) -> DataFrame:
        """segment, id, len of the documents that were removed."""
        return spark.read.schema(f"segment long, id {self.id_type}, len int").parquet(f"{self.path}/gone")


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def term_counts(words: DataFrame) -> DataFrame:
    """words (an array column `words` beside others) with one row per distinct word and its number `tf`, and one for EVERY with all words' number.

    Words are sorted within their document and the lengths of equal stretches taken, so nothing is shuffled.
    """
    keep = [c for c in words.columns if c != "words"]
    ordered = words.select(*keep, F.array_sort("words").alias("s"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0))))
    # Every step names a column, so that no expression is worked out again for each element.
    first = ordered.select("*", F.zip_with("s", before, lambda a, b: ~a.eqNullSafe(b)).alias("new"))
    heads = first.select("*", F.filter(F.transform("new", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()).alias("heads"))
    after = F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array(F.size("s")))
    counted = heads.select(*keep, "s", F.array_distinct("s").alias("term"), F.zip_with("heads", after, lambda i, j: j - i).alias("tf"))
    every = F.array(F.struct(F.lit(EVERY).alias("term"), F.size("s").alias("tf")))
    pairs = counted.select(*keep, F.explode(F.concat(every, F.arrays_zip("term", "tf"))).alias("p"))
    return pairs.select(*keep, "p.term", "p.tf").where("term IS NOT NULL")


def build_keyword_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
    """Index all documents in `path`, a new folder that all executors share.  Rows without an id aren't indexed; ids must differ."""
    spark = docs.sparkSession
    index = KeywordIndex(path, docs.schema[id_col].dataType.simpleString())
    spark.createDataFrame([], f"segment long, id {index.id_type}, len int").write.parquet(f"{path}/gone")
    spark.createDataFrame([], "segment long").write.parquet(f"{path}/postings")
    append_documents(index, docs, id_col, text_col)
    return index


#: Postings that are put into lists at a time.
BATCH = 1 << 18


def posting_lists(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (folder, term, segment, range, id, tf, len), sorted by term and segment, as rows of the index; a term's postings in a segment may span batches."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(starts(table)[-1])
            if cut:
                yield from lists_of(table.slice(0, cut))
            held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield from lists_of(pa.Table.from_batches(held).combine_chunks())


def starts(table: pa.Table) -> np.ndarray:
    """The first row of each term in a segment."""
    term = table.column("term").combine_chunks().dictionary_encode()
    codes = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
    segment = table.column("segment").to_numpy()
    return np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (segment[1:] != segment[:-1])])


def lists_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of the index from whole groups of postings."""
    first = starts(table)
    size = np.diff(np.append(first, table.num_rows))
    group = np.repeat(np.arange(len(first)), size)
    block = group * RANGES + table.column("range").to_numpy()
    order = np.argsort(block, kind="stable")
    block = block[order]
    heads = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    tf, length = table.column("tf").to_numpy()[order], table.column("len").to_numpy()[order]
    per_post = pa.array(np.append(first, table.num_rows).astype(np.int32))
    per_block = pa.array(np.searchsorted(block[heads] // RANGES, np.arange(len(first) + 1)).astype(np.int32))
    at = pa.array(first)

    def lists(cuts: pa.Array, values: np.ndarray | pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(cuts, values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))

    ids = table.column("id").combine_chunks().take(pa.array(order))
    columns = {
        "segment": table.column("segment").combine_chunks().take(at), "term": table.column("term").combine_chunks().take(at), "df": pa.array(size.astype(np.int64)),
        "total": pa.array(np.add.reduceat(tf, first, dtype=np.int64)),
        "ranges": lists(per_block, block[heads] % RANGES), "sizes": lists(per_block, np.diff(np.append(heads, len(block)))),
        "most": lists(per_block, np.maximum.reduceat(tf, heads)), "shortest": lists(per_block, np.minimum.reduceat(length, heads)),
        "ids": lists(per_post, ids), "tfs": lists(per_post, tf), "lens": lists(per_post, length), "folder": table.column("folder").combine_chunks().take(at)}
    yield from pa.table(columns).to_batches(max_chunksize=1 << 14)


def append_documents(index: KeywordIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Add documents as segments of their own; their ids mustn't be in the index (see remove_documents)."""
    spark = docs.sparkSession
    known = docs.where(F.col(id_col).isNotNull())
    base = (index.segments(spark).agg(F.max("segment")).first()[0] or 0) + 1
    segments = max(1, -(-known.count() // SEGMENT))
    h = F.xxhash64(F.col("id"))
    rows = known.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    rows = rows.select("id", "words", F.size("words").alias("len"), (F.lit(base) + F.pmod(h, F.lit(segments))).alias("segment"),
                       F.pmod(F.shiftright(h, 40), F.lit(RANGES)).cast("int").alias("range"))
    postings = term_counts(rows).withColumns({"folder": folder_of(F.col("term")), "lot": F.floor(F.col("segment") / LOT)})
    # All postings of a term in a segment lie together, whatever task holds them.
    ordered = postings.repartition("folder", "lot").sortWithinPartitions("folder", "term", "segment").select("folder", "term", "segment", "range", "id", "tf", "len")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.postings(spark).schema.fields)
    ordered.mapInArrow(posting_lists, schema).write.mode("append").partitionBy("folder").parquet(f"{index.path}/postings")


def remove_documents(index: KeywordIndex, ids: DataFrame, id_col: str = "doc_id") -> None:
    """Take documents out of the index; their postings stay where they are and are passed over.  To replace documents, remove and append them."""
    spark = ids.sparkSession
    wanted = ids.select(F.col(id_col).alias("id")).distinct()
    now = index.documents(spark).join(index.gone(spark).select("segment", "id"), ["segment", "id"], "left_anti")
    now.join(wanted, "id", "left_semi").select("segment", "id", "len").write.mode("append").parquet(f"{index.path}/gone")


class Lists(NamedTuple):
    """A term's postings in a segment: document numbers, frequencies, lengths, and its blocks' ranges, cuts, largest frequency and shortest length."""

    docs: np.ndarray
    tf: np.ndarray
    size: np.ndarray
    ranges: np.ndarray
    cuts: np.ndarray
    most: np.ndarray
    shortest: np.ndarray


def weight(tf: np.ndarray, size: np.ndarray, average: float, k1: float, b: float) -> np.ndarray:
    """BM25's part of a score beside the term's rarity; it grows with tf and falls with size."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / average))


def numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the cuts between its rows."""
    column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def best_of_segment(lists: list[tuple[float, Lists]], n_docs: int, k: int, need: int, average: float, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings read) of all documents that may be among the k best of these terms (rarity, postings); `need` terms must occur in each."""
    bound, held = np.zeros(RANGES), np.zeros(RANGES, np.int64)
    for rarity, x in lists:
        bound[x.ranges] += rarity * weight(x.most, x.shortest, average, k1, b)
        held[x.ranges] += 1
    bound[held < need] = -np.inf
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] > -np.inf]
    score, hits, read, least = np.zeros(n_docs), np.zeros(n_docs, np.int64), 0, -np.inf
    # A few ranges first; the k-th score they give often rules out many others.
    for some in (order[:8], order[8:]):
        some = some[bound[some] >= least - SLACK]
        chosen = np.zeros(RANGES, bool)
        chosen[some] = True
        for rarity, x in lists:
            use = np.flatnonzero(chosen[x.ranges])
            at = slice(0, len(x.docs)) if len(use) == len(x.ranges) else np.concatenate([np.arange(x.cuts[i], x.cuts[i + 1]) for i in use]) if len(use) else slice(0, 0)
            docs = x.docs[at]
            score[docs] += rarity * weight(x.tf[at], x.size[at], average, k1, b)
            hits[docs] += 1
            read += len(docs)
        found = np.flatnonzero(hits >= need)
        if len(found) >= k:
            least = np.partition(score[found], len(found) - k)[len(found) - k]
    found = found[score[found] >= least - SLACK]
    return found, score[found], read


def keyword_topk(index: KeywordIndex, queries: DataFrame, k: int, all_terms: bool = False, query_id: str = "query_id", query_text: str = "query_text",
                 id_col: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query by BM25: query_id, doc_id, score (six digits), rank; ties by doc_id.

    The same rows as search.keyword_bm25 gives over the documents that the index holds.
    Queries without words find nothing.
    """
    spark = queries.sparkSession
    kind = queries.schema[query_id].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("query"), F.array_distinct(tokens(F.col(query_text))).alias("terms"))
    n_terms = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    deal = max(1, -(-n_terms * 11 // (TERMS * 10)))
    out = None
    for i in range(deal):
        part = asked if deal == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(deal)) == i)
        found = block_topk(index, part, k, all_terms, id_col, k1, b, kind).withColumnRenamed("query", query_id)
        out = found if out is None else out.union(found)
    return out


def block_topk(index: KeywordIndex, asked: DataFrame, k: int, all_terms: bool, id_col: str, k1: float, b: float, kind: str) -> DataFrame:
    """keyword_topk of a bounded block of queries (query, terms)."""
    spark = asked.sparkSession
    held = [(r["query"], r["terms"]) for r in asked.collect()]
    terms = sorted({t for _, ts in held for t in ts})
    gone = index.gone(spark)
    lost = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    stats = index.segments(spark).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    n_docs = stats["n"] - lost["n"]
    average = (stats["total"] - lost["total"]) / n_docs if n_docs else 0.0
    names = spark.createDataFrame([(t,) for t in terms], "term string")
    folders = [r[0] for r in names.select(folder_of(F.col("term"))).distinct().collect()]
    rows = index.postings(spark).where(F.col("folder").isin(folders))
    rows = rows.where(F.col("term").isin(terms)) if len(terms) <= PUSHED else rows.join(F.broadcast(names), "term", "left_semi")
    removed = lost["n"] > 0
    df = rows.groupBy("term").agg(F.sum("df").alias("df"))
    if removed:
        # Postings of removed documents don't count; only segments that have some are opened for it.
        hurt = rows.join(gone.select("segment").distinct(), "segment", "left_semi").select("segment", "term", F.explode("ids").alias("id"))
        less = hurt.join(gone.select("segment", "id"), ["segment", "id"], "left_semi").groupBy("term").agg(F.count("*").alias("less"))
        df = df.join(less, "term", "left").select("term", (F.col("df") - F.coalesce("less", F.lit(0))).alias("df"))
    rarity = {r["term"]: float(np.log(1 + (n_docs - r["df"] + 0.5) / (r["df"] + 0.5))) for r in df.collect()}
    told = spark.sparkContext.broadcast((held, rarity))

    def score(table: pa.Table) -> pa.Table:
        held, rarity = told.value
        ids, cuts = numbers(table.column("ids"))
        every, docs = np.unique(ids, return_inverse=True)
        (tf, more), (size, _) = numbers(table.column("tfs")), numbers(table.column("lens"))
        (ranges, at), (sizes, _), (most, _), (shortest, _) = (numbers(table.column(c)) for c in ("ranges", "sizes", "most", "shortest"))
        dead = np.zeros(len(every), bool)
        found: dict[str | None, Lists] = {}
        for r, term in enumerate(table.column("term").to_pylist()):
            lo, hi, x, y = cuts[r], cuts[r + 1], at[r], at[r + 1]
            if term is None:
                dead[docs[lo:hi]] = True
                continue
            i, j = more[r], more[r + 1]
            found[term] = Lists(docs[lo:hi], tf[i:j], size[i:j], ranges[x:y], np.concatenate([[0], np.cumsum(sizes[x:y])]), most[x:y], shortest[x:y])
        out = []
        for n, (_, terms) in enumerate(held):
            mine = [(rarity[t], found[t]) for t in terms if t in found]
            need = len(terms) if all_terms else 1
            if mine and len(mine) >= need:
                # Removed documents may be among the best, so as many more are asked for.
                which, scores, _ = best_of_segment(mine, len(every), k + int(dead.sum()), need, average, k1, b)
                which, scores = which[~dead[which]], scores[~dead[which]]
                out.append((np.full(len(which), n), which, scores))
        n, which, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"n": pa.array(n, pa.int64()), "id": pa.array(every[which], table.schema.field("ids").type.value_type), "score": pa.array(scores, pa.float64())})

    columns = ["segment", "term", "ranges", "sizes", "most", "shortest", "ids", "tfs", "lens"]
    rows = rows.select(*columns)
    if removed:
        # A row without a term tells a segment which of its documents are gone.
        none = {c: F.array().cast("array<int>") for c in ("ranges", "sizes", "most", "shortest", "tfs", "lens")}
        rows = rows.unionByName(gone.groupBy("segment").agg(F.collect_list("id").alias("ids")).withColumns({"term": F.lit(None).cast("string"), **none}))
    found = rows.groupBy("segment").applyInArrow(score, f"n long, id {index.id_type}, score double")
    order = Window.partitionBy("n").orderBy(F.desc("score"), "id")
    top = found.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    who = spark.createDataFrame([(n, q) for n, (q, _) in enumerate(held)], f"n long, query {kind}")
    return top.join(F.broadcast(who), "n").select("query", F.col("id").alias(id_col), "score", "rank")
