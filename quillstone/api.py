"""The engine's front: health, search, answer, preview and staged ingest over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import answer as answers
from quillstone.operators import bundle, chunking, fusion, keyword_index, manifest, search, vector_index
from quillstone.operators.providers import HashProvider, Provider, with_retry
from quillstone.sources import readers, sinks

#: Retrieval depths: dense, keyword and image-text hits, fused, reranked, answered.
DEPTHS = {"dense": 50, "keyword": 50, "image_text": 30, "fused": 30, "reranked": 10, "answered": 5}
#: Words that actions which write or call models must be given.
TOKENS = {"embed": "YES_EMBED", "push": "YES_PUSH", "answer": "YES_ANSWER"}

#: What a run's report says.
RUN_MESSAGES = {"mode": "v1 页面暂不开放真实入库，请走后续确认版本", "preflight": "preflight blocked，禁止执行入库", "done": "dry-run 完成，未写入向量库"}


def confirm(action: str, token: str) -> None:
    if token != TOKENS[action]:
        raise PermissionError(f"{action} needs the confirmation {TOKENS[action]}")


@dataclass
class Engine:
    """Tables and a model provider.

    text_docs: doc_id, product_id, doc_type, field_name, status, source_text, embedding.
    image_text_docs (optional): image_id, product_id, image_path, image_url, source_text, embedding.
    text_vectors and text_words (optional): indexes of text_docs by doc_id, which the dense
    and the keyword route then search instead of scanning the table; the hits are the same.
    answer_model (optional): who writes the answer where the caller confirms it.
    """

    spark: SparkSession
    text_docs: DataFrame
    image_text_docs: DataFrame | None = None
    text_model: Provider | None = None
    image_model: Provider | None = None
    image_index: DataFrame | None = None
    image_urls: DataFrame | None = None
    text_vectors: vector_index.VectorIndex | None = None
    text_words: keyword_index.KeywordIndex | None = None
    answer_model: Provider | None = None

    def __post_init__(self) -> None:
        self.text_model = self.text_model or HashProvider()
        self.image_model = self.image_model or HashProvider(space="image")

    def health(self) -> dict[str, Any]:
        return {"ok": True, "spark": self.spark.version, "text_model": self.text_model.name, "has_images": self.image_text_docs is not None}

    def text_hits(self, route: str, top: DataFrame) -> DataFrame:
        """Ranked doc_ids as hits of a route, with their product and text; rows without a product go."""
        found = top.join(self.text_docs.select("doc_id", "product_id", "source_text"), "doc_id").where("product_id <> ''")
        return found.select(F.lit(route).alias("route"), "rank", "product_id", F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("image_id"), F.lit("").alias("image_path"),
                            F.lit("").alias("image_url"), "source_text")

    def dense_route(self, query: str, k: int) -> DataFrame:
        vector = self.text_model.embed([query])[0]
        if self.text_vectors is not None:
            asked = self.spark.createDataFrame([(1, vector)], "query_id int, query_vector array<double>")
            return self.text_hits("dense", vector_index.index_topk(self.text_vectors, asked, k, exact=True, id_col="doc_id").select("doc_id", "rank"))
        return self.text_hits("dense", search.vector_topk(self.text_docs, vector, k, "doc_id").select("doc_id", "rank"))

    def keyword_route(self, query: str, k: int) -> DataFrame:
        asked = self.spark.createDataFrame([(1, query)], "query_id int, query_text string")
        if self.text_words is not None:
            return self.text_hits("keyword", keyword_index.keyword_topk(self.text_words, asked, k).select("doc_id", "rank"))
        return self.text_hits("keyword", search.keyword_bm25(self.text_docs, asked, k, "doc_id", "source_text").select("doc_id", "rank"))

    def image_route(self, query: str, k: int) -> DataFrame:
        return self.image_route_by_vector(self.image_model.embed([query])[0], k)

    def image_route_by_vector(self, vector: list[float], k: int) -> DataFrame:
        top = search.vector_topk(self.image_text_docs, vector, k, "image_id")
        return top.where("product_id <> ''").select(F.lit("image_text").alias("route"), "rank", "product_id", F.lit("").alias("doc_id"), F.col("image_id").cast("string").alias("image_id"),
                                                    "image_path", "image_url", "source_text")

    def hits(self, query: str) -> DataFrame:
        """All routes' hits; routes never mix vector spaces."""
        out = self.dense_route(query, DEPTHS["dense"]).unionByName(self.keyword_route(query, DEPTHS["keyword"]))
        return out.unionByName(self.image_route(query, DEPTHS["image_text"])) if self.image_text_docs is not None else out

    def retrieve(self, query: str, top_k: int = DEPTHS["fused"]) -> DataFrame:
        """The fused products with their nested hits: product_rank, product_id, score, routes, doc_hits, best_text, image columns."""
        found = self.hits(query)
        fused = fusion.fuse(found)
        top = fused.orderBy(*fusion.fused_order(fused)).limit(top_k)
        top = top.withColumn("product_rank", F.row_number().over(Window.orderBy(*fusion.fused_order(top)))).drop("first_seen")
        out = top.join(fusion.nested_hits(found), "product_id", "left")
        return bundle.image_enrichment(out, self.image_index, self.image_urls) if self.image_index is not None and self.image_urls is not None else out

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        """Ranked products with previews; top_k is 1 to 30."""
        if not 1 <= top_k <= 30:
            raise ValueError("top_k must be 1 to 30")
        rows = self.retrieve(query, top_k)
        return rows.select("product_rank", "product_id", F.round("score", 6).alias("score"), "routes", F.substring("best_text", 1, 300).alias("preview"), F.slice("doc_hits", 1, 3).alias("doc_hits"))

    def rerank(self, query: str, top_n: int = DEPTHS["reranked"], fallback: bool = False) -> DataFrame:
        """Products in final order by the offline lexical score, or in fusion order."""
        rows = answers.rerank_text(self.retrieve(query)).withColumns({"input_rank": F.col("product_rank") - 1, "rrf_score": F.col("score")})
        if fallback:
            return fusion.fallback_order(rows, top_n)
        return fusion.rerank_order(rows.withColumn("rerank_score", answers.lexical_score(query, F.col("rerank_text"))), top_n)

    def bundles(self, products: DataFrame) -> DataFrame:
        """Sections of the given products' documents."""
        wanted = search.small(products.select("product_id").distinct())
        return bundle.bundles(self.text_docs.join(wanted, "product_id", "left_semi"))

    def answer(self, query: str, top_k: int = DEPTHS["answered"], token: str = "") -> DataFrame:
        """One row with the answer: the model's where there is one and the caller confirms it, else, or if the model fails or says nothing, the extractive one.

        The model gets the contexts of at most five products, 1,200 characters each.
        """
        if not 1 <= top_k <= 10:
            raise ValueError("top_k must be 1 to 10")
        best = self.rerank(query).where(F.col("final_rank") <= min(top_k, DEPTHS["answered"])).drop("product_rank").withColumnRenamed("final_rank", "product_rank")
        if self.answer_model is None or not token:
            return answers.extractive_answer(best)
        confirm("answer", token)
        told = answers.context(best).select("product_rank", "context_text").orderBy("product_rank").collect()
        try:
            said = with_retry(lambda: self.answer_model.answer(query, "\n\n".join(r["context_text"] for r in told)), sleep=0.1) if told else ""
        except Exception:  # whatever the service raises, the offline answer stands in for it
            said = ""
        return self.spark.createDataFrame([(said.strip(),)], "answer string") if said and said.strip() else answers.extractive_answer(best)

    def search_by_image(self) -> dict[str, Any]:
        """Not offered: like the interface it follows, this only says so."""
        return {"ok": False, "message": "search by image is not available"}


@dataclass
class StagedIngest:
    """Upload, parse, chunk, check and report; writing anywhere is blocked, every run is a dry run."""

    spark: SparkSession
    size: int = chunking.DEFAULT_SIZE
    overlap: int = 120

    def parse(self, sources: DataFrame) -> DataFrame:
        """Documents of pasted sources (kind: text, json or csv; raw, title, source_id): document_id, title, source_id, text, text_length."""
        made = readers.preview(F.col("kind"), F.col("raw"), F.col("title"), F.col("source_id"))
        sound = F.col("kind").isin("text", "csv") | ((F.col("kind") == "json") & F.try_parse_json("raw").isNotNull())
        return sources.where(sound).select(F.explode(made).alias("d")).select("d.*")

    def problems(self, sources: DataFrame) -> DataFrame:
        """(source_id, problem) of the sources that give no documents: empty, malformed or unsupported."""
        raw, kind = F.coalesce("raw", F.lit("")), F.coalesce("kind", F.lit(""))
        valid = F.try_parse_json(raw).isNotNull()
        problem = (F.when(~kind.isin("text", "json", "csv"), "unsupported").when(F.trim(raw) == "", "empty").when((kind == "json") & ~valid, "malformed")
                   .when(F.size(readers.preview(kind, raw, F.lit(""), F.lit(""))) == 0, "empty"))
        return sources.select("source_id", problem.alias("problem")).where("problem IS NOT NULL")

    def chunks(self, documents: DataFrame) -> DataFrame:
        """documents: document_id, source_id, text."""
        cut = chunking.chunks(documents, "document_id", "text", self.size, self.overlap).join(documents.select("document_id", "source_id"), "document_id")
        return cut.withColumn("chunk_id", F.format_string("%s__chunk_%04d", "document_id", F.col("chunk_index") + 1))

    def preflight(self, documents: DataFrame, target: str, run_mode: str = "dry_run", overwrite: bool = False) -> DataFrame:
        """One row: nine counts and checks and the worst of them."""
        made = self.chunks(documents)
        stats = chunking.chunk_stats(made)
        lacking = made.agg(F.count_if(F.coalesce(F.col("source_id"), F.lit("")) == "").alias("missing_source"))
        docs = documents.agg(F.count("*").alias("documents"))
        one = stats.crossJoin(lacking).crossJoin(docs)  # single rows
        def blocked(test):
            return F.when(test, "blocked").otherwise("pass")
        checks = {"target_check": blocked(F.lit(not target)), "run_mode_check": blocked(F.lit(run_mode != "dry_run")), "overwrite_check": F.lit("warning" if overwrite else "pass"),
                  "documents_check": blocked(F.col("documents") == 0), "chunks_check": blocked(F.coalesce("chunk_count", F.lit(0)) == 0), "source_check": blocked(F.col("missing_source") > 0),
                  "empty_check": blocked(F.coalesce("empty_text", F.lit(0)) > 0), "duplicate_check": F.when(F.col("duplicate_hashes") > 0, "warning").otherwise("pass")}
        return one.withColumns(checks).withColumn("status", manifest.severity(*(F.col(c) for c in checks)))

    def report(self, batch_id: str, sources: DataFrame, target: str, started_at: str, run_mode: str = "dry_run") -> DataFrame:
        """One row about a run of all stages: its status and message, documents, problems, chunks and the checks' status; nothing is embedded, pushed or deleted."""
        documents = self.parse(sources)
        checked = self.preflight(documents, target, run_mode).select("documents", F.coalesce("chunk_count", F.lit(0)).alias("chunks"), F.col("status").alias("preflight_status"))
        one = checked.crossJoin(self.problems(sources).agg(F.count("*").alias("problems")))  # single rows
        blocked = F.when(F.lit(run_mode != "dry_run"), RUN_MESSAGES["mode"]).when(F.col("preflight_status") == "blocked", RUN_MESSAGES["preflight"])
        return one.select(F.lit(batch_id).alias("batch_id"), F.lit(started_at).alias("started_at"), F.lit(run_mode).alias("run_mode"), F.lit(target).alias("target"),
                          F.when(blocked.isNull(), "success").otherwise("blocked").alias("status"), F.coalesce(blocked, F.lit(RUN_MESSAGES["done"])).alias("message"),
                          "documents", "problems", "chunks", "preflight_status", *(F.lit(False).alias(c) for c in ("embedding_called", "push_executed", "delete_executed")))

    def run(self, root: str, batch_id: str, sources: DataFrame, target: str, started_at: str, run_mode: str = "dry_run") -> DataFrame:
        """Write a batch's documents, chunks and report below root, stage by stage, and return the report."""
        documents = self.parse(sources)
        sinks.artifact(documents, root, batch_id, "documents")
        sinks.artifact(self.chunks(documents), root, batch_id, "chunks")
        return self.spark.read.json(sinks.artifact(self.report(batch_id, sources, target, started_at, run_mode), root, batch_id, "run"))

    def runs(self, root: str, n: int = 20) -> DataFrame:
        """The n latest runs' reports."""
        return sinks.last_runs(self.spark.read.json(f"{root.rstrip('/')}/*/run"), n)
