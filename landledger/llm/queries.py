"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.llm import copies, decontaminate, html, language, licenses, manifest, near, ngrams, packing, pii, quality, repair, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), capacity=2048)


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents", "doc_id", "text")).drop("rejected_by")


def fold(n: int, held: int):
    """Whether a document is held out, by its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n == held, F.lit(False))


@query
def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return language.predict(docs, language.learn(docs.where(~fold(4, 2))), also={"held_out": fold(4, 2)})


@query
def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(table(spark, sf_dir, "documents", "doc_id", "text"), fold(5, 1))


@query
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    store = token_store.write_store(docs, tokenizer_path())
    return token_store.read_store(store, docs.select("doc_id"))


@query
def op8_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return report.drop("items")


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.mark(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *manifest.FIELDS)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest.prove(docs, claims={"text": tampered}).drop("proof")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair.report(repair.damage(convs), everyone=convs)
