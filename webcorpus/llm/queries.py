"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.llm.conversation_trie import conversation_trie
from webcorpus.llm.decontaminate import leaks
from webcorpus.llm.html_extract import extract
from webcorpus.llm.ngram_join import ngram_join
from webcorpus.llm.oracles import ORACLES  # noqa: F401  registered beside the queries
from webcorpus.llm.packing import pack
from webcorpus.llm.quality import fit, scored
from webcorpus.llm.quality_rules import quality_rules
from webcorpus.llm.repeated_windows import repeated_windows
from webcorpus.llm.secret_scan import BASE_KINDS, secret_scan
from webcorpus.llm.spelling import spelling_variants
from webcorpus.llm.token_files import token_counts
from webcorpus.llm.url_templates import url_filter
from webcorpus.llm.warc import archive_round_trip
from webcorpus.session import new_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_OF_TEXT = 49407  # of that vocabulary


BATCH_ROWS = "1000"  # texts handed to Python at once: a few MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan(docs, docs["source"], F.concat_ws("/", docs["source"], docs["lang"]))
    base = F.filter("spans", lambda s: s["kind_no"] < BASE_KINDS)
    count = lambda name, value: F.size(F.filter("spans", lambda s: s[name] == value)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[count("kind", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "copied").alias("n_copied"),
    )


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a page's path is the document it shows; that document's label is the page's."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    shown = F.regexp_extract(F.regexp_replace("url", "[?#].*", ""), "/([0-9]{1,18})(?:[.]html|/)?$", 1)
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("label"))
    urls = pages.select("url", shown.alias("shown")).where("shown <> ''").select("url", F.col("shown").cast("bigint").alias("doc_id"))
    return url_filter(pages, urls.join(known, "doc_id").select("url", "label"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), TOKENIZER, END_OF_TEXT)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    weights = fit(docs, labels.where(~held_out))
    return scored(docs, weights).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_secret_scan": op2_secret_scan,
    "op3_url_templates": op3_url_templates,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_repeated_windows": op12_repeated_windows,
    "op13_conversation_trie": op13_conversation_trie,
}
