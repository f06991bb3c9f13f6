"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, dedup, language, lm, merkle, mil, mixing, packing, quality, search, toxicity, urls
from .common import read
from .oracles import ORACLE_SQL  # noqa: F401

#: Rules of the URL filter (fixed values): verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: A further conversation whose texts hold the template's control strings.
TRICKY = "\\### Assistant: </turn> ok"
#: Labels up to this number are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_LABELS = 1_000_000


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is what is labelled as good and not toxic."""
    good = read(spark, sf_dir, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0))
    return lm.score_documents(read(spark, sf_dir, "documents"), good)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, formatted and read back, and of conversation -7."""
    shape = "conv_id long, turn long, role string, text string"
    further = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], shape)
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(further)
    return chat.digest(chat.format_conversations(chat.events_of_turns(turns)))


def op3_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every vector whose id is divisible by 50."""
    vectors = read(spark, sf_dir, "embeddings").filter(search.usable(F.col("embedding"))).select("vec_id", search.scaled(F.col("embedding")).alias("v"))
    return search.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    found = language.identify_languages(docs, F.col("doc_id").isNotNull() & ~F.col("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rules and model."""
    return urls.judge_urls(read(spark, sf_dir, "pages"), RULES)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 4-word shingles."""
    found = dedup.near_duplicates(read(spark, sf_dir, "documents"), shingle_words=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the divergence verdict of every document."""
    found = quality.judge_quality(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), capacity=2048)


def with_poor(labels: DataFrame) -> DataFrame:
    """Labels with the category ``poor``, of which good quality is the contrary."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("poor"), "toxic")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the chain of classifiers: poor first, then toxic."""
    found = toxicity.classify_toxicity(read(spark, sf_dir, "documents"), with_poor(read(spark, sf_dir, "labels")), ("poor", "toxic"))
    return found.select("doc_id", "p_poor", "p_toxic", "toxic")


def with_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add quality_weight as the last column: 2 for good labels, 0.5 for bad ones, 1 where there is none."""
    votes = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    small = votes.count() <= BROADCAST_LABELS
    docs = docs.drop("quality_weight")
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(F.broadcast(votes) if small else votes, F.col("row.doc_id") == F.col("id"), "left")
    weight = F.when(F.col("quality") >= 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return joined.select("row.*", weight.alias("weight")).toDF(*docs.columns, "quality_weight")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources takes."""
    docs = with_weights(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    found = mixing.mix_sources(docs, F.col("quality_weight"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two public vocabularies, aligned, with the counts of linked ids over the corpus."""
    return align.align_tokenizers(read(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over passages, learned where crc32 of the id modulo 5 is not 0."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(part == 0, F.lit(False)).alias("held_out"))
    found = mil.score_quality(docs, read(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~F.col("held_out"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, with proofs; where 3 divides crc32 of the id, the text is tampered with."""
    return merkle.manifest(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_chat_formatting, op3_top_k_search, op4_language_id, op5_url_filter,
        op6_minhash_dedup, op7_quality_rules, op8_packing, op9_toxicity, op10_mixing, op11_tokenizer_alignment, op12_quality_classifier, op13_merkle_manifest)
}
