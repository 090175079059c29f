"""One registered query per operator, over its whole table and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import extract, jaccard, language, leaks, mixing, ngrams, periodic, quotes, secrets, substrings, surrogates, tokens, variants


#: The key of a real run comes from the caller's secret store.
SURROGATE_KEY = b"a key for the test tables"


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.quality(_read(spark, folder, "documents"), "doc_id")


def op2_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.surrogates(_read(spark, folder, "documents"), "doc_id", key=SURROGATE_KEY)


def op3_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.conversations(_read(spark, folder, "conversations"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with their markup's language, and documents with the declared one and their source as host."""
    docs, pages = _read(spark, folder, "documents"), _read(spark, folder, "pages")
    model = language.train(docs)
    no_id = F.lit(None).cast("long")
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&#?\w+;", " ")
    markup = F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    rows = pages.select(no_id.alias("doc_id"), "page_id", F.col("url").alias("address"), markup.alias("declared"), plain.alias("text")).unionByName(
        docs.select("doc_id", no_id.alias("page_id"), F.col("source").alias("address"), F.col("lang").alias("declared"), "text")
    )
    return language.identify(rows, model, "doc_id", "page_id")


def op5_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join(_read(spark, folder, "documents"), "doc_id", shingle=4, percent=85)


def op6_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup(_read(spark, folder, "documents"), "doc_id", window=35)


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, folder, "documents"), "doc_id")


def op8_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(_read(spark, folder, "pages"), "page_id", "url")


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(_read(spark, folder, "documents"), "doc_id")


def op10_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"), "doc_id")


def op11_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from the documents whose crc32 leaves no remainder of 2 by 7; null ids are held out."""
    train = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    return ngrams.score(_read(spark, folder, "documents"), "doc_id", train=train)


def op12_periodic(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", periodic.planted("text", "doc_id").alias("text"))
    return periodic.digest(periodic.collapse(docs, "doc_id"), "doc_id")


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = variants.count_words(_read(spark, folder, "documents"), least_letters=7, slips="doc_id")
    return variants.group_variants(words.where("n >= 2"), least_letters=7, ratio=10)


QUERIES = {
    "op1_fertility": op1_fertility,
    "op2_surrogates": op2_surrogates,
    "op3_quotes": op3_quotes,
    "op4_language": op4_language,
    "op5_jaccard": op5_jaccard,
    "op6_substrings": op6_substrings,
    "op7_mixing": op7_mixing,
    "op8_extract": op8_extract,
    "op9_secrets": op9_secrets,
    "op10_leaks": op10_leaks,
    "op11_ngrams": op11_ngrams,
    "op12_periodic": op12_periodic,
    "op13_variants": op13_variants,
}
ORACLES: dict[str, str] = {}
