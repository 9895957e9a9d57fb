"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    chat_format,
    decontamination,
    hard_negatives,
    html_extract,
    merkle_manifest,
    minhash_dedup,
    oracles,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    simhash_dedup,
    token_files,
    tokenizer_files,
    url_filters,
)
from tessera.llm.common import bound_batches, read_table

Query = Callable[[SparkSession, str], DataFrame]


#: Rules of the url query, and the words in a domain's first label that put it on its list.
URL_RULES = [
    url_filters.Rule("allow", "org", "/"),
    url_filters.Rule("block", "example.org", "/es/"),
    url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"),
    url_filters.Rule("block", "com", "/de/"),
]
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is made of the corpus's own domains whose first label holds a listed word."""
    pages = read_table(spark, sf_dir, "pages")
    host = url_filters.host_of(F.col("url"))
    domains = pages.select(F.explode(url_filters.keys_of(host, F.lit(""))).alias("key")).distinct()
    listed = domains.where(F.col("key").rlike(rf"^([^.]*-)?({'|'.join(LISTED_WORDS)})(-[^.]*)?(\.|$)"))
    return url_filters.judge(pages, URL_RULES, listed)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trips(read_table(spark, sf_dir, "documents"), tokenizer_files.PIECES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_counts(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site is a source, a path its language and the binary order of the text's length: many are sparse."""
    path = F.concat_ws("/", "lang", F.floor(F.log2(F.char_length("text") + 1)).cast("string"))
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), path=path)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read_table(spark, sf_dir, "documents")))


#: A conversation whose texts look like the template's marks.
LOOKALIKE = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", LOOKALIKE), (-7, 1, "assistant", LOOKALIKE)], turns.schema)
    count = lambda text: F.size(sentencepiece_codec.encode(text, tokenizer_files.PIECES))
    return chat_format.read_back(chat_format.windows(turns.union(added), count_tokens=count))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_folder(spark, "token-files")
    kind = token_files.id_kind(tokenizer_files.WORDS)
    tokens = token_files.token_ids(read_table(spark, sf_dir, "documents"), tokenizer_files.WORDS, id_type=kind)
    token_files.write_tokens(tokens, path, kind)
    return token_files.digest(token_files.read_tokens(spark, path))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_copies(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select(
        F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")
    )
    return hard_negatives.mine(rows)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_copies(read_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document, by the checksum of its id, is claimed with a text in lower case."""
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("group"),
        merkle_manifest.leaf_digest(*fields).alias("leaf"),
        F.when(tampered, merkle_manifest.leaf_digest(*fields[:-1], lowered)).alias("claimed"),
    )
    found = merkle_manifest.proofs(merkle_manifest.build(leaves), siblings=False)
    return found.withColumnRenamed("id", "doc_id")


def _bounded(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    name: _bounded(query)
    for name, query in {
        "op1_url_filters": op1_url_filters,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_quality_rules": op3_quality_rules,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_decontamination": op5_decontamination,
        "op6_secret_scan": op6_secret_scan,
        "op7_chat_format": op7_chat_format,
        "op8_html_extract": op8_html_extract,
        "op9_token_files": op9_token_files,
        "op10_simhash": op10_simhash,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_minhash": op12_minhash,
        "op13_merkle_manifest": op13_merkle_manifest,
    }.items()
}

ORACLES: dict[str, str] = {
    "op1_url_filters": oracles.url_filters(URL_RULES, LISTED_WORDS),
    "op3_quality_rules": oracles.quality_rules(),
    "op11_hard_negatives": oracles.hard_negatives(),
    "op12_minhash": oracles.minhash(),
    "op13_merkle_manifest": oracles.merkle_manifest(),
}
