"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.llm import (
    conversations,
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    phrases,
    quality,
    repeated_bytes,
    repeated_words,
    sharding,
    token_counts,
    url_rules,
)

#: host, path, verdict
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.learn(docs.filter(~F.col("held_out")))
    predicted = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_rules.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *(F.col(f"_q_{c}").alias(c) for c in names))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return left.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mix_rates(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rated.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decontaminate.split_items(read(spark, sf_dir, "benchmark"))
    return decontaminate.leaks(read(spark, sf_dir, "documents"), items)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.read_vocabulary()).drop("text")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def damaged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` with the damage that the query asks for, by a checksum of each row's id and turn."""
    space = F.lit(" ")
    rows = read(spark, sf_dir, "conversations")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(named) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.filter("d != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repaired = conversations.repair(damaged_conversations(spark, sf_dir))
    every = read(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("key", conversations.key_of(F.col("conv_id")))
    report = repaired.report.withColumn("key", conversations.key_of(F.col("conv_id"))).drop("conv_id")
    joined = every.join(report, "key", "left").join(conversations.digests(repaired.rows), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), digest)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = sharding.slim_table(read(spark, sf_dir, "documents"))
    dealt = sharding.assign(slim, 8, digest="digest", size="n_bytes")
    fixed = [F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")]
    return dealt.select("doc_id", "size", "text_crc32", fixed[0], "shard", "slot", fixed[1])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_substring_dedup,
        op3_suffix_dedup,
        op4_url_filters,
        op5_quality_rules,
        op6_ngram_join,
        op7_line_dedup,
        op8_mixing,
        op9_decontamination,
        op10_token_counts,
        op11_phrase_mining,
        op12_conversation_repair,
        op13_sharding,
        pipeline,
    )
}
