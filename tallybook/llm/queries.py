"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import audit, bpe, bytebpe, chat, decontam, infill, language, neardup, pii, quality, substrings, suffixes, textkit, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    textkit.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.found(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_duplicates(_table(spark, sf_dir, "documents"), finish=substrings.digests, schema=substrings.DIGESTS)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), vocabulary_path(), finish=bpe.digests, schema=bpe.DIGESTS)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.training_rows(docs)))
    found = language.predict(docs, model)
    return found.select("doc_id", (textkit.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", (textkit.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.conversations_of(chat.chains(rows.unionByName(extra))))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("rejected_by")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.transform(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(audit.counters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return bytebpe.encode(docs, vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, finish=bytebpe.digests, schema=bytebpe.DIGESTS)


QUERIES = {"op1_language": op1_language, "op2_toxicity": op2_toxicity, "op3_pii": op3_pii, "op4_decontamination": op4_decontamination, "op5_suffix_array": op5_suffix_array, "op6_substrings": op6_substrings, "op7_bpe": op7_bpe, "op8_chat": op8_chat, "op9_near_duplicates": op9_near_duplicates, "op10_quality": op10_quality, "op11_infill": op11_infill, "op12_filter_audit": op12_filter_audit, "op13_byte_bpe": op13_byte_bpe}
ORACLES: dict[str, str] = {"op3_pii": pii.ORACLE, "op6_substrings": substrings.ORACLE, "op8_chat": chat.ORACLE, "op10_quality": quality.ORACLE, "op11_infill": infill.ORACLE, "op12_filter_audit": audit.ORACLE}
