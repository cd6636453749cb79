"""The registered queries of this package: each reads its whole table and applies one operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import alignment, chat, decontamination, jaccard, licenses, lines, lm, oracles, packing, prefixes, quality, token_counts, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(_table(spark, sf_dir, "documents"), k=4, percent=85).drop("node")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.resolve_revisits(warc.captures(_table(spark, sf_dir, "pages"))))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.find_licenses(_table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionAll(spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_chats(rows))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(_table(spark, sf_dir, "embeddings"))


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(lines.dedup_lines(_table(spark, sf_dir, "documents")))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(alignment.align(_table(spark, sf_dir, "documents"), digest=True))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(*prefixes.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_ngram_jaccard_join,
    op2_warc_revisits,
    op3_license_scan,
    op4_quality_classifier,
    op5_chat_format,
    op6_exact_topk,
    op7_ppm_scores,
    op8_benchmark_decontamination,
    op9_packing,
    op10_fuzzy_line_dedup,
    op11_tokenizer_alignment,
    op12_prefix_trie,
    op13_token_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; the others are tested against brute force."""
    return {
        "op1_ngram_jaccard_join": oracles.JACCARD,
        "op2_warc_revisits": warc.ORACLE_SQL,
        "op3_license_scan": oracles.licenses(licenses.TEMPLATES, licenses.PHRASES, licenses.THRESHOLD),
        "op5_chat_format": oracles.CHAT,
        "op6_exact_topk": oracles.TOPK,
        "op8_benchmark_decontamination": oracles.DECONTAMINATION,
        "op12_prefix_trie": prefixes.ORACLE_SQL,
    }
