"""Registered queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctra.llm import bit_sliced, grouping_genetic, language_crf, license_digest, line_windows, ngram_rtree, nnls_pack, poisson_mix, quality, spelling_fm, token_pairs, url_rules, warc_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.quality_verdicts(_table(spark, sf_dir, "documents"))
    return v.select("doc_id", *[F.col("counts")[c].alias(c) for c in quality.COUNTS], "base_failed", "kept", "distance2")


#: Listed URL rules of the query.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("row.page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.tokens")


def op2_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_crf.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc.doc_id", "held_out", "lang_pred", "score")


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_digest.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc.doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(_table(spark, sf_dir, "embeddings"))


#: Target weights of the mixture; every other source has weight 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc.doc_id", "doc.source", "doc.text", "copy_no", "shuffle_key")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_windows.dedup_lines(_table(spark, sf_dir, "documents"))
    return clean.select("doc.doc_id", "line_dedup.*", F.md5("text").alias("text_md5"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rtree.near_components(_table(spark, sf_dir, "documents"), n=4, pct=85).select("doc_id", "n_shingles", "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = nnls_pack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")



def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc_index.new_folder(spark)
    index = warc_index.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc_index.read_records(index, folder, payload=False).drop("url")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_pairs.align_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = grouping_genetic.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_fm.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_rules": op1_url_rules,
        "op2_language_crf": op2_language_crf,
        "op3_license_digests": op3_license_digests,
        "op4_bit_sliced_topk": op4_bit_sliced_topk,
        "op5_mixing": op5_mixing,
        "op6_quality_rules": op6_quality_rules,
        "op7_line_dedup": op7_line_dedup,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_packing": op9_packing,
        "op10_warc_index": op10_warc_index,
        "op11_token_alignment": op11_token_alignment,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_rules": url_rules.sql(URL_RULES),
        "op3_license_digests": license_digest.sql(),
        "op4_bit_sliced_topk": bit_sliced.SQL,
        "op5_mixing": poisson_mix.sql(MIX_WEIGHTS),
        "op7_line_dedup": line_windows.SQL,
        "op8_ngram_jaccard": ngram_rtree.SQL,
        "op10_warc_index": warc_index.SQL,
    }
