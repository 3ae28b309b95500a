"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filescope.llm import density, forest, jaccard, langid, lines, media, mixing, packing, periodic, pitman_yor, simhash, suffixes, whitening
from filescope.llm.common import table


def op1_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.extract(table(spark, sf_dir, "pages"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.removed_spans(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(lines.deduplicate(table(spark, sf_dir, "documents")))


def op9_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_columns(table(spark, sf_dir, "documents"))
    return media.digests(media.thumbnail_columns(stored))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_density, op2_pitman_yor, op3_simhash, op4_suffixes, op5_mixing, op6_packing, op7_bigru, op8_lines, op9_forest, op10_jpeg, op11_periodic, op12_jaccard, op13_whitening)}
ORACLE: dict[str, str] = {"op8_lines": lines.ORACLE, "op12_jaccard": jaccard.ORACLE}
