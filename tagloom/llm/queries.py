"""The operators of this package as queries over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import (
    balancing,
    bilinear,
    bytewindows,
    decontamination,
    hostfilter,
    lattice,
    mainhtml,
    minhash,
    pii,
    sourceaudit,
    toxicity,
    vectorcodes,
    wordwindows,
)
from tagloom.llm.oracle import ORACLE_SQL  # noqa: F401  (read by the entry)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(_table(spark, sf_dir, "documents"))


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all vectors of equal label."""
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document leaks."""
    return decontamination.leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_superkmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in no repeated window."""
    return wordwindows.without_repeats(_table(spark, sf_dir, "documents"))


def op6_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents."""
    return bilinear.scores(_table(spark, sf_dir, "documents"))


def op7_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return balancing.mixed(_table(spark, sf_dir, "documents"))


def op8_mainhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return mainhtml.extract(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op10_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that lie in no string seen earlier."""
    return bytewindows.without_repeats(_table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors."""
    return vectorcodes.encode(_table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between the sources of every language, over all documents."""
    return sourceaudit.audit(_table(spark, sf_dir, "documents"))


def op13_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages; rows of ``labels`` are outcomes of the pages of their id."""
    outcomes = hostfilter.bad_labels(_table(spark, sf_dir, "labels"))
    return hostfilter.filtered(_table(spark, sf_dir, "pages"), outcomes).drop("bad_bound")


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_pii,
        op2_lattice,
        op3_decontamination,
        op4_minhash,
        op5_superkmers,
        op6_bilinear,
        op7_balancing,
        op8_mainhtml,
        op9_toxicity,
        op10_bwt,
        op11_codes,
        op12_divergence,
        op13_hosts,
    )
}
