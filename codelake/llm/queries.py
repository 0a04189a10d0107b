"""Queries of the language-model data operators and the SQL they must equal, where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import handwritten, mixing, pagespam, sourcefiles, splitting, tokens
from codelake.session import cut, table


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_limits"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_ids(p2_pieces(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcefiles.invalid_files(table(spark, sf_dir, "files")).select("repo_name", "file_path")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files")
    return sourcefiles.failure_rates(files, sourcefiles.invalid_files(files), table(spark, sf_dir, "jobs"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_reasons(spark, sf_dir).select("repo_name", "file_path")


def p5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.unwritten_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "dependencies"), table(spark, sf_dir, "chunks"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens per source."""
    counted = tokens.count_tokens(table(spark, sf_dir, "documents").withColumn("n", F.length("text")), ["source", "n"])
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


def _counted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    return cut(tokens.count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"])), targets


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, targets = _counted(spark, sf_dir)
    return mixing.realise(counted, mixing.plan(counted, targets))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, targets = _counted(spark, sf_dir)
    planned = mixing.plan(counted, targets)
    return mixing.report(mixing.realise(counted, planned), planned)


def p7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the largest mix that meets every target share."""
    counted, targets = _counted(spark, sf_dir)
    planned = mixing.plan(counted, targets, exact=True)
    return mixing.report(mixing.realise(counted, planned), planned)


def p7_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the mix by own shares tempered to the targets' entropy."""
    counted, targets = _counted(spark, sf_dir)
    planned = mixing.tempered_to_targets(counted, targets)
    return mixing.report(mixing.realise(counted, planned), planned)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagespam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_reasons": p5_reasons, "p6_ids": p6_ids, "p6_sizes": p6_sizes, "p7_mix": p7_mix, "p7_report": p7_report, "p7_exact": p7_exact, "p7_tempered": p7_tempered, "p8_found": p8_found}
ORACLE = {
    "p2_found": """select distinct repo_name, id from chunks c left join split_limits l on l.chunk_type = c.chunk_type
      left join split_limits o on o.chunk_type = '*' where length(content) > coalesce(l.max_chars, o.max_chars)""",
}
