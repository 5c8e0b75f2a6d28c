"""Registered queries of the operators, one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewarden.llm import (
    chosenpath, collocations, curriculum, decontaminate, hyperminhash, licenses, linededup, linkgraph, metrictree, quality,
    runindex, toxicity, warc,
)
from pagewarden.llm.common import table
from pagewarden.llm.sql import SQL  # noqa: F401


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source, then two digits of the id as directories.

    Each hundredth document of a source's tree is the licence file of its directory.
    """
    i = F.col("doc_id")
    name = F.when(i % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    sub = F.when(i % 1000 == 0, F.lit(None)).otherwise((F.floor(i / 100) % 10).cast("string"))
    path = F.concat_ws("/", "source", F.floor(i / 1000).cast("string"), sub, name)
    files = table(spark, sf_dir, "documents").select(i.alias("id"), path.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("id", "doc_id")


def op2_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runindex.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.fit_from(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, trees).select("doc_id", "_quality.*")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op5_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judged(table(spark, sf_dir, "pages"))


def op6_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "_lines.n_lines", "_lines.n_removed", F.length("_lines.text").alias("kept_chars"),
        F.sha2("_lines.text", 256).alias("kept_sha256"),
    )


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curriculum.ordered(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "first_position", "positions")


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chosenpath.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "class_id", "n_links", "n_copies")


def op9_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_metric_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrictree.codes(table(spark, sf_dir, "embeddings"))


def op13_stripe_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_run_length_index": op2_run_length_index,
    "op3_boosted_quality": op3_boosted_quality,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_link_graph": op5_link_graph,
    "op6_deletion_neighbourhood": op6_deletion_neighbourhood,
    "op7_curriculum_mix": op7_curriculum_mix,
    "op8_chosen_path_join": op8_chosen_path_join,
    "op9_pattern_grammar": op9_pattern_grammar,
    "op10_simhash_windows": op10_simhash_windows,
    "op11_hyperminhash": op11_hyperminhash,
    "op12_metric_tree_codes": op12_metric_tree_codes,
    "op13_stripe_collocations": op13_stripe_collocations,
}
