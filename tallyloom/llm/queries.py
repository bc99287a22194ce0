"""Registered queries of this subpackage: each applies its operator to a whole table.

A query only reads its tables, calls its operator with production parameters
and names the columns of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary, at the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder_is(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; null ids are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).drop("name")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxic_passages

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~remainder_is(5, 0)))
    out = toxic_passages(docs, model, passages=False)
    return out.select("doc_id", remainder_is(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vecdedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit_languages, identify

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~remainder_is(3, 1)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", remainder_is(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_digests

    return substring_digests(table(spark, sf_dir, "documents"), length=50)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return score_quality(docs, table(spark, sf_dir, "labels"), order=4).select("doc_id", "perplexity", "adjusted", "threshold", "rejected")


def periodic_tail(docs: DataFrame) -> DataFrame:
    """One text in ten, by crc32 of its doc_id, with words that repeat from some place on; all others as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = docs.withColumn("__words", F.when(h % 10 == 0, words)).withColumn("__n", F.size("__words").cast("long"))
    a = F.when(F.col("__n") > 0, g % F.col("__n"))  # a null array has size -1 or null
    chosen = chosen.withColumn("__a", a).withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    every = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)
    repeated = F.concat_ws(" ", F.transform(every, lambda i: F.get("__words", place(i).cast("int"))))
    return chosen.withColumn("text", F.when(F.col("__a").isNotNull(), repeated).otherwise(F.col("text"))).drop("__words", "__n", "__a", "__p")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    docs = periodic_tail(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = periodic_runs(docs, least=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    figures = (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli")
    return out.select("doc_id", "n_runs", *figures, "runs_sha256", "collapsed_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"), least=30, smoothing=5, top=50)


def op13_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .balance import pack_balanced

    out = pack_balanced(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_masked_lm": op6_masked_lm,
    "op7_language_id": op7_language_id,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_balanced_packing": op13_balanced_packing,
}
