"""The registered queries of this package: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, factors, impacts, licenses, lines, minhash, parity, personal, pieces, quality, suffixes, topk
from .stages import documents_of, small_batches

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return pieces.digests(documents_of(spark, sf_dir), PIECE_MODEL)


@query
def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that go, and the digest of what stays."""
    docs = documents_of(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = lines.without(docs, lines.repeated_lines(docs)).withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))
    return kept.select("doc_id", "n_removed", (F.col("n_lines") * (F.length("text") > 0).cast("long")).alias("n_kept"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that all documents are or hold as a paragraph or a line."""
    docs = documents_of(spark, sf_dir)
    return licenses.per_document(docs, licenses.scan(docs, licenses.known_digests(spark)))


ORACLES["op2_licenses"] = licenses.sql()


def remainder(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> quality.Model:
    """Fitted on the labels outside the held-out third."""
    return quality.fit(docs.where(remainder("doc_id") != 1), documents_of(spark, sf_dir, "labels").where(remainder("doc_id") != 1))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; held_out marks the third whose labels weren't used."""
    docs = documents_of(spark, sf_dir)
    scored = quality.score(docs.select("doc_id", "text"), quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (remainder("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a ten-word window of a benchmark item."""
    return decontaminate.digests(decontaminate.spans(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "benchmark")))


@query
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity of 0.85 or more."""
    found = minhash.groups(documents_of(spark, sf_dir), size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


@query
def op5_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in 50-word windows that also start in a smaller document."""
    return factors.digests(factors.duplicate_spans(documents_of(spark, sf_dir)))


@query
def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents in 100-byte strings that also start earlier."""
    return suffixes.digests(suffixes.duplicate_spans(documents_of(spark, sf_dir))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans of the patterns, and those the random field adds."""
    docs = documents_of(spark, sf_dir)
    return personal.digests(personal.find(docs, personal.fit(docs)))


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector."""
    table = topk.whole_numbers(documents_of(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.search(table.where("vec_id % 50 = 0"), table, 5)


ORACLES["op9_topk"] = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, v.vec_id, list_dot_product(q.e, v.e)::bigint score from v q join v on q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int rank, vec_id, score from s
qualify rank <= 5"""


@query
def op11_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity components of all documents: five-word shingles, Jaccard of 0.8 or more."""
    found = parity.groups(documents_of(spark, sf_dir), size=5, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op12_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return impacts.search(documents_of(spark, sf_dir), documents_of(spark, sf_dir, "benchmark"), 10)


ORACLES["op12_impacts"] = impacts.sql(10)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in all documents."""
    return alignment.digests(documents_of(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), PIECE_MODEL)
