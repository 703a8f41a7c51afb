"""From raw documents to a plan of packed training sequences.

Stages, each reading what the one before wrote: language ID, quality classifier, near duplicates,
mixing to source weights, best-fit packing. All but the last return the columns of documents; the
last says of every piece of every document in which sequence and at which place it lies
(``packing.tokenized_pieces`` and ``packing.sequences`` make the ids of those).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm.language import UNKNOWN, familiar_floor, identify_languages, language_model
from quaestor.llm.mixing import mix_documents
from quaestor.llm.near_duplicates import near_duplicates
from quaestor.llm.packing import pack_pieces, tokenized_pieces
from quaestor.llm.quality import quality_model, quality_scores
from quaestor.llm.queries import tokenizer_path
from quaestor.session import durable

#: a document is rejected when it has no letters at all
#: or when no language holds this share of its words
LANGUAGE_SHARE = 0.3
#: and when label 1 is less likely than this
QUALITY = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, those whose words are of no language mostly, and those of
    a language that none of the labelled documents has: too few of their n-grams are known."""
    learn = F.col("doc_id").isNotNull()
    model = language_model(docs, learn)
    judged = durable(identify_languages(docs, model, familiar=True), "judged")  # the threshold is of all of them
    sure = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LANGUAGE_SHARE) & (F.col("lang_familiar") >= familiar_floor(judged, learn))
    return judged.filter(sure).select(*docs.columns)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the labelled ones teach to be of label 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model(docs, labels, F.lit(True))
    return quality_scores(docs, model).filter(F.col("score") >= QUALITY).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) one row stays, that of the smallest id;
    of several with that id one, and one without id only where none has any. Ids name nothing
    here: rows are numbered, so different texts under one id are different documents. Rows without
    words are nobody's duplicates."""
    digest = F.xxhash64(*[part for c in docs.columns for part in (F.col(c).isNull(), F.col(c))])
    rows = durable(docs.withColumn("_digest", digest).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    owners = rows.select("_row", "doc_id", "_digest").join(groups, "_row")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_digest", "_row")
    first = owners.groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as it takes to carry out its source's quota of words; one
    without words has no part in any quota."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence, place and digest of ids."""
    pieces = tokenized_pieces(docs, tokenizer_path())
    digests = durable(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack_pieces(digests)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("mix_sources", mix_to_weights),
    ("best_fit_packing", pack),
]
#: learned models and tokenizers have no SQL form; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
