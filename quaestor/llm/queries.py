"""One query per operator of this subpackage, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import oracles
from quaestor.llm import chat, fingerprints as fp
from quaestor.llm.html_text import extract_text
from quaestor.llm.language import identify_languages, language_model
from quaestor.llm.mixing import mix_sources
from quaestor.llm.near_duplicates import near_duplicates
from quaestor.llm.nearest import nearest_neighbours
from quaestor.llm.order import cyclic_predecessors
from quaestor.llm.packing import pack_pieces, tokenized_pieces
from quaestor.llm.phrases import collocations
from quaestor.llm.quality import quality_model, quality_scores
from quaestor.llm.spelling import variant_forms, word_counts
from quaestor.llm.toxicity import toxicity_model, toxicity_scores
from quaestor.llm.url_filter import url_filter
from quaestor.session import durable, once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "score", "verdict")


SQL["op1_url_filter"] = oracles.OP1


def id_remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality_model(docs, labels, id_remainder(4) != 2)
    return quality_scores(docs, model).select(
        "doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is sent to the one before it: as much of its text as that one replaces, and
    its sketch. Rows without an id have no next document; of rows that share an id the smallest
    text is the one sent."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    needs = docs.groupBy(F.col("doc_id").alias("before")).agg(F.max(F.floor(F.char_length("text") / 2)).cast("int").alias("need"))
    needs = cyclic_predecessors(docs).join(needs, "before")  # ids and numbers only
    # both uses of the named rows read the texts from this one exchange
    dealt = docs.filter("doc_id IS NOT NULL").repartition("doc_id")
    sent = dealt.join(needs, "doc_id").groupBy("doc_id", "before").agg(F.min("text").alias("text"), F.first("need").alias("need"))
    sent = fp.sketch_columns(sent, {"next_sketch": F.col("text")}).select(
        F.col("before").alias("doc_id"), F.expr("left(text, need)").alias("donor"), "next_sketch")
    joined = dealt.join(sent, "doc_id", "left").unionByName(docs.filter("doc_id IS NULL"), allowMissingColumns=True)
    joined = joined.withColumn("n_chars", F.char_length("text").cast("long"))
    kept = F.expr("left(text, n_chars - floor(n_chars / 2))")
    joined = once(joined, edited=F.concat(kept, F.coalesce(F.expr("left(donor, floor(n_chars / 2))"), F.lit(""))))
    joined = fp.sketch_columns(joined, {"sketch": F.col("text"), "edited_sketch": F.col("edited")})
    return joined.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fp.as_text(F.col("sketch")).alias("fingerprint"), fp.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fp.resemblance(F.col("sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>"))).alias("near_next"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenized_pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    digests = durable(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack_pieces(digests)


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


SQL["op7_near_duplicates"] = oracles.OP7


@query
def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is read back from the windows, by conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    windows = chat.chat_windows(turns.unionByName(extra))
    read = once(windows, turns=chat.read_turns(F.col("formatted")))
    new = F.slice("turns", F.col("repeated") + 1, F.greatest(F.size("turns") - F.col("repeated"), F.lit(0)))
    digest = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per_window = read.select(
        "conv_id", "segment", "window", (F.size("turns") - F.col("repeated")).alias("n"), digest.alias("said"),
        F.array_join(chat.read_targets(F.col("formatted"), F.col("mask")), "").alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    joined = per_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("segment", "window", "said", "loss"))).alias("parts"))
    joined = once(joined, said=F.array_join("parts.said", ""), loss=F.array_join("parts.loss", ""))
    return joined.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


SQL["op8_chat_windows"] = oracles.OP8


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_model(docs, id_remainder(5) != 0)
    return identify_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(id_remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL["op10_mix_sources"] = oracles.OP10


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity_model(docs, labels, id_remainder(4) != 2)
    return toxicity_scores(docs, model).select(
        "doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run whose digest 97 divides loses one code point, so that the texts hold misspellings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    digest = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = F.pmod(digest, F.char_length("run")).cast("int")
    cut = F.when(digest % 97 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    # no run grows, so those of fewer than five code points give no word
    words = word_counts(docs, r"[A-Za-z\u00C0-\u00FF]{5,}", cut).filter((F.char_length("word") >= 5) & (F.col("n") >= 3))
    return variant_forms(words)


SQL["op12_spelling_variants"] = oracles.OP12


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL["op13_collocations"] = oracles.OP13
