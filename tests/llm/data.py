"""Small tables with everything that may go wrong in them."""

from pyspark.sql import types as T

PROSE = {
    "en": "the cat and the dog were in the house that is by the river for a long time and they had not seen it before",
    "de": "der hund und die katze sind nicht in dem haus das an einem fluss steht und sie haben es auch noch nie gesehen",
}


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], schema)


def awkward_documents(spark):
    long_text = " ".join(f"w{i % 997}x" for i in range(40_000))
    return documents(spark, [
        (1, PROSE["en"], "en", "a"), (2, PROSE["en"], "en", "a"), (2, PROSE["en"], "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", "en", ""), (6, "one", "en", "a"),
        (7, long_text, "en", "b"), (8, long_text + " end", "en", None), (None, PROSE["de"], "de", "a"), (None, None, None, None),
        (9, "123 456 !!", None, "c"), (10, "é日本 \U0001f600\u00a0x", "de", "c"), (-3, PROSE["de"].upper(), "de", "a"),
    ])


def with_clashes(df):
    """The same with columns named like results and helpers."""
    from pyspark.sql import functions as F

    names = ["score", "size", "taken", "target", "kept", "component_id", "lang_pred", "lang_score", "bands", "node", "shard", "key",
             "host", "rule", "verdict", "_url", "sequence_id", "offset", "tokens", "window", "rank"]
    return df.select("*", *[F.lit("clash").alias(n) for n in names if n not in df.columns])


def empty(df):
    return df.limit(0)


def schema_of(df):
    return T.StructType(df.schema.fields)
