"""Table schemas. Column names follow the data model of the question bank."""

from pyspark.sql import types as T

OPTIONS = T.MapType(T.StringType(), T.StringType())
TEXTS = T.ArrayType(T.StringType())


def _schema(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


QUESTIONS = _schema(
    ("id", T.LongType(), False),
    ("id_qc", T.StringType(), True),
    ("enunciado", T.StringType(), False),
    ("hash_enunciado", T.StringType(), False),
    ("content_hash", T.StringType(), True),
    ("alternativas", OPTIONS, False),
    ("gabarito", T.StringType(), True),
    ("comentario", T.StringType(), True),
    ("materia", T.StringType(), False),
    ("assunto", T.StringType(), True),
    ("ano", T.IntegerType(), True),
    ("prova", T.StringType(), True),
    ("fonte", T.StringType(), False),
    ("usada", T.IntegerType(), False),
    ("texto_associado", T.StringType(), True),
    ("imagens", TEXTS, True),
    ("categoria", T.StringType(), True),
    ("tema", T.StringType(), True),
    ("imagens_urls", TEXTS, True),
    ("banca", T.StringType(), True),
    ("orgao", T.StringType(), True),
    ("cargo", T.StringType(), True),
)

EXAM_SPECS = _schema(
    ("concurso", T.StringType(), False),
    ("nome", T.StringType(), True),
    ("banca", T.StringType(), True),
    ("ano", T.IntegerType(), True),
    ("orgao", T.StringType(), True),
    ("formato", T.StringType(), True),
    ("total_questoes", T.IntegerType(), True),
    ("tempo_minutos", T.IntegerType(), True),
    ("cargo", T.StringType(), True),
    ("nivel", T.StringType(), True),
    ("vagas", T.IntegerType(), True),
    ("ordinal", T.IntegerType(), True),
    ("materia", T.StringType(), True),
    ("peso", T.DoubleType(), True),
)

# what one parsed page block yields (sites A and B)
BLOCKS = _schema(
    ("page_id", T.LongType(), False),
    ("pos", T.IntegerType(), False),
    ("id_qc", T.StringType(), True),
    ("enunciado", T.StringType(), True),
    ("alternativas", OPTIONS, True),
    ("materia_qc", T.StringType(), True),
    ("assunto", T.StringType(), True),
    ("origem", T.StringType(), True),
    ("texto_associado", T.StringType(), True),
    ("imagens", TEXTS, True),
    ("imagens_urls", TEXTS, True),
)
