"""Drawing questions: content deduplication, ranked draws per group for many requests
at once, back-fill, and packing many exams without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.session import durable

# Preferred source of equal content, and the default exam sizes.
SOURCE_PRIORITY = {"qconcursos": 1, "pci": 2}
OTHER_PRIORITY = 3
SUBJECT_EXAM_SIZE = 20
GENERAL_EXAM_SIZE = 60

def source_priority(fonte: Column | str = "fonte") -> Column:
    c = F.col(fonte) if isinstance(fonte, str) else fonte
    ranked = F.lit(OTHER_PRIORITY)
    for name, rank in SOURCE_PRIORITY.items():
        ranked = F.when(c == name, rank).otherwise(ranked)
    return ranked


def matching(
    questions: DataFrame, materia: str | None = None, banca: str | None = None,
    orgao: str | None = None, cargo: str | None = None,
) -> DataFrame:
    """Drawable questions; every given value must be equal, falsy ones do not filter."""
    rows = questions.filter("content_hash is not null")
    for name, value in (("materia", materia), ("banca", banca), ("orgao", orgao), ("cargo", cargo)):
        if value:
            rows = rows.filter(F.col(name) == value)
    return rows


def one_per_content(questions: DataFrame, *keys: str) -> DataFrame:
    """``keys, content_hash, id`` of the preferred row of each content.

    The smallest id of each priority is a hash aggregate with partial combine: however many
    copies one content has, each task sends one row of it.
    """
    ranks = sorted({*SOURCE_PRIORITY.values(), OTHER_PRIORITY})
    lowest = [F.min(F.when(source_priority() == rank, F.col("id"))) for rank in ranks]
    return (
        questions.filter("content_hash is not null")
        .groupBy(*keys, "content_hash")
        .agg(F.coalesce(*lowest).alias("id"))
    )


def _order_digest(seed: str | None) -> Column:
    return F.col("content_hash") if seed is None else F.md5(F.concat("content_hash", F.lit(str(seed))))


def content_pool(questions: DataFrame, *keys: str) -> DataFrame:
    """Drawable content per key and use state: ``keys, usada, content_hash, id``."""
    return one_per_content(questions, *keys, "usada")


def rank_pool(
    pool: DataFrame, keys: tuple[str, ...] = ("materia",), seed: str | None = None,
    max_rank: int | None = None, asked: DataFrame | None = None,
) -> DataFrame:
    """``keys, usada, id, rank``: unused content first, then used, each in digest order.
    ``asked`` (keys and ``_most``) names the groups wanted and how far to rank each."""
    ranked = rank_in_digest_order(pool, keys, "usada", seed, max_rank=max_rank, asked=asked)
    return ranked.select(*keys, "usada", "id", "rank")


def rank_candidates(
    questions: DataFrame, max_rank: int, keys: tuple[str, ...] = ("materia",), seed: str | None = None
) -> DataFrame:
    return rank_pool(content_pool(questions, *keys), keys, seed, max_rank)


def largest(requests: DataFrame, n: str = "n") -> int:
    """Largest request, needed as a literal; one number comes to the driver."""
    return int(requests.agg(F.coalesce(F.max(n), F.lit(0)).alias("m")).first()["m"])


def most_asked(requests: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Groups that are asked for, with their largest request as ``_most``."""
    return requests.filter("n > 0").groupBy(*keys).agg(F.max("n").alias("_most"))


def serve(ranked: DataFrame, requests: DataFrame, keys: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """The first ``n`` ranks for every request: a slot per rank, met by an equi-join, so a
    request makes as many rows as it gets."""
    slots = requests.filter("n > 0").select(
        "exam", *keys, *carry, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n").cast("bigint"))).alias("rank"))
    return slots.join(ranked, [*keys, "rank"]).select("exam", *keys, *carry, "rank", "usada", "id")


def draw(
    questions: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("materia",),
    seed: str | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """``exam, keys, carry, rank, usada, id`` for every request ``exam, keys, n`` (and
    further request columns named in ``carry``); all subjects and requests in one pass
    over the rows of the bank that belong to a requested group."""
    asked = most_asked(requests, keys)
    wanted = questions.join(asked.select(*keys), list(keys), "left_semi")
    return serve(rank_pool(content_pool(wanted, *keys), keys, seed, asked=asked), requests, keys, carry)


def reused_counts(drawn: DataFrame, *keys: str) -> DataFrame:
    """Per request: questions drawn, and how many of them had been used before."""
    return drawn.groupBy("exam", *keys).agg(
        F.count("*").alias("sorteadas"), F.count_if(F.col("usada") == 1).alias("repetidas")
    )


def available(pool: DataFrame, *keys: str) -> DataFrame:
    """Drawable questions per key of a content pool (used and unused copies of one
    content count apart)."""
    return pool.groupBy(*keys).agg(F.count("*").alias("disponiveis"))


def keep_first(rows: DataFrame, by: tuple[str, ...], *order: str) -> DataFrame:
    """First occurrence per key. Meant for lists whose repeats are few (one per list)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def backfill(pool: DataFrame, chosen: DataFrame, missing: DataFrame, seed: str | None = None) -> DataFrame:
    """``exam, rank, usada, id``: fill ``missing(exam, n)`` from any subject, leaving out
    the ids in ``chosen(exam, id)``. ``pool`` is a content pool without keys.

    An exam needs at most n + chosen candidates of the overall order, so that many ranks are
    listed per exam and met by an equi-join; no exam sees the whole bank, and the bank is
    ranked as far as the largest of these sums.
    """
    sizes = chosen.groupBy("exam").agg(F.count("*").alias("_c"))
    span = durable(
        missing.filter("n > 0").join(sizes, "exam", "left")
        .select("exam", F.col("n").alias("_n"), (F.col("n") + F.coalesce("_c", F.lit(0))).cast("bigint").alias("_span")), "span")
    ranked = rank_pool(pool, (), seed, max_rank=largest(span, "_span"))
    slots = span.select("exam", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), "_span")).alias("rank"))
    free = slots.join(ranked, "rank").join(chosen.select("exam", "id"), ["exam", "id"], "left_anti")
    position = F.row_number().over(Window.partitionBy("exam").orderBy("rank")).cast("bigint")
    return (
        free.withColumn("_pos", position).filter("_pos <= _n")
        .select("exam", F.col("_pos").alias("rank"), "usada", "id")
    )


def rank_in_digest_order(
    rows: DataFrame, keys: tuple[str, ...] = ("materia",), lead: str | None = None, seed: str | None = None,
    prefix_chars: int = 4, max_rank: int | None = None, asked: DataFrame | None = None,
) -> DataFrame:
    """Add ``rank`` (bigint) within ``keys`` by (``lead``,) digest, without putting a group into
    one task.

    Digests are uniform, so their first hex characters cut every group, also a dominant
    one, into even ordered buckets: rank = rows in earlier buckets + position inside the
    bucket. Four characters make 65,536 buckets: ten thousand million questions of one
    subject are 150,000 rows each. Buckets that start at or after the bound - ``max_rank``,
    or ``_most`` of the group in ``asked``, which also names the groups - are dropped before
    the sort.
    """
    cut = rows.withColumn("_digest", _order_digest(seed))
    prefix = F.left("_digest", F.lit(prefix_chars))
    cut = cut.withColumn("_b", F.concat(F.col(lead).cast("string"), F.lit("/"), prefix) if lead else prefix)
    sizes = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    if asked is not None:
        offsets = offsets.join(asked, list(keys)).filter("_off < _most")
    else:
        offsets = offsets.withColumn("_most", F.lit(max_rank).cast("bigint"))
        offsets = offsets.filter("_off < _most") if max_rank is not None else offsets
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_digest", "id"))
    ranked = cut.join(offsets, [*keys, "_b"]).withColumn("rank", (F.col("_off") + inside).cast("bigint"))
    return ranked.filter("_most is null or rank <= _most").drop("_digest", "_b", "_off", "_most")


def _sum_of_earlier(rows: DataFrame, key: str, order: str, value: str, name: str, width: int = 65_536) -> DataFrame:
    """Running sum of the rows before, in two levels: over runs of ``width`` order values,
    then inside each run, so no key has to fit one task."""
    cut = rows.withColumn("_g", F.floor(F.col(order) / width))
    sums = cut.groupBy(key, "_g").agg(F.sum(value).alias("_s"))
    by_run = Window.partitionBy(key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_g", F.coalesce(F.sum("_s").over(by_run), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(key, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(offsets, [key, "_g"])
        .withColumn(name, (F.col("_o") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("bigint"))
        .drop("_g", "_o")
    )


def pack_exams(questions: DataFrame, quotas: DataFrame, seed: str | None = None, prefix_chars: int = 4) -> DataFrame:
    """Many exams in a row without overlap: ``exam, materia, pos, reused, id``.

    ``quotas`` is ``exam, exam_pos, materia, n``; exams are served by ``exam_pos`` and mark
    what they draw as used. The result equals one draw after the other, yet every exam is
    placed at once: the quota sums of earlier exams give each slot its rank in the unused
    order. Slots beyond the unused pool take the smallest digests among the questions used
    before that exam: the initially used ones and, for the exam in which the pool runs
    out (``cut``), the part handed to earlier exams; for later exams, all questions.

    The bank is read twice: to count rows per subject and digest bucket, and to give the
    rows of the buckets that can be reached their two running numbers, unused so far and
    all so far. Buckets keep a dominant subject out of a single task, and every rank above
    follows from the two numbers. Slots and questions then meet in one equi-join.

    Needs a bank without duplicate content (see insert-if-new).
    """
    bank = questions.filter("content_hash is not null").select(
        "materia", "usada", "id", _order_digest(seed).alias("_digest")
    ).withColumn("_b", F.left("_digest", F.lit(prefix_chars)))
    before = Window.unboundedPreceding
    demand = _sum_of_earlier(quotas.filter("n > 0"), "materia", "exam_pos", "n", "_start").select(
        "exam", "materia", F.col("n").cast("int").alias("n"), "_start"
    )

    # small: one row per subject and bucket
    sizes = durable(
        bank.groupBy("materia", "_b").agg(F.count_if(F.col("usada") == 0).alias("_nu"), F.count("*").alias("_na"))
    )
    unused = sizes.groupBy("materia").agg(F.sum("_nu").alias("_m"))
    plan = durable(demand.join(unused, "materia", "left").withColumn("_m", F.coalesce("_m", F.lit(0))))
    most = largest(plan)
    at_cut = (F.col("_start") < F.col("_m")) & (F.col("_start") + F.col("n") > F.col("_m"))
    need = plan.groupBy("materia").agg(
        F.max(F.col("_start") + F.col("n")).alias("_asked"),
        F.max(F.when(at_cut, F.col("_start"))).alias("_cut"),
        F.max(F.col("_start") >= F.col("_m")).alias("_late"),
    )

    by_bucket = Window.partitionBy("materia").orderBy("_b").rowsBetween(before, -1)
    offsets = sizes.select(
        "materia", "_b",
        F.coalesce(F.sum("_nu").over(by_bucket), F.lit(0)).alias("_u"),
        F.coalesce(F.sum("_na").over(by_bucket), F.lit(0)).alias("_a"),
    ).join(need, "materia")

    def cut_rank(u, a):
        return (a - u) + F.least(u, F.col("_cut"))

    reachable = offsets.filter(
        (F.col("_u") < F.col("_asked"))
        | (F.col("_late") & (F.col("_a") < most))
        | (cut_rank(F.col("_u"), F.col("_a")) < most)
    )
    inside = Window.partitionBy("materia", "_b").orderBy("_digest", "id").rowsBetween(before, 0)
    is_unused = F.col("usada") == 0
    counted = bank.join(reachable, ["materia", "_b"]).withColumns(
        {
            "_u": F.col("_u") + F.count_if(is_unused).over(inside),
            "_a": F.col("_a") + F.count("*").over(inside),
        }
    )
    b = cut_rank(F.col("_u"), F.col("_a"))
    in_cut = F.col("_cut").isNotNull() & (~is_unused | (F.col("_u") <= F.col("_cut"))) & (b <= most)
    places = F.array(
        F.when(is_unused & (F.col("_u") <= F.col("_asked")), F.struct(F.lit("fresh").alias("k"), F.col("_u").alias("r"))),
        F.when(in_cut, F.struct(F.lit("cut").alias("k"), b.alias("r"))),
        F.when(F.col("_late") & (F.col("_a") <= most), F.struct(F.lit("late").alias("k"), F.col("_a").alias("r"))),
    )
    placed = counted.select("materia", "id", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("x")).select(
        "materia", "id", F.col("x.k").alias("_kind"), F.col("x.r").alias("_rank")
    )

    slots = plan.withColumn("pos", F.explode(F.sequence(F.lit(1), "n"))).withColumn(
        "_rank", F.col("_start") + F.col("pos")
    )
    fresh = F.col("_rank") <= F.col("_m")
    slots = slots.select(
        "exam", "materia", "pos",
        F.when(fresh, "fresh").when(F.col("_start") >= F.col("_m"), "late").otherwise("cut").alias("_kind"),
        F.when(fresh, F.col("_rank")).otherwise(F.col("_rank") - F.greatest("_start", "_m")).alias("_rank"),
    )
    return slots.join(placed, ["materia", "_kind", "_rank"]).select(
        "exam", "materia", "pos", (F.col("_kind") != "fresh").alias("reused"), "id"
    )


# --- search and paging ------------------------------------------------------

def search_names(rows: DataFrame, term: str, column: str = "categoria") -> DataFrame:
    """Case-insensitive substring match."""
    return rows.filter(F.contains(F.lower(column), F.lower(F.lit(term))))


def browse(
    questions: DataFrame, materia: str | None = None, categoria: str | None = None,
    tema: str | None = None, after_id: int | None = None, page_size: int | None = None, skip: int = 0,
) -> DataFrame:
    """Hierarchical filter with keyset paging: rows after ``after_id`` in id order. The
    offset form (``skip``) reads everything it skips; keyset paging does not."""
    rows = questions
    for name, value in (("materia", materia), ("categoria", categoria), ("tema", tema)):
        if value:
            rows = rows.filter(F.col(name) == value)
    if after_id is not None:
        rows = rows.filter(F.col("id") > after_id)
    return rows.orderBy("id").offset(skip).limit(page_size) if page_size else rows


def question_by_id(questions: DataFrame, wanted: int) -> DataFrame:
    return questions.filter(F.col("id") == wanted)


def search_text(questions: DataFrame, terms: list[str], top: int | None = None) -> DataFrame:
    """Questions whose statement has every term as a word; ``score`` counts their
    occurrences. ``top`` keeps the best, ties by id."""
    words = F.split(text.normalize_text("enunciado"), " ")
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    rows = questions.withColumn("_w", words)
    hits = F.filter(F.col("_w"), lambda w: F.array_contains(wanted, w))
    for t in terms:
        rows = rows.filter(F.array_contains("_w", t.lower()))
    scored = rows.withColumn("score", F.size(hits)).drop("_w")
    return scored.orderBy(F.desc("score"), "id").limit(top) if top else scored
