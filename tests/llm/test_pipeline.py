from collections import Counter

import data
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quaestor.llm.mixing import mix_sources
from quaestor.llm.near_duplicates import near_duplicates
from quaestor.session import BATCH_BYTES, ship_package


def test_stages_in_order_and_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
            clean = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id", "left_semi")
            assert clean.join(docs, "doc_id", "left_anti").count() <= 0.02 * clean.count()
        if name == "near_duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count() < before
            assert near_duplicates(docs).filter("NOT kept").count() == 0
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "mix_sources", "best_fit_packing"]
    packed = cp.pack(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_awkward_documents(spark, tmp_path, sf_dir):
    docs = data.awkward_documents(spark)
    for stage in (cp.keep_known_languages, cp.keep_good_quality, cp.keep_one_of_each_group, cp.mix_to_weights, cp.pack):
        assert stage(spark, docs, sf_dir).count() >= 0
        assert stage(spark, data.empty(docs), sf_dir).count() == 0
    kept = cp.keep_one_of_each_group(spark, docs, sf_dir).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [-3, 1, 3, 4, 5, 6, 7, 9, 10]


def test_mix_emits_its_targets(spark, sf_dir):
    """Weights 1, 2, 3 by name; ratios of target to size: 0.2, 0.6, 1.4, 2.6 about."""
    import random

    rng, rows = random.Random(4), []
    for source, words in [("a", 300_000), ("b", 200_000), ("c", 128_000), ("d", 23_000)]:
        while words > 0:
            size = min(words, rng.choice([20, 250, 250, 400, 3000]))
            rows.append((len(rows) if rng.random() < 0.7 else rng.choice([None, 7]), " ".join(["w"] * size) + f" {len(rows)}", "en", source))
            words -= size + 1
    docs = data.documents(spark, rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in mix_sources(docs).join(docs.select("doc_id", "source").filter("doc_id <> 7"), "doc_id").collect()}
    mixed = cp.mix_to_weights(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    emitted, times = Counter(), Counter()
    for r in mixed.collect():
        emitted[r["source"]] += len(r["text"].split())
        times[r["text"]] += 1
    for source, (target, size) in targets.items():
        assert abs(emitted[source] - target) <= 1500 + 64
        assert {times[t] for _, t, _, s in rows if s == source} <= {int(target / size), int(target / size) + 1}
        # long documents are taken like short ones
        long = sum(len(t.split()) * times[t] for _, t, _, s in rows if s == source and len(t) > 5000)
        whole = sum(len(t.split()) for _, t, _, s in rows if s == source and len(t) > 5000)
        assert source == "d" or abs(long / whole - target / size) < 0.2


def test_rows_without_or_with_equal_ids(spark, sf_dir):
    """Whatever their ids, different texts stay and near copies go."""
    texts = [" ".join(f"t{i}w{k}" for k in range(64)) for i in range(40)]
    ids = [None] * 15 + [7] * 15 + list(range(100, 110))
    rows = [(i, t, "en", "a") for i, t in zip(ids, texts)]
    copies = [(None, texts[35] + " end", "en", "a"), (3, texts[0], "en", "a"), (None, texts[1], "en", "a"), (7, texts[20], "en", "a"), (9, texts[20] + " end", "en", "a")]
    docs = data.documents(spark, rows + copies)
    kept = cp.keep_one_of_each_group(spark, docs, sf_dir)
    want = Counter(rows) - Counter([rows[0]]) + Counter([copies[1]])
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in kept.collect()) == want
    mixed = cp.mix_to_weights(spark, kept, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in mixed) == want


def test_language_stage_rejects_what_no_labelled_document_speaks(spark, sf_dir):
    """Expected rows: texts of the labelled languages stay, one of another and those without letters go."""
    import random

    rng = random.Random(6)

    def prose(words, n):
        return " ".join(rng.choice(words) for _ in range(n))

    en, de = data.PROSE["en"].split(), data.PROSE["de"].split()
    other = "perheen vanha talo seisoi joen varrella ikkunat avautuivat metsään iltaisin kuului lintujen laulua kesäyönä kylän läpi kulki hiekkatie".split()
    known = [(i, prose(en if i % 2 else de, 40), "en" if i % 2 else "de", "a") for i in range(520)]
    unlabelled = [(1000 + i, prose(en, 30) if i % 2 else prose(de, 30), None, "a") for i in range(20)]
    gone = [(2000, prose(other, 60), None, "a"), (2001, prose(other, 8), None, "a"), (2002, "12 34 !!", "en", "a"), (2003, None, "en", "a"), (2004, "", None, "a")]
    docs = data.documents(spark, known + unlabelled + gone)
    kept = {r["doc_id"] for r in cp.keep_known_languages(spark, docs, sf_dir).collect()}
    assert kept == {r[0] for r in known + unlabelled}


def test_packing_stage_gives_every_piece_a_place(spark, sf_dir):
    """Against encoding whole texts and laying the pieces out one by one."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from quaestor.llm.queries import tokenizer_path

    rows = [(i, f"word{i} and more " * n, "en", "a") for i, n in enumerate([1, 3, 0, 900, 2000, 50, 700])] + [(9, None, "en", "a")]
    packed = cp.pack(spark, data.documents(spark, rows), sf_dir).collect()
    tokenizer, want = Tokenizer.from_file(tokenizer_path()), set()
    for i, text, _, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start:start + 4096], "<u4")
            want.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed} == want and len(packed) == len(want)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)]).tolist()]
        assert [at for at, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    total = sum(n for _, _, _, n, _ in want)
    assert len(by_sequence) == -(-total // 4096)


def test_workers_get_batches_of_bounded_bytes(spark):
    """A task holds its batches outside the heap; a session that says how large they are is left alone."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    session, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    ship_package(session)
    rows = session.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    found = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) < 1.1 * BATCH_BYTES
    session.conf.set(key, "1000000")
    ship_package(session)
    assert session.conf.get(key) == "1000000"
