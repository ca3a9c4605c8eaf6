"""The pipeline against a plain version of each stage, with clashing columns and without rows."""

from __future__ import annotations

import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard long, rows string, key long, a long, b long, n int, label int, cuts string, kept boolean"


def corpus():
    rnd = random.Random(11)
    words = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(10**6)}x" for _ in range(n)]
    text = lambda w: "".join(x + (".\n" if k % 12 == 11 else " ") for k, x in enumerate(w)).strip()
    first, other, third, passage = words(130), words(140), words(90), words(64)
    near = list(first)
    near[60] = "changed"
    holder, repeater = words(30) + passage + words(40), words(54) + passage + words(45)
    mail = words(70) + ["someone.x@site.org", "and"] + words(30)
    docs = {1: text(first), 2: text(first), 3: text(near), 4: text(other) + "\nRead more | Home | Next page | Sign in", 5: text(holder), 6: text(repeater), 7: text(mail), 8: "too short", 9: None, 10: text(third)}
    want = {1: docs[1], 4: text(other), 5: docs[5], 6: None, 7: docs[7].replace("someone.x@site.org", "[EMAIL]"), 10: docs[10]}
    return docs, want, repeater, passage


@pytest.fixture(scope="module")
def frame(spark):
    docs, *_ = corpus()
    return spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t or ""), 1, "r", 2, 3, 4, 5, 6, "c", True) for d, t in docs.items()], COLUMNS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, frame, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, frame, "")
    assert got.columns == frame.columns and {r.n for r in got.collect()} == {5}
    empty = stage(spark, frame.limit(0), "")
    assert empty.columns == frame.columns and empty.count() == 0


def test_run_equals_the_plain_version(spark, frame, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs, want, repeater, passage = corpus()
    # The repeated passage goes with the white space behind it; lines end after the same words of it in both documents (30 and 54 words lie before it).
    lines, at = docs[6].split(), repeater.index(passage[0])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def pieces(text):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        return [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]

    got = {r.doc_id: [(r.length, r.ids_crc32)] for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert all(got[d] == pieces(t) for d, t in want.items() if t is not None)
    assert got[6][0][0] < pieces(docs[6])[0][0] - len(passage) and len(lines) == len(repeater) and at == 54


def test_run_on_an_empty_table(spark, frame, tmp_path):
    frame.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_give_back_what_a_stage_has_used(spark):
    def held(batches):
        def used():
            return next(int(x.split()[1]) // 1024 for x in open("/proc/self/status") if x.startswith("RssAnon"))

        for batch in batches:
            large = np.ones(30 << 17)  # once freed, the system's own rule keeps arrays up to its size
            del large
            before, kept, small = used(), [], []
            for _ in range(40):
                kept.append(np.ones(6 << 17))
                small.append(bytes(5000))
            most = used()
            del kept
            yield pa.RecordBatch.from_arrays([pa.array([most - before]), pa.array([used() - before])], ["most", "left"])

    environment = dict(spark.sparkContext.environment)
    try:
        corpus_pipeline.lean_workers(spark)
        row = spark.range(1, numPartitions=1).mapInArrow(held, "most long, left long").first()
    finally:
        spark.sparkContext.environment.clear()
        spark.sparkContext.environment.update(environment)
    assert row.most > 200 and row.left < 60


def test_passages_are_cut_though_the_first_and_last_with_their_run_do_not_have_them(spark):
    rng = np.random.default_rng(31)

    def w(n):
        return [f"s{k}" for k in rng.integers(0, 10**7, n)]

    source = w(56)
    near = [*source[:27], "near", *source[28:]]
    half = [source[:27], source[28:]]
    rows = [(n if n < 60 else 900 + n, " ".join(w(30) + half[n % 2] + w(30))) for n in range(120)]
    rows += [(500, " ".join(w(30) + source + w(30))), (5000, " ".join(["a", *w(29), *near, *w(30)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert len(kept) == 122 and len(kept[5000].split()) == 60 and "near" not in kept[5000].split()
    assert all(kept[i] == t for i, t in rows if i != 5000)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_run_by_themselves_ask_for_workers_that_give_back(spark, frame, name):
    environment = dict(spark.sparkContext.environment)
    try:
        for x in corpus_pipeline.WORKER_MEMORY:
            spark.sparkContext.environment.pop(x, None)
        dict(corpus_pipeline.STAGES)[name](spark, frame.limit(0), "")
        assert corpus_pipeline.WORKER_MEMORY.items() <= spark.sparkContext.environment.items()
    finally:
        spark.sparkContext.environment.clear()
        spark.sparkContext.environment.update(environment)
