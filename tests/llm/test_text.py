"""Quality rules, personal data, packing, shards, SentencePiece, the classifier and the pipeline."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from rasterlake.llm import packing, pii_crf, quality_gam, quality_rules, sentencepiece_match, token_shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = "".join(" ".join(f"{w}{k}" for w in ("The", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs")) + ".\n" for k in range(8))


def rows():
    return [(1, CLEAN), (2, None), (3, ""), (4, " \n\t "), (5, "# $ % " * 80), (6, "LOUD!! WORDS!! " * 60), (7, "again again again " * 50), (8, CLEAN + "Released under the X License.\n"), (9, "word " * 30000), (10, CLEAN), (10, CLEAN), (None, CLEAN), (11, "漢字 é\x0b\x1c x y " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "w", 3) for d, t in rows()], "doc_id long, text string, words string, n int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    many = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 3000 else set(grams)
    covered = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, empty):
    got = quality_rules.judged(docs).collect()
    assert len(got) == len(rows())
    texts = dict(rows())
    for r in got:
        want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    kept = {r.doc_id for r in got if r.kept}
    assert {1, 8, 10, None} <= kept and not kept & {2, 3, 4, 5, 6, 7, 9}
    assert quality_rules.judged(empty).count() == 0


def test_kept_documents(docs):
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[1] == CLEAN and "License" not in texts[8] and texts[8].startswith(CLEAN.strip())


PATTERNS = [(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), (2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 16 <= len(digits) <= 19 and pii_crf.luhn(digits) or kind == 3 and 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(3)
    for _ in range(6000):
        text = "".join(rnd.choice("a@.1+- b0(255é") for _ in range(rnd.randint(0, 40)))
        assert pii_crf.base_spans(text) == plain(text)
    assert pii_crf.base_spans("a" * 200_000 + "@" * 1000) == []


def planted(n=240):
    """Documents with personal data, some of it repeated in a form that no base pattern takes: (id, text, added spans)."""
    rnd, out = random.Random(5), []
    prose = lambda: " ".join(rnd.choice(["the", "of", "and", "river", "stone"]) for _ in range(rnd.randint(2, 9)))
    for k in range(n):
        area, line = rnd.randint(200, 999), rnd.randint(1000, 9999)
        phone = f"+1 ({area}) 555-{line}"
        name = f"me.x{rnd.randint(100, 999)}"
        card = "".join(rnd.choice("123456789") for _ in range(15))
        card = next(card + d for d in "0123456789" if pii_crf.luhn(card + d))
        secret = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        kind = k % 6
        first = [phone, f"{name}@site.org", card, f'token = "{secret}"', phone, f"order {rnd.randint(10**8, 10**9)}"][kind]
        again = [phone, f"{name}@site.org", card, f'token = "{secret}"', f"+{area}555{line}", f"part {rnd.randint(10**7, 10**8)}"][kind] if k % 12 < 6 else [f"{area}-555-{line}", f"{name} (at) site (dot) org", f"xxxx xxxx xxxx {card[12:]}", secret, f"{area} 555 {line}", "none"][kind]
        text = f"{prose()} {first} {prose()} {again} {prose()}"
        want = {(("phone", "email", "card", "secret", "phone", "")[kind], text.rindex(again), text.rindex(again) + len(again))} if k % 12 >= 6 and kind < 5 else set()
        out.append((k, text, want))
    return out


def test_repeats_that_no_pattern_takes_are_added(spark):
    texts = planted()
    got = {r.doc_id: r for r in pii_crf.find(spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string")).collect()}
    caught = wanted = 0
    for k, text, want in texts:
        spans = {(s.split(":")[0], *map(int, s.split(":")[1:])) for s in got[k].spans.split(",") if s}
        base = {(pii_crf.KINDS[c], a, b) for c, a, b in plain(text)}
        assert base <= spans
        added = {s for s in spans - base if not text[: s[1]].endswith('token = "')}
        assert added <= want, text
        caught, wanted = caught + len(added & want), wanted + len(want)
    assert wanted == 100 and caught >= 95


def test_messages_agree_with_enumeration():
    import itertools

    rng = np.random.default_rng(9)
    for case in range(12):
        n = 3 + case % 4
        keys = [f"{k}" for k in range(n)]
        if case % 2:
            keys[-1] = keys[0]  # a loop
        found = [pii_crf.Mention(1 if k == 1 and case % 3 == 0 else -1, 10 * k, 10 * k + 5, keys[k], "", f"s{k % 3}", k % 2) for k in range(n)]
        p = pii_crf.Potentials({f"s{k}": rng.normal(size=6) for k in range(3)}, rng.normal(size=(6, 6)), 0.3 * rng.normal(size=(6, 6)), 1.0, 0.5, np.zeros(6))
        exact = np.zeros((n, 6))
        for labels in itertools.product(range(6), repeat=n):
            if any(m.kind >= 0 and labels[k] != m.kind + 1 for k, m in enumerate(found)):
                continue
            score = sum(p.shape[m.shape][y] + p.cue[m.cue][y] for m, y in zip(found, labels, strict=True) if m.kind < 0)
            score += sum(p.chain[a, b] for a, b in itertools.pairwise(labels)) + sum((p.equal if e else p.alike) * (labels[i] == labels[j]) for i, j, e in pii_crf.skips(found))
            for k, y in enumerate(labels):
                exact[k, y] += np.exp(score)
        exact /= exact.sum(1, keepdims=True)
        assert np.abs(pii_crf.label_mentions(found, p, 60) - exact).max() < (0.05 if case % 2 else 1e-6)


def test_personal_data(spark, empty):
    card = "4111 1111 1111 1111"
    texts = [(1, f"mail me.x@site.org or call +1 706 555 3138, card {card}"), (2, None), (3, ""), (4, "1234567812345678 fails, 12.300.1.1 too"), (5, "+1 (706) 555-3138 and later 1-706-555-3138 once more"), (6, "x" * 50000)]
    docs = spark.createDataFrame(texts * 2, "doc_id long, text string").withColumnRenamed("text", "t").selectExpr("doc_id", "t AS text", "'k' AS kind")
    p = pii_crf.train(spark.createDataFrame([(k, t) for k, t, _ in planted()], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii_crf.find(docs, p).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 0, 1, 1)
    assert got[4].spans == "" and got[2].spans == got[3].spans == ""
    assert got[5].spans == "phone:0:17,phone:28:42" and got[5].n_added == 1 and got[5].n_phone == 1
    clean = {r.doc_id: r.text for r in pii_crf.redacted(docs, p).collect()}
    assert clean[1] == "mail [EMAIL] or call [PHONE], card [CARD]" and clean[2] is None and clean[4] == texts[3][1]
    assert pii_crf.find(empty).count() == 0 and pii_crf.redacted(empty).count() == 0


def test_packing(docs, empty):
    encoding = packing.byte_bpe(packing.default_vocabulary())
    got = packing.pack(docs, length=256).collect()
    texts = dict(rows())
    spans = {}
    for r in got:
        ids = [*encoding.encode_ordinary(texts[r.doc_id] or ""), 0]
        part = ids[r.start : r.start + r.length]
        assert len(part) == r.length <= 256 and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert total == sum(len(encoding.encode_ordinary(t or "")) + 1 for _, t in rows()) and len(spans) <= -(-total // 256) + 2
    assert packing.pack(empty).count() == 0
    special = packing.pack(docs.sparkSession.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")).collect()
    assert [(r.length, r.ids_crc32) for r in special] == [(4, zlib.crc32(np.array([64, 50256, 65, 0], "<u4").tobytes()))]


def test_ids_equal_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoding, rnd = packing.byte_bpe(packing.default_vocabulary(), packing.added_tokens()), random.Random(4)
    mixed = ["".join(rnd.choice(["<|endoftext|>", "<|", "|>", "a", " b", "\n", "é", "endoftext", "1"]) for _ in range(rnd.randint(0, 12))) for _ in range(10_000)]
    for text in ["", "a  b\n\n c", "l'été 漢字 \U0001f600", "<|endoftext|>x", *[x for _, x in rows() if x], *mixed]:
        assert t.encode(text, add_special_tokens=False).ids == packing.token_ids(encoding, text).tolist()


def test_two_replace_one():
    sequence, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sequence[0] == sequence[2] == sequence[3] != sequence[1]


def test_shards(docs, empty, tmp_path):
    folder = f"file://{tmp_path}/shards"
    index = token_shards.write_shards(docs, folder, length=32, shard_mb=1).collect()
    assert sorted(r.slot for r in index) == list(range(len(index)))
    encoding, texts = packing.byte_bpe(packing.default_vocabulary()), dict(rows())
    by_doc = {}
    for r in index:
        (doc, piece, ids), = token_shards.read_from(folder, r.shard, r.byte_offset, 1, 32)
        assert (doc, piece, len(ids)) == (r.doc_id or 0, r.piece, r.n_ids) and zlib.crc32(ids.astype("<u2").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, {})[piece] = ids.tolist()
    for d, pieces in by_doc.items():
        assert sum((pieces[k] for k in sorted(pieces)), []) == [*encoding.encode_ordinary(texts[d] or ""), 50256]
    again = token_shards.write_shards(docs.repartition(5), f"file://{tmp_path}/again", length=32, shard_mb=1).collect()
    key = lambda x: sorted(map(str, x))
    assert key(index) == key(again)
    assert token_shards.write_shards(empty, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000, 4097])
def test_feistel_is_a_permutation(n):
    got = token_shards.feistel(np.arange(n, dtype=np.uint64), n, 5)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 100 or (got != token_shards.feistel(np.arange(n, dtype=np.uint64), n, 6)).any()


def test_sentencepiece(docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_match.default_model())
    v, rnd = sentencepiece_match.vocabulary(sentencepiece_match.default_model()), random.Random(1)
    texts = ["", " ", "  a  b ", "<s> <0x0A> ▁▁x", "x" * 700, "ab" * 300 + " q", "漢字\tﬁ　\U0001f600\n"] + ["".join(rnd.choice("theantio rsd  é\n漢.,") for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    for text, ids in zip(texts, sentencepiece_match.encode(texts, v), strict=True):
        assert ids.tolist() == model.encode(text)
        assert "▁" in text or sentencepiece_match.decode(ids, v) == text
    got = sentencepiece_match.round_trips(docs).collect()
    assert len(got) == len(rows()) and all(r.round_trip for r in got)
    back = {r.doc_id: r.text for r in sentencepiece_match.decoded(sentencepiece_match.encoded(docs)).collect()}
    assert back[1] == CLEAN and back[2] == back[3] == ""
    assert sentencepiece_match.round_trips(empty).count() == 0


def test_classifier(spark, empty):
    rnd = random.Random(2)
    make = lambda bad: " ".join(f"w{rnd.randint(0, 999)}" + ("###" if bad and rnd.random() < 0.8 else "") for _ in range(rnd.randint(5, 60)))
    data = [(k, make(k % 3 == 0), int(k % 3 != 0)) for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in data] + [(1000, None), (1001, ""), (None, "w")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in data] + [(5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_gam.classify(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {k: y for k, _, y in data}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert quality_gam.classify(docs, labels.limit(0)).count() == 403 and quality_gam.classify(empty, labels).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(7))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n))
    passage, one = text(5), text(12)
    data = [(0, one), (1, one.replace(".", "!", 1)), (2, f"{text(6)}\n{passage}\n{text(6)}"), (3, f"{text(6)}\n{passage}\n{text(6)}"), (4, text(8) + "\nmail a.b@c.org now."), (5, "$$$ " * 200), (6, None)]
    docs = spark.createDataFrame([(d, t, "en", f"s{d}", len(t or "")) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages, now = dict(corpus_pipeline.STAGES), docs
    for name in list(stages)[:-1]:
        now = stages[name](spark, now, str(tmp_path))
        assert now.columns == docs.columns
    left = {r.doc_id: r.text for r in now.collect()}
    assert set(left) == {0, 2, 3, 4} and "[EMAIL]" in left[4] and left[0] == one
    assert passage.split("\n")[2] in left[2] and passage.split("\n")[2] not in left[3]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {0, 2, 3, 4}
