"""Suffix-array dedup, Jaccard join, compact windows and embedding dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from rasterlake.llm import compact_windows, embedding_dedup, jaccard_join, suffix, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1):
    """Null, empty, short, repeated, periodic and long texts, copies, near copies, and a passage that many share; extra columns clash with internal names."""
    rnd = random.Random(seed)
    w = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    shared, base = w(60), w(200).split()
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A B"), (4, "  \n "), (5, "x" * 3000), (6, "ab" * 400), (7, "ba" * 300), (8, "é漢字 " * 60), (9, w(4000))]
    for k in range(10, 40):
        near = list(base)
        for _ in range(rnd.randint(0, 9)):
            near[rnd.randrange(200)] = f"z{rnd.randint(0, 10**6)}"
        rows.append((k, " ".join(near)))
    rows += [(k, f"{w(40)} {shared} {w(30)}") for k in range(40, 70)]
    rows += [(k, rows[45][1]) for k in range(70, 90)]
    rows += [(45, dict(rows)[45])]  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "k", 1, "r") for d, t in [*corpus(), (None, "no id " * 40)]], "doc_id long, text string, key string, n int, rows string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(150):
        t = np.append(rng.integers(1, rng.integers(2, 7), rng.integers(1, 60)), 0)
        assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    t = np.append(rng.integers(1, 9000, 500), 0)
    assert suffix.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def test_suffix_dedup(docs, empty):
    rows = sorted(set((d, t or "") for d, t in corpus()))
    seen, want = {}, {}
    for d, t in rows:
        raw = t.encode()
        late = np.zeros(len(raw) + 100, int)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                late[i : i + 100] = 1
            seen.setdefault(raw[i : i + 100], (d, i))
        late = late[: len(raw)]
        want[d] = (len(raw), int(late.sum()), int((np.diff(late, prepend=0) == 1).sum()), hashlib.sha256(bytes(b for b, x in zip(raw, late, strict=True) if not x)).hexdigest())
    got = suffix_dedup.dedup(docs).collect()
    assert len(got) == len(corpus()) + 1
    assert {r.doc_id: tuple(r)[1:5] for r in got if r.doc_id is not None} == want
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert suffix_dedup.dedup(empty).count() == 0


def sets(text, size):
    w = WORD.findall(lower(text))
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


@pytest.mark.parametrize(("size", "percent", "small"), [(4, 85, 16), (5, 80, 16), (4, 85, 2)])
def test_jaccard_join(docs, empty, size, percent, small):
    every = {d: sets(t, size) for d, t in corpus()}
    head = {d: d for d in every}

    def root(d):
        while head[d] != d:
            d = head[d]
        return d

    for a in every:
        for b in every:
            both = len(every[a] & every[b])
            if a < b and both and 100 * both >= percent * (len(every[a]) + len(every[b]) - both):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    got = jaccard_join.join(docs, size, percent, small=small, block=8).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {d: (len(s), root(d)) for d, s in every.items()}
    assert len(got) == len(corpus()) + 1
    assert jaccard_join.join(empty).count() == 0


def test_representatives_keep_all_columns(docs):
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 1, 2, 5, 10, None} <= set(ids) and not set(range(70, 90)) & set(ids)


def test_compact_windows_match_their_definition():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 40, 200).astype(np.uint64)
    got = {tuple(x) for x in compact_windows.compact_windows(tokens, np.zeros(204, np.int64), np.ones(200, bool), 12, 0).tolist()}
    v = ((compact_windows.mixed(tokens) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.int64)
    want = set()
    for p in range(200):
        left, right = p, p
        while left > 0 and v[left - 1] > v[p]:
            left -= 1
        while right < 199 and v[right + 1] >= v[p]:
            right += 1
        if right - left + 1 >= 12:
            want.add((p, left, right))
    assert got == want


def test_passages_that_repeat_are_found_and_clean_documents_are_not(docs, empty):
    got = compact_windows.near_passages(docs).collect()
    found = collections.defaultdict(set)
    for r in got:
        found[r.doc_id].add(r.source_doc_id)
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.8
    assert set(range(41, 90)) <= set(found) and 40 not in found and 9 not in found and 10 not in found
    assert all(found[k] <= set(range(40, 70)) for k in range(41, 70))
    one = next(r for r in got if r.doc_id == 41)
    text = WORD.findall(dict(corpus())[41])[one.start_word : one.end_word]
    assert len(text) >= 50
    assert compact_windows.near_passages(empty).count() == 0


def test_passages_are_cut(docs):
    kept = {r.doc_id: r.text for r in compact_windows.without_passages(docs).collect()}
    texts = dict(corpus())
    assert kept[40] == texts[40] and kept[0] is None and kept[9] == texts[9] and not set(range(70, 90)) & set(kept)
    assert all(len(WORD.findall(kept[k])) == 70 for k in range(41, 70))


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k] + rng.normal(size=16) * 0.15).tolist(), k % 2) for k in range(30)]
    rows += [(200 + k, base[0].tolist(), 0) for k in range(25)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] + [1.0] * 15, 0), (304, base[1].tolist(), None), (305, [], 0), (306, [1.0], 0), (307, [2.0], 0), (308, [-3.0], 0), (0, base[0].tolist(), 0)]
    frame = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<double>, label int, cell string")
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and any(v) and lab is not None}
    links = {i: {j for j in good if j != i and good[i][1] == good[j][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.93} for i in good}

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        return min(seen)

    got = embedding_dedup.near_duplicates(frame, cell_rows=4, block_rows=6).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (len(links.get(r.vec_id, ())), least(r.vec_id), least(r.vec_id) == r.vec_id), r
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_cells_divide_clustered_vectors_and_two_are_made_of_others():
    rng = np.random.default_rng(8)
    centres = np.linalg.qr(rng.normal(size=(32, 32)))[0][:8]
    x = np.repeat(centres, 50, 0) + rng.normal(size=(400, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = float(np.sqrt(0.14))
    c = embedding_dedup.best_cells(x[rng.permutation(400)], 400, 16, reach)
    assert len(c) >= 8 and embedding_dedup.copied(x, c, reach)[1].sum() < 1.5 * len(x)
    spread = rng.normal(size=(200, 32))
    assert len(embedding_dedup.best_cells(spread / np.linalg.norm(spread, axis=1, keepdims=True), 200, 64, reach)) == 2
