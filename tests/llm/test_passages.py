"""Passages that a first occurrence, a local stretch or the earliest document alone would miss."""

from __future__ import annotations

import numpy as np
import pytest

from rasterlake.llm import compact_windows, jaccard_join
from rasterlake.llm.common import among
from rasterlake.llm.compact_windows import least_run, matches, near_passages, open_classes, passages, run_places, runs_along, starts_of


def drawn(seed=1):
    rng = np.random.default_rng(seed)
    return lambda n: rng.integers(1, 1 << 60, n).astype(np.uint64)


@pytest.mark.parametrize("size", [46, 60, 81])
def test_verbatim_passage_with_a_phrase_repeated_before_it(size):
    t = drawn()
    copied = t(size)
    for back in range(12, 70):
        near = t(120)
        near[120 - back] = copied[size // 2]
        assert passages(np.concatenate([t(50), copied, t(50)]), np.concatenate([near, copied, t(60)]), 46, 0.8) == [(50, 50 + size, 120, 120 + size, size, 1.0)]
    quoted = t(10)
    assert passages(np.concatenate([quoted, copied]), np.concatenate([quoted, copied[:8], t(30), copied]), 46, 0.8)[0][:4] == (10, 10 + size, 48, 48 + size)


def test_edits_close_together_do_not_part_a_passage_that_is_near_enough():
    t = drawn(2)
    source = t(96)
    edited = source.copy()
    edited[43:53] = t(10)
    assert passages(np.concatenate([t(50), edited, t(50)]), np.concatenate([t(70), source, t(60)]), 46, 0.8) == [(50, 146, 70, 166, 86, 86 / 106)]
    edited[40:56] = t(16)
    assert passages(edited, source, 46, 0.8) == []


def test_passages_in_another_order_and_other_words_around_them():
    t = drawn(3)
    p, q = t(80), t(60)
    got = passages(np.concatenate([p, t(30), q, t(20), q[-1:]]), np.concatenate([q, t(20), q[-1:], t(20), p]), 46, 0.8)
    assert sorted(x[:2] for x in got) == [(0, 80), (110, 170)]
    assert passages(t(300), t(300), 46, 0.8) == []


def test_runs_of_equal_tokens():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, 90).astype(np.uint64), rng.integers(0, 6, 70).astype(np.uint64)
    want = [(i, j, n) for i in range(90) for j in range(70) if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]) for n in [next(k for k in range(91) if i + k == 90 or j + k == 70 or a[i + k] != b[j + k])]]
    assert [tuple(x) for x in matches(a, b).tolist()] == sorted(want)
    # With a bound, runs are some of all maximal runs, the longest one of each place among them.
    some = {tuple(x) for x in matches(a, b, 2).tolist()}
    assert some <= set(want)
    for i in range(90):
        through = [r for r in want if r[0] <= i < r[0] + r[2]]
        assert not through or any(r[0] <= i < r[0] + r[2] for r in some)


@pytest.mark.parametrize("size", [46, 50, 80])
@pytest.mark.parametrize("phrase", [10, 20, 30])
def test_verbatim_passage_with_a_phrase_that_its_source_has_again_and_again(size, phrase):
    t = drawn(9)
    for at in (0, 3, (size - phrase) // 2, size - phrase):
        copied = t(size)
        quoted = copied[at : at + phrase]
        for times in (1, 3, 4, 20):
            before = np.concatenate([np.concatenate([quoted, t(12)]) for _ in range(times)])
            for source in (np.concatenate([before, copied, t(60)]), np.concatenate([t(9), copied, t(5), before])):
                start = int(np.flatnonzero(source == copied[0 if at else phrase])[0]) - (0 if at else phrase)
                assert passages(np.concatenate([t(50), copied, t(50)]), source, 46, 0.8) == [(50, 50 + size, start, start + size, size, 1.0)]


def test_edits_at_both_ends_of_a_phrase_that_stands_again_and_again():
    t = drawn(10)
    source = t(80)
    near = source.copy()
    near[30], near[50] = t(2)
    before = np.concatenate([np.concatenate([source[31:50], t(12)]) for _ in range(6)])
    assert passages(np.concatenate([t(40), near]), np.concatenate([before, source]), 46, 0.8) == [(40, 120, len(before), len(before) + 80, 78, 78 / 82)]
    near = np.concatenate([source[:30], t(3), source[30:50], t(2), source[50:]])
    before = np.concatenate([np.concatenate([source[30:50], t(12)]) for _ in range(6)])
    got = passages(near, np.concatenate([before, source]), 46, 0.8)
    assert got == [(0, 85, len(before), len(before) + 80, 80, 80 / 85)]


def test_a_passage_that_its_source_has_many_times():
    t = drawn(11)
    p = t(60)
    assert passages(np.concatenate([t(30), p, t(30)]), np.concatenate([np.concatenate([p, t(10)]) for _ in range(30)]), 46, 0.8)[0][:2] == (30, 90)
    many = np.tile(t(7), 300)
    assert passages(many, many[: 900], 46, 0.8)


@pytest.mark.parametrize("times", [2, 3, 5, 12])
def test_a_near_passage_whose_runs_stand_more_often_where_they_have_more_support(times):
    """The source has most of the passage some times before another passage, each time without the rest of it: none of these is near enough, the near one comes last."""
    for seed in range(20, 26):
        t = drawn(seed)
        p, q = t(60), t(60)
        near = p.copy()
        near[30] = t(1)[0]
        before = np.concatenate([np.concatenate([p[:38], t(22), q, t(30)]) for _ in range(times)])
        got = passages(np.concatenate([t(50), p, q, t(50)]), np.concatenate([before, near, t(40)]), 46, 0.8)
        assert sorted(x[:5] for x in got)[0] == (50, 110, len(before), len(before) + 60, 59) and len(got) == 2


def test_runs_along_a_shift_are_all_maximal_runs_of_it():
    rng = np.random.default_rng(24)
    a, b = rng.integers(0, 4, 50).astype(np.uint64), rng.integers(0, 4, 70).astype(np.uint64)
    every = matches(a, b)
    for least in (-90, -40, -3, 0, 30, 60):
        shift = every[:, 0] - every[:, 1]
        assert runs_along(a, b, least, least + 20).tolist() == every[(shift >= least) & (shift < least + 20)].tolist()


def test_recall_of_copies_that_hold_phrases_of_their_source(spark):
    """Whole copies of 50 words hold a phrase of 14, 24 or 34 words that stands some times before them in the source."""
    rng = np.random.default_rng(13)
    w = lambda n: [f"p{k}" for k in rng.integers(0, 10**7, n)]
    rows = []
    for k in range(120):
        copied, phrase = w(50 + 30 * (k % 2)), (14, 24, 34)[k % 3]
        at = int(rng.integers(0, len(copied) - phrase))
        before = [x for _ in range((1, 3, 4, 9)[k % 4]) for x in [*copied[at : at + phrase], *w(9)]]
        rows += [(k, w(20) + before + copied + w(30)), (1000 + k, w(40) + copied + w(30))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    want = {(1000 + k, 40, 90 + 30 * (k % 2)) for k in range(120)}
    for parts in (1, 7):
        got = near_passages(docs.repartition(parts)).collect()
        found = {(r.doc_id, r.start_word, r.end_word) for r in got}
        assert len(want & found) >= 119, len(want & found)
        assert all(r.source_doc_id % 1000 == r.doc_id % 1000 for r in got)


def test_a_copy_is_found_behind_an_earlier_document_that_is_too_unlike(spark):
    rng = np.random.default_rng(5)

    def w(n):
        return [f"w{k}" for k in rng.integers(0, 10**7, n)]

    rows = []
    for k in range(40):
        source = w(50)
        version = list(source)
        for x in (12, 33):  # ten shingles of 46, two functions agree as a rule: Jaccard 0.64
            version[x] = f"z{k}{x}"
        near = list(source)
        near[48] = "near"
        rows += [(k, w(60) + version + w(60)), (1000 + k, w(60) + source + w(60)), (2000 + k, w(60) + near + w(60)), (3000 + k, w(60) + source + w(60))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    one_task = {(r.doc_id, r.source_doc_id) for r in near_passages(docs.coalesce(1)).collect()}
    many = {(r.doc_id, r.source_doc_id) for r in near_passages(docs.repartition(7)).collect()}
    tiny = {(r.doc_id, r.source_doc_id) for r in near_passages(docs.repartition(7), task_bytes=1).collect()}
    for got in (one_task, many, tiny):
        assert {a for a, b in got} >= {3000 + k for k in range(40)}
        assert len({a for a, b in got} & {2000 + k for k in range(40)}) >= 38
        assert all(b < a and a % 1000 == b % 1000 and b >= 1000 for a, b in got)
    hot = w(70)
    docs = spark.createDataFrame([(k, " ".join(w(40) + hot + w(40))) for k in range(300)], "doc_id long, text string")
    got = [(r.doc_id, r.source_doc_id) for r in near_passages(docs.repartition(5)).collect()]
    assert {a for a, b in got} == set(range(1, 300)) and len(got) < 3000


def test_ids_are_left_out_by_flags_and_joined_exactly(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, "x") for k in range(400)], "doc_id long, other string")
    ids = rows.where("doc_id % 3 = 0").select("doc_id")
    assert sorted(r.doc_id for r in among(rows, "doc_id", ids).collect()) == [k for k in range(400) if k % 7 and k % 3 == 0]
    rest = among(rows, "doc_id", ids, "left_anti").collect()
    assert len(rest) == sum(1 for k in range(400) if k % 7 == 0 or k % 3) and {r.doc_id for r in rest} == {None} | {k for k in range(400) if k % 7 and k % 3}
    assert among(rows, "doc_id", ids.limit(0)).count() == 0 and among(rows, "doc_id", ids.limit(0), "left_anti").count() == 400


def test_voronoi_regions_divide_again_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sets, label = {}, {}
    for centre in range(8):  # a tree of centres: branches share less and less
        trunk = rng.integers(1, 1 << 60, 60)
        for branch in range(4):
            bough = rng.integers(1, 1 << 60, 40)
            for leaf in range(12):
                base = np.concatenate([trunk, bough, rng.integers(1, 1 << 60, 25)])
                for copy in range(2):
                    d = len(sets)
                    sets[d] = np.unique(np.concatenate([base[: len(base) - 5 * copy], rng.integers(1, 1 << 60, 5 * copy)]).astype(np.uint64))
                    label[d] = d
    levels = []
    original = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, name: (levels.append(name), original(df, name))[1])
    members = spark.createDataFrame([(1, d, label[d], len(s)) for d, s in sets.items()], "cluster long, doc long, label long, n int")
    space = spark.createDataFrame([(d, bytearray(s.tobytes())) for d, s in sets.items()], "doc long, raw binary")
    got = {tuple(sorted(r)) for r in jaccard_join.voronoi(members, space, 85, 16, 1 << 20).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * (k := len(np.intersect1d(sets[a], sets[b]))) >= 85 * (len(sets[a]) + len(sets[b]) - k)}
    assert want == got and len(want) >= 300
    assert levels.count("region-parts") >= 3


def test_shared_counts_are_those_of_the_sets():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90))).astype(np.uint64) for _ in range(70)]
    one, two = np.arange(0, 50), np.arange(20, 70)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in two] for i in one]
    assert jaccard_join.shared_counts(sets, one, two, rare=5, slab=16).tolist() == want


def test_recall_of_near_passages_behind_decoys(spark):
    """Each passage has an earlier document with 40 of its words and one with a version of similarity under 0.8; the source comes after them."""
    rng = np.random.default_rng(12)

    def w(n):
        return [f"v{k}" for k in rng.integers(0, 10**7, n)]

    rows, wanted = [], []
    for k in range(300):
        source = w(int(rng.integers(52, 70)))
        decoy = source[(cut := int(rng.integers(0, len(source) - 40))) : cut + 40]
        version = list(source)
        for x in (14, 34):
            version[x] = f"y{k}{x}"
        near = list(source)
        near[int(rng.integers(0, len(near)))] = f"near{k}"
        grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (source, near)]
        assert len(grams[0] & grams[1]) / len(grams[0] | grams[1]) >= 0.8
        rows += [(k, w(50) + decoy + w(50)), (1000 + k, w(60) + version + w(40)), (2000 + k, w(60) + source + w(60)), (3000 + k, w(60) + near + w(60))]
        wanted.append(3000 + k)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = near_passages(docs.repartition(5)).collect()
    assert len(set(wanted) & {r.doc_id for r in got if r.source_doc_id == r.doc_id - 1000}) >= 297
    assert all(r.source_doc_id % 1000 == r.doc_id % 1000 for r in got)


def test_no_pair_is_left_out_because_others_share_its_run(spark):
    """A source stands between documents that share a run of it but no passage: neither the earliest nor the nearest with that run is near enough."""
    rng = np.random.default_rng(21)

    def w(n):
        return [f"u{k}" for k in rng.integers(0, 10**7, n)]

    rows, size = [], 56
    for k in range(30):
        source = w(size)
        near = list(source)
        near[27] = f"near{k}"
        at = 10_000 * k
        half = [source[:27], source[28:]]  # each holds a run of the passage up to its edit, and nothing else of it
        rows += [(at + n, w(30) + half[n % 2] + w(30)) for n in range(60)]
        rows.append((at + 500, w(30) + source + w(30)))
        rows += [(at + 900 + n, w(30) + half[n % 2] + w(30)) for n in range(60)]
        rows.append((at + 5000, w(30) + near + w(30)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.source_doc_id) for r in near_passages(docs.repartition(4)).collect()}
    assert got == {(10_000 * k + 5000, 10_000 * k + 500) for k in range(30)}


def test_a_document_with_a_verbatim_source_is_linked_to_one_that_is_near(spark):
    """The later document has its first 50 words from one document and is near another on more of them."""
    rng = np.random.default_rng(22)

    def w(n):
        return [f"q{k}" for k in rng.integers(0, 10**7, n)]

    rows = []
    for k in range(40):
        text = w(90)
        edited = list(text)
        edited[20], edited[34] = f"e{k}", f"f{k}"
        rows += [(k, w(40) + text[:50] + w(40)), (1000 + k, w(40) + edited + w(40)), (2000 + k, w(40) + text + w(40))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.source_doc_id) for r in near_passages(docs.repartition(3)).collect()}
    assert got >= {(2000 + k, s + k) for k in range(40) for s in (0, 1000)}


def test_runs_that_passages_share_have_a_common_stretch():
    assert least_run(46, 0.8) == 21 and least_run(46, 1) == 46
    t = drawn(23)
    for run in (8, 21, 46):
        part, starts = starts_of(run)
        assert all(any(s <= i and i - s + part <= run and i - s < part for s in starts) for i in range(run))
        text = [bytes(" ".join(f"a{x}" for x in t(n)), "ascii") for n in (30, run + 4, 40, 25)]
        one, two = b" ".join([text[0], text[1], text[2]]), b" ".join([text[3], text[1]])
        rows = run_places([1, 2], [1, 2], [[], []], [one, two], run)
        classes = [open_classes(rows, f"p{k}") for k in range(len(starts))]
        assert any({1, 2} == set(c["doc"].tolist()) for c in classes)
        rows["known"], rows["group"] = 1, 1
        assert not any(len(open_classes(rows, f"p{k}")) for k in range(len(starts)))


def test_members_of_a_class_are_joined_by_few_pairs_and_lose_no_component():
    """Versions of one text with edits here and there: the components are those of all pairs, with about one pair a member."""
    rng = np.random.default_rng(41)
    t = drawn(41)
    reach, base, n = 92, drawn(40)(185), 90
    texts = []
    for _ in range(n):
        text = base.copy()
        for at in rng.choice(np.r_[0:78, 108:181], int(rng.integers(2, 9)), False):
            text[at : at + 5] = t(min(5, len(text) - at))
        texts.append(text)
    members = np.zeros(n, compact_windows.MEMBER)
    members["doc"] = members["group"] = np.arange(n)
    members["lo"] = members["hi"] = reach
    every = [(u, v) for u in range(n) for v in range(u) if passages(texts[u], texts[v], 46, 0.8)]

    def components(pairs):
        root = list(range(n))
        for u, v in pairs:
            root = [root[v] if x == root[u] else x for x in root]
        return [root.index(x) for x in root]

    where = np.arange(n)
    got = list(zip(*(x.tolist() for x in compact_windows.linking(members, texts, where, where, 46, 0.8, reach)), strict=True))
    assert set(got) <= set(every) and len(got) < 3 * n < len(every)
    assert components(got) == components(every)
    halves = [compact_windows.linking(members, texts, where[:45], part, 46, 0.8, reach) for part in (where[:45], where[45:])] + [compact_windows.linking(members, texts, where[45:], where[45:], 46, 0.8, reach)]
    assert components([(int(u), int(v)) for x, y in halves for u, v in zip(x, y, strict=True)]) == components(every)
    # The bound lets all pairs through that have a passage over the common place.
    bound = compact_windows.Around(members, texts, 2 * 0.8 / 1.8 * 46 - 1e-9, 0.8, reach)
    over = {(u, v) for u, v in every if any(x[0] <= reach < x[1] for x in passages(texts[u], texts[v], 46, 0.8))}
    may = {(u, v) for u in range(n) for v in where[:u][bound.may(u, where[:u])].tolist()}
    assert over <= may


def test_documents_that_share_a_run_but_no_passage_make_no_pairs(spark, monkeypatch):
    """All documents share 52 words in two parts, too far apart for a passage: no pair of them goes on, whatever their number."""
    rng = np.random.default_rng(42)

    def w(n):
        return [f"c{k}" for k in rng.integers(0, 10**7, n)]

    one, two, counts = w(30), w(26), {}
    original = compact_windows.written
    monkeypatch.setattr(compact_windows, "written", lambda df, name: (out := original(df, name), counts.update({name: out.count()}))[0])
    rows = [(k, " ".join(w(20) + one + w(14) + two + w(20))) for k in range(60)]
    source = w(60)
    rows += [(1000 + k, " ".join(w(20) + source + w(20))) for k in range(20)]
    got = near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == set(range(1001, 1020)) and counts["rest-pairs"] < 80


def test_pairs_that_open_regions_cannot_complete_leave_the_join_early(spark, monkeypatch):
    rng = np.random.default_rng(43)

    def w(n):
        return [f"j{k}" for k in rng.integers(0, 10**7, n)]

    phrase, rows = w(40), []
    for k in range(60):
        rare = w(12)
        rows += [(2 * k, phrase + rare + w(60)), (2 * k + 1, phrase + rare + w(60))]
    base = w(100)
    rows += [(1000 + k, [*base[:k], *w(1), *base[k + 1 :]]) for k in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    seen, pairs = [], []
    flagged, original = jaccard_join.flagged, jaccard_join.written
    monkeypatch.setattr(jaccard_join, "flagged", lambda rows, column, *x: (seen.append(rows.count()) if column == "b" else None, flagged(rows, column, *x))[1])

    def written(df, name):
        out = original(df, name)
        if "need" in out.columns:
            pairs.append(out.where("key IS NULL AND shared + at_pivot < need").count())
        return out

    monkeypatch.setattr(jaccard_join, "written", written)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, most_hot=0).collect()}
    grams = {i: {tuple(t[k : k + 4]) for k in range(len(t) - 3)} for i, t in rows}
    want = {i: i for i in grams}
    for a in grams:
        for b in grams:
            if b < a and 100 * (k := len(grams[a] & grams[b])) >= 85 * (len(grams[a]) + len(grams[b]) - k):
                x, y = want[a], want[b]
                want = {i: min(x, y) if c in (x, y) else c for i, c in want.items()}
    assert got == want and len({c for i, c in want.items() if i >= 1000}) == 1
    assert pairs[0] > 50 and all(k < pairs[0] / 4 for k in seen)


def members_at(n: int, place: int) -> np.ndarray:
    members = np.zeros(n, compact_windows.MEMBER)
    members["key"], members["doc"], members["group"] = 1, np.arange(n), np.arange(n)
    members["lo"] = members["hi"] = place
    return members


@pytest.mark.parametrize("n", [20, 60])
def test_repeats_of_few_tokens_are_linked_in_classes_of_any_size(n):
    """Every third text has the common token 60 times, the others have it once among others: alike as sets, whatever the number of texts."""
    rng, reach, common = np.random.default_rng(51), 92, np.uint64(7)
    texts = [rng.integers(1 << 10, 1 << 60, 2 * reach + 1).astype(np.uint64) for _ in range(n)]
    for k, text in enumerate(texts):
        text[reach : reach + (60 if k % 3 == 2 else 1)] = common
    later, earlier = compact_windows.linking(members_at(n, reach), texts, np.arange(n), np.arange(n), 46, 0.8, reach)
    assert set(later.tolist()) == set(range(2, n, 3)) and all(passages(texts[u], texts[v], 46, 0.8) for u, v in zip(later, earlier, strict=True))


def test_passages_that_reach_further_are_linked_in_one_component():
    """Two sources overlap in a text: both go on, though the first one covers the common place and the second one is in its component."""
    rng, reach, n = np.random.default_rng(52), 92, 3
    texts = [rng.integers(1 << 10, 1 << 60, 2 * reach + 1).astype(np.uint64) for _ in range(n)]
    texts[0][20:120], texts[1][60:180] = texts[2][20:120], texts[2][60:180]
    later, earlier = compact_windows.linking(members_at(n, reach), texts, np.arange(n), np.arange(n), 46, 0.8, reach)
    assert set(zip(later.tolist(), earlier.tolist(), strict=True)) == {(1, 0), (2, 1), (2, 0)}
