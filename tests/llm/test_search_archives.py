"""Operators 11 to 13 against plain versions."""

import base64
import hashlib
import math
import re
import tempfile
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlake.llm import divergence, terms, treap_search, warc

WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ONLY_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBzZ09 é\n\x00.-ßYq", max_size=40), max_size=6))
def test_terms_are_those_of_the_pattern(texts):
    for pattern, inside in ((WORDS, terms.LETTERS_DIGITS), (ONLY_LETTERS, terms.LETTERS)):
        t = terms.terms([x.encode() for x in texts], inside)
        want = [(k, w) for k, x in enumerate(texts) for w in re.findall(pattern, lowered(x))]
        assert list(zip(t.text.tolist(), t.strings(np.arange(len(t.hash))).to_pylist(), strict=True)) == want
        assert len(set(t.hash.tolist())) == len({w for _, w in want})
        first, term, text, n = terms.counted(t, t.text)
        names = t.strings(first).to_pylist()
        assert {(k, names[w]): c for w, k, c in zip(term.tolist(), text.tolist(), n.tolist(), strict=True)} == Counter(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=40), max_size=5))
def test_treaps_are_search_trees_and_heaps(segments):
    impact = np.array([x for s in segments for x in s], np.int64)
    begin = np.cumsum([0, *map(len, segments)])[:-1].astype(np.int64)
    left, right = treap_search.treaps(impact, begin)

    def order(k):
        for child in (left[k], right[k]):
            assert child < 0 or impact[child] <= impact[k]
        return [*(order(left[k]) if left[k] >= 0 else []), k, *(order(right[k]) if right[k] >= 0 else [])]

    roots = sorted(set(range(len(impact))) - set(left.tolist()) - set(right.tolist()))
    assert len(roots) == len(segments)
    assert [x for r in roots for x in order(r)] == list(range(len(impact)))


def test_equal_impacts_make_no_chains():
    left, right = treap_search.treaps(np.ones(4096, np.int64), np.array([0]))
    root, depth, level = (set(range(4096)) - set(left.tolist()) - set(right.tolist())).pop(), 0, []
    level = [root]
    while level:
        level, depth = [c for k in level for c in (left[k], right[k]) if c >= 0], depth + 1
    assert depth < 60


def best(docs, items, k=10):
    """All scores by the definition. docs: (doc_id, text), items: (item_id, text)."""
    found = [(d, Counter(re.findall(WORDS, lowered(t)))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n, total, df = len(found), sum(sum(c.values()) for _, c in found), Counter(w for _, c in found for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(re.findall(WORDS, lowered(t)))
    out = []
    for i, ws in asked.items():
        rows = []
        for d, c in found:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in ws if w in c)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return out


def made_docs(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)] + ["É", "ab9"]
    docs = [(int(d), " ".join(rng.choice(words, rng.integers(0, 40), p=None))) for d in rng.permutation(n) * 3]
    return docs + [docs[0]] * 5 + [(10_000 + k, docs[1][1]) for k in range(20)] + [(None, docs[2][1]), (None, None), (7, None), (8, ""), (9, "..."), (10, "long " * 20_000 + "w1")]


def test_ranks_equal_all_scores(spark):
    docs = made_docs(150, 3)
    items = [(1, "w1 w2 W3 w3 nothing"), (2, docs[4][1]), (3, None), (4, "..."), (None, "w5 É"), (1, "w9"), (5, "long"), (6, docs[1][1]), (6, docs[1][1])]
    items += [(100 + k, " ".join(f"w{(k * j) % 60}" for j in range(1, 2 + k % 9))) for k in range(40)]
    table = spark.createDataFrame([(d, t, "x", 1, None, "t") for d, t in docs], "doc_id long, text string, shard string, block int, term string, rank string").repartition(5)
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, doc_id int, score int")
    index, n = treap_search.build_index(table, shard_bytes=2000)
    for k, block_items in ((10, 256), (3, 4)):
        got = [tuple(r) for r in treap_search.search(index, n, asked, k, block_items=block_items, depth=1).collect()]
        assert Counter(got) == Counter(best(docs, items, k))


def test_ranks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert treap_search.ranked(docs, items).collect() == []
    assert treap_search.ranked(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []


def test_few_documents_are_scored():
    rng = np.random.default_rng(5)
    raws = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 60) % 3000).encode() for _ in range(4000)]
    names, begin, rows = treap_search.shard_postings(raws, 4000, 240_000)
    names, ends = {x: k for k, x in enumerate(names.to_pylist())}, np.append(begin[1:], len(rows))
    asked = raws[17].decode().split()[:8]
    shard = treap_search.Shard([rows[begin[names[w]] : ends[names[w]]] for w in sorted(set(asked))])
    weight = np.array([[int(1000 * math.log(8002 / (2 * (ends[names[w]] - begin[names[w]]) + 1))) for w in sorted(set(asked))]])
    shard.searched(shard.root[None, :], weight, 10, np.zeros(1, np.int64))
    assert shard.states < 1200


def audited(docs, least):
    """docs: (lang, source, text)."""
    docs = [(a or "", b or "", re.findall(ONLY_LETTERS, lowered(t))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted(w for w in df if df[w] >= least)
        v = len(kept)
        counts = {s: Counter(w for _, x, ws in own if x == s for w in ws) for s in {d[1] for d in own}}
        whole = sum(counts.values(), Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * v) for w in kept} for s, c in [*counts.items(), (None, whole)]}
        for s in counts:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode(), o) for o in counts if o != s]
            top = [(p[None][w] - p[s][w], w.encode(), w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            out += [(lang, s, part, i, -x, r + 1) for part, rows in (("pair", sorted(pairs)), ("term", sorted(top)[:50])) for r, (x, _, i) in enumerate(rows)]
    return out


def test_audit_equals_the_definition(spark):
    rng = np.random.default_rng(8)
    words = ["alpha", "Beta", "é", "a1b", "zz", *(f"x{chr(97 + k)}y" for k in range(26))]
    docs = [(["en", "de", None][int(rng.integers(3))], f"s{int(rng.integers(9))}", " ".join(rng.choice(words, rng.integers(0, 12)))) for _ in range(240)]
    docs += [("en", None, "alpha alpha"), ("en", "none", None), ("fr", "only", "rare"), ("it", "p", None), ("it", "q", ""), ("en", "s1", "beta " * 5000), *[("en", "hot", "alpha zz")] * 80]
    table = spark.createDataFrame([(k, *d, 1, 2, "t", 0) for k, d in enumerate(docs)], "doc_id long, lang string, source string, text string, chunk int, n int, term string, value int").repartition(4)
    want = Counter(audited(docs, 6))
    for s in ({}, {"block": 2, "entries": 7, "span": 1, "slice_terms": 3}, {"block": 3, "entries": 40, "span": 2}):
        assert Counter(tuple(r) for r in divergence.audit(table, least_docs=6, **s).collect()) == want
    assert divergence.audit(table.limit(0)).collect() == []


def test_shares_of_very_large_counts_are_exact():
    n = np.array([[0, 10**13 + 7, 3], [5, 9 * 10**9, 1]], np.int64)
    total = n.sum(1)
    assert divergence.shares(n, total, 3).tolist() == [[1 + 10**9 * (int(x) + 5) // (int(t) + 15) for x in row] for row, t in zip(n, total, strict=True)]


def page_rows():
    long = "é" * 400_000
    rows = [(1, "http://a.example.com/x", "<p>one</p>"), (2, "http://b.example.com/", "<p>one</p>"), (9, "http://A.Example.com:8080/y?q=1#f", "<p>one</p>"), (4, None, None), (5, "", ""), (6, "no url at all", "two"), (7, "http://u@c.example.org", "two")]
    rows += [(8, "http://d.example.com/a b\r\nWARC-Type: evil", "three\r\n\r\nfour"), (None, "http://e.example.com/", "<p>one</p>"), (None, "http://e.example.com/z", "alone"), (20, "http://f.example.com/" + "x" * 3000, long), (21, "http://f.example.com/" + "x" * 3000 + "y", long)]
    rows += [(9, "http://A.Example.com:8080/y?q=1#f", "<p>one</p>"), (9, "http://a.example.com/other", "<p>one</p>")]
    return rows + [(100 + k, "http://hot.example.com/same", f"page {k % 30}") for k in range(300)]


def archived(rows, least=0):
    top = defaultdict(lambda: None)
    for page, _, html in rows:
        if page is not None and (top[html or ""] is None or page > top[html or ""]):
            top[html or ""] = page
    out = []
    for page, _, html in rows:
        raw, t = (html or "").encode(), top[html or ""]
        first = page == t or len(raw) < least
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else t))
    return out


@pytest.mark.parametrize("least", [0, 6])
def test_archives_come_back(spark, least):
    rows = page_rows()
    table = spark.createDataFrame([(*r, "c", 1, "k") for r in rows], "page_id long, url string, html string, key string, size int, digest string").repartition(5)
    got = warc.archived(table, least_bytes=least, block_lines=7, file_mb=0)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(archived(rows, least))
    assert warc.archived(table.limit(0)).collect() == []


def test_lookups_read_few_blocks(spark):
    rows = page_rows()
    folder = "file://" + tempfile.mkdtemp(prefix="spark-warc-")
    files = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder, block_lines=16)
    lines = [tuple(r) for r in warc.captures(files, folder).select("key", "page_id").collect()]
    assert len(lines) == len(rows)
    for f in files.collect():
        fs, root = warc.opened(folder)
        with fs.open_input_file(f"{root}/{f['file']}") as source:
            own = [tuple(x[:2]) for e in warc.directory_of(fs, f"{root}/{f['file']}") for x in warc.lines_of(source, e)]
        assert [k for k, _ in own] == sorted(k for k, _ in own) and (own[0][0], own[-1][0], len(own)) == (f["first"], f["last"], f["n_lines"])
    asked = spark.createDataFrame([("http://hot.example.com/same",), ("http://HOT.example.com/same",), ("http://b.example.com/",), (None,), ("http://not.there/",), ("http://a.example.com:8080/y?q=1",)], "url string")
    found = warc.lookup(files, folder, asked)
    assert Counter(r["page_id"] for r in found.collect()) == Counter([*range(100, 400), 2, 4, 5, 9, 9])
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.records(found, folder).where("kind = 'response'").collect()}
    assert payloads[399] == "page 29" and payloads[9] == "<p>one</p>"
    # Members of the files are gzip members of their own, and whole files are readable by any WARC reader.
    import gzip

    name = warc.captures(files, folder).select("file").first()[0]
    fs, root = warc.opened(folder)
    assert gzip.decompress(fs.open_input_file(f"{root}/{name}").read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_a_shard_is_counted_in_parts_and_takes_little_memory():
    rng = np.random.default_rng(41)
    words = [f"w{k}" if k % 3 else f"averylongterm{k}é" for k in range(30000)]
    raws = [" ".join(words[k] for k in np.minimum(rng.zipf(1.3, rng.integers(0, 600)), 29999)).encode() for _ in range(2500)]
    raws[7], raws[8] = b"", b"- -"
    once, parts = (treap_search.counted_parts(raws, n) for n in (1 << 30, 1000))
    assert once[0].equals(parts[0]) and all((x == y).all() for x, y in zip(once[1:], parts[1:], strict=True))
    assert treap_search.shard_postings([b"", b"..", b""], 3, 1)[0].to_pylist() == []

    def peak(count):
        tracemalloc.start()
        count()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    whole = peak(lambda: terms.counted(t := terms.terms(raws, terms.LETTERS_DIGITS), t.text))
    assert peak(lambda: treap_search.shard_postings(raws, 2500, 10**6, 1 << 17)) < 0.8 * whole
