"""Operator 12, ranked lexical search: inverted treaps.

The index is a table with a row per shard of documents and term: the term's postings as a treap, a search tree by document and a heap by
impact. Shards are cut from the input's partitions by bytes of text, so a task holds one shard, whatever a term's frequency. Impacts need
two numbers of the whole table, N and L, which a first pass counts. The index has every term of every document and can be searched again.

A search takes the rows of the queries' terms, with weights from the document frequencies of all shards, to one task for each shard and block of
items. There all terms of an item go down their treaps together: a state is a range of documents with the best posting that each term has in
it, and the weighted sum of these maxima bounds every score in the range. Ranges that can't enter the item's top k are left; else the document of the
largest summand is scored and parts the range in two. States of all items are one array. First each shard goes down a bounded number of levels only: the k-th best
score that is found anywhere bounds the whole search from below, so the second search, which gives the result, leaves most ranges early. Each
shard returns k documents of an item at most; the k best of these are the result, so it is exact.

Null texts have no term. Documents and items without a term are never ranked. A null doc_id is ranked after the others of its score. Repeated rows of
documents are documents of their own; rows of one item_id, null included, are one item with the terms of all. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import batched, flagged, written
from rasterlake.llm.terms import LETTERS_DIGITS, counted, edges, terms

POSTING = np.dtype([("doc", "<i4"), ("impact", "<i4"), ("left", "<i4"), ("right", "<i4")])
NOWHERE = np.int64(1) << 40


def treaps(impact: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right children, -1 for none, of the treap over each segment that starts at ``begin``; its root is its largest impact.

    Equal impacts are ordered by a bijection of their places, so that ties don't make chains. All ranges of a depth are parted at once.
    """
    n = len(impact)
    left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    odd, back = 0x9E3779B1, pow(0x9E3779B1, -1, 1 << 32)
    key = (impact.astype(np.uint64) << np.uint64(32)) | ((np.arange(n, dtype=np.uint64) * np.uint64(odd)) & np.uint64(0xFFFFFFFF))
    key = np.append(key, np.uint64(0))

    def tops(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        best = np.maximum.reduceat(key, np.column_stack([lo, hi]).ravel())[::2]
        return ((best * np.uint64(back)) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    lo, hi = begin.astype(np.int64), np.append(begin[1:], n).astype(np.int64)
    at = tops(lo, hi) if n else lo
    while len(at):
        a, b = np.flatnonzero(at > lo), np.flatnonzero(at + 1 < hi)
        new_lo, new_hi = np.concatenate([lo[a], at[b] + 1]), np.concatenate([at[a], hi[b]])
        parents = np.concatenate([at[a], at[b]])
        o = np.argsort(new_lo, kind="stable")
        new_lo, new_hi, parents, is_left = new_lo[o], new_hi[o], parents[o], (np.arange(len(o)) < len(a))[o]
        if not len(o):
            break
        top = tops(new_lo, new_hi)
        left[parents[is_left]] = top[is_left]
        right[parents[~is_left]] = top[~is_left]
        lo, hi, at = new_lo, new_hi, top
    return left, right


def counted_parts(raws: list[bytes], part_bytes: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the texts, in order of their hashes; term, document and number of each pair, by term and document; each text's terms with repeats.

    Some bytes of text at a time, so that arrays with an entry per occurrence stay small; what is kept has one per pair.
    """
    ends = np.cumsum([len(r) for r in raws])
    cuts = [0, *(np.flatnonzero(np.diff(ends // part_bytes)) + 1).tolist(), len(raws)]
    hashes, names, pairs, length = [], [], [], []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        t = terms(raws[x:y], LETTERS_DIGITS)
        first, term, doc, tf = counted(t, t.text)
        hashes.append(t.hash[first])
        names.append(t.strings(first))
        pairs.append((term.astype(np.int32), (doc + x).astype(np.int32), tf.astype(np.int32)))
        length.append(np.bincount(t.text, minlength=y - x))
    known, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    base = np.append(0, np.cumsum([len(h) for h in hashes]))
    term = np.concatenate([which[base[k] + p[0]].astype(np.int32) for k, p in enumerate(pairs)])
    doc, tf = (np.concatenate([p[k] for p in pairs]) for k in (1, 2))
    del pairs
    order = np.argsort(term, kind="stable")  # parts are in the order of the documents
    return pa.concat_arrays(names).take(pa.array(first)), term[order], doc[order], tf[order].astype(np.int64), np.concatenate(length)


def shard_postings(raws: list[bytes], documents: int, occurrences: int, part_bytes: int = 2 << 20) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of the texts of one shard: its terms, where each one's postings begin, and the postings of all, with children counted from that begin."""
    names, term, doc, tf, length = counted_parts(raws, part_bytes)
    m = np.array([10 + 90 * int(n) * documents // max(1, occurrences) for n in length], np.int64)
    begin = np.searchsorted(term, np.arange(len(names)))
    rows = np.empty(len(term), POSTING)
    rows["doc"], rows["impact"] = doc, 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    del doc, tf
    for name, child in zip(("left", "right"), treaps(rows["impact"], begin), strict=True):
        rows[name] = np.where(child >= 0, child - begin[term], -1)
    return names, begin, rows


class Shard:
    """Treaps of some terms of one shard, in one row of arrays; ``searched`` finds the best documents of many items at once."""

    def __init__(self, postings: list[np.ndarray]):
        sizes = np.array([len(p) for p in postings], np.int64)
        base = np.cumsum(sizes) - sizes
        move = np.repeat(base, sizes)
        whole = np.concatenate(postings) if postings else np.empty(0, POSTING)
        self.doc, self.impact = whole["doc"].astype(np.int64), whole["impact"].astype(np.int64)
        self.left, self.right = (np.where(whole[c] >= 0, whole[c] + move, -1).astype(np.int32) for c in ("left", "right"))
        # The root is the one posting of a term that is no child.
        child = np.zeros(len(whole) + 1, bool)
        child[self.left], child[self.right] = True, True
        self.root = np.flatnonzero(~child[: len(whole)]).astype(np.int32)
        self.states = 0

    def searched(self, ptr: np.ndarray, weight: np.ndarray, k: int, least: np.ndarray, depth: int | None = None, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of each item's k best with a score above 0 and not under ``least``; all of them if ``depth`` is None.

        ``ptr``: items by terms, the root of each term's treap or -1; ``weight``: theirs. With ``depth``, no range is parted more often than that.
        """
        items, width = ptr.shape
        threshold, last = np.maximum(least, 1), np.full(items, NOWHERE)  # the k-th best so far: its score and its document
        best = (np.empty(0, np.int64),) * 3
        waiting = [(np.arange(items), ptr, np.full(items, -1, np.int64), np.full(items, NOWHERE), 0)]
        rows_at_once = max(1, most // max(1, width))
        while waiting:
            item, ptr, lo, hi, level = waiting.pop()
            share = np.where(ptr >= 0, self.impact[ptr], 0) * weight[item]
            bound = share.sum(1)
            keep = (bound > threshold[item]) | (bound == threshold[item]) & (lo < last[item])
            item, ptr, lo, hi, share = item[keep], ptr[keep], lo[keep], hi[keep], share[keep]
            if not len(item):
                continue
            self.states += len(item)
            d = self.doc[ptr[np.arange(len(item)), share.argmax(1)]]
            score, a, b = self.parted(ptr, d, lo, hi, weight[item])
            best, threshold, last = self.kept(best, (item, d, score), k, threshold, last)
            if level == depth:
                continue
            item, ptr, lo, hi = np.concatenate([item, item]), np.concatenate([a, b]), np.concatenate([lo, d]), np.concatenate([d, hi])
            live = np.flatnonzero((ptr >= 0).any(1))
            waiting += [(item[r], ptr[r], lo[r], hi[r], level + 1) for r in (live[x : x + rows_at_once] for x in range(0, len(live), rows_at_once))]
        return best

    def parted(self, ptr: np.ndarray, d: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of the documents ``d``, and each term's best posting in (lo, d) and (d, hi): they stand on the way down to ``d``."""
        width = ptr.shape[1]
        a, b = np.full(ptr.size, -1, np.int32), np.full(ptr.size, -1, np.int32)
        score = np.zeros(len(d), np.int64)
        at = np.flatnonzero(ptr.ravel() >= 0)
        now, row = ptr.ravel()[at], at // width
        while len(at):
            doc, to = self.doc[now], d[row]
            less, more = doc < to, doc > to
            x = less & (doc > lo[row])
            x[x] = a[at[x]] < 0
            a[at[x]] = now[x]
            x = more & (doc < hi[row])
            x[x] = b[at[x]] < 0
            b[at[x]] = now[x]
            x = np.flatnonzero(~less & ~more)
            if len(x):
                np.add.at(score, row[x], self.impact[now[x]] * weight.ravel()[at[x]])
                for side, child in ((a, self.left), (b, self.right)):
                    y = x[side[at[x]] < 0]
                    # What lies below may start beyond the range's ends, where nothing is looked for.
                    side[at[y]] = self.inside(child[now[y]], lo[row[y]], hi[row[y]])
            now = np.where(less, self.right[now], self.left[now])
            go = np.flatnonzero((less | more) & (now >= 0))
            at, now, row = at[go], now[go], row[go]
        return score, a.reshape(ptr.shape), b.reshape(ptr.shape)

    def inside(self, now: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The best posting of each subtree within (lo, hi), or -1."""
        now = now.copy()
        at = np.flatnonzero(now >= 0)
        while len(at):
            doc = self.doc[now[at]]
            low, high = doc <= lo[at], doc >= hi[at]
            at, low = at[low | high], low[low | high]
            now[at] = np.where(low, self.right[now[at]], self.left[now[at]])
            at = at[now[at] >= 0]
        return now

    @staticmethod
    def kept(best: tuple, new: tuple, k: int, threshold: np.ndarray, last: np.ndarray) -> tuple:
        item, doc, score = (np.concatenate(x) for x in zip(best, new, strict=True))
        use = score >= threshold[item]
        item, doc, score = item[use], doc[use], score[use]
        o = np.lexsort((doc, -score, item))
        item, doc, score = item[o], doc[o], score[o]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == k - 1
        threshold, last = threshold.copy(), last.copy()
        threshold[item[full]], last[item[full]] = score[full], doc[full]
        return (item[place < k], doc[place < k], score[place < k]), threshold, last


TERM = "shard long, term string, df long, doc binary, impact binary, left binary, right binary"


def build_index(docs: DataFrame, shard_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index and N. A row of the index is a term of a shard: term_id (a hash), df and the treap's four arrays; in the row of the term '' ``doc`` has the doc_ids, a row of nulls' flags in ``left``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = occurrences = 0
        for _, held in batched(batches, 1 << 20):
            n = edges(held, LETTERS_DIGITS)[3]
            documents, occurrences = documents + int((n > 0).sum()), occurrences + int(n.sum())
        yield pa.RecordBatch.from_pydict({"documents": [documents], "occurrences": [occurrences]})

    documents, occurrences = (int(x or 0) for x in texts.mapInArrow(measure, "documents long, occurrences long").agg(F.sum("documents"), F.sum("occurrences")).first())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in batched(batches, shard_bytes):
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            ids, held = [ids[k] for k in order], [held[k] for k in order]
            shard = int.from_bytes(os.urandom(7), "little")  # a task that runs again makes other shards of the same rows
            names, begin, rows = shard_postings(held, documents, occurrences)
            df = np.diff(np.append(begin, len(rows)))
            offsets = pa.py_buffer(np.append(4 * begin, 4 * len(rows)).astype(np.int64))
            arrays = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows[c]))]).cast(pa.binary()) for c in POSTING.names]
            whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(begin), shard)), names, pa.array(df), *arrays], COLUMNS)
            yield from (whole.slice(k, 4096) for k in range(0, len(whole), 4096))
            known = np.array([x or 0 for x in ids], np.int64).tobytes(), np.array([x is None for x in ids]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([""]), pa.array([0]), pa.array([known[0]]), pa.array([b""]), pa.array([known[1]]), pa.array([b""])], COLUMNS)

    COLUMNS = [c.split(" ")[0] for c in TERM.split(", ")]
    return written(texts.mapInArrow(build, TERM).withColumn("term_id", F.xxhash64("term")), "treaps"), documents


def query_terms(items: DataFrame, id_col: str, text_col: str, block_items: int) -> DataFrame:
    """(block, item_id, term) of all items, each term once, written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in batched(batches, 1 << 20):
            t = terms(held, LETTERS_DIGITS)
            first, term, doc, _ = counted(t, t.text)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in doc.tolist()], pa.int64()), t.strings(first).take(pa.array(term))], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = written(rows.mapInArrow(cut, "item_id long, term string").distinct(), "query-terms")
    blocks = -(-max(1, asked.select("item_id").distinct().count()) // block_items)
    return asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))


def _search(doc_ids: np.ndarray, null: np.ndarray, postings: list[np.ndarray], asked: list[list], k: int, least: dict, depth: int | None) -> list[tuple]:
    """(item_id, doc_id, score) of one shard and block; ``asked``: for each of ``postings`` the (item_id, weight) pairs."""
    shard, wanted = Shard(postings), {}
    for root, pairs in zip(shard.root.tolist(), asked, strict=True):
        for item, weight in pairs:
            wanted.setdefault(item, []).append((root, weight))
    items, out, at = sorted(wanted, key=lambda i: len(wanted[i])), [], 0
    while at < len(items):
        end = at + 1
        while end < len(items) and (end - at) * len(wanted[items[end]]) < 1 << 19:
            end += 1
        part, width = items[at:end], len(wanted[items[end - 1]])
        ptr, weight = np.full((len(part), width), -1, np.int32), np.zeros((len(part), width), np.int64)
        for row, item in enumerate(part):
            ptr[row, : len(wanted[item])], weight[row, : len(wanted[item])] = zip(*wanted[item], strict=True)
        found = shard.searched(ptr, weight, k, np.array([least.get(i, 0) for i in part], np.int64), depth)
        out += [(part[i], None if null[d] else int(doc_ids[d]), s) for i, d, s in zip(*(c.tolist() for c in found), strict=True)]
        at = end
    return out


FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))
FOUND_TYPE = "array<struct<item_id:bigint,doc_id:bigint,score:bigint>>"


def search(index: DataFrame, documents: int, items: DataFrame, k: int = 10, block_items: int = 256, depth: int = 5, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0."""
    asked = query_terms(items, id_col, text_col, block_items)
    wanted = asked.select("term").distinct()
    rows = flagged(index, "term_id", wanted.select(F.xxhash64("term")))
    df = rows.select("term", "df").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = df.select("term", weight.cast("long").alias("weight")).where("weight > 0")
    pairs = written(asked.join(weights, "term").groupBy("block", "term").agg(F.collect_list(F.struct("item_id", "weight")).alias("asked")), "weights")
    every = pairs.select("block").distinct().select("block", F.lit("").alias("term"), F.array().cast("array<struct<item_id:bigint,weight:bigint>>").alias("asked"))
    pairs = pairs.union(every)
    dealt = flagged(index, "term_id", pairs.select(F.xxhash64("term"))).drop("term_id", "df").join(pairs, "term")

    def first(part: pa.Table) -> pa.Table:
        """All of one shard and block as one row, with what a search of bounded depth finds."""
        names, texts = part["term"].to_pylist(), part.select(["doc", "impact", "left", "right"]).to_pylist()
        ids = [x for x, name in zip(texts, names, strict=True) if not name]
        postings, asked_of = [], []
        for name, x, pairs_of in zip(names, texts, part["asked"].to_pylist(), strict=True):
            if name:
                p = np.empty(len(x["doc"]) // 4, POSTING)
                for c in POSTING.names:
                    p[c] = np.frombuffer(x[c], "<i4")
                postings.append(p)
                asked_of.append([(y["item_id"], y["weight"]) for y in pairs_of])
        found = _search(np.frombuffer(ids[0]["doc"], "<i8"), np.frombuffer(ids[0]["left"], bool), postings, asked_of, k, {}, depth)
        body = pickle.dumps((ids[0]["doc"], ids[0]["left"], [len(p) for p in postings], np.concatenate([np.empty(0, POSTING), *postings]).tobytes(), asked_of))
        return pa.table({"block": part["block"][:1], "body": pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary()), "found": pa.array([[dict(zip(("item_id", "doc_id", "score"), f, strict=True)) for f in found]], FOUND)})

    shards = written(dealt.groupBy("shard", "block").applyInArrow(first, f"block long, body binary, found {FOUND_TYPE}"), "shards")
    bounds = shards.select("block", F.explode("found").alias("f")).select("block", "f.*").withColumn("place", F.row_number().over(Window.partitionBy("block", "item_id").orderBy(F.desc("score")))).where(F.col("place") <= k)
    bounds = bounds.where(F.col("place") == k).groupBy("block").agg(F.collect_list(F.struct("item_id", "score")).alias("least"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, least in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids, null, sizes, raw, asked_of = pickle.loads(zstandard.ZstdDecompressor().decompress(body.as_py()))
                postings = np.split(np.frombuffer(raw, POSTING), np.cumsum(sizes)[:-1]) if sizes else []
                found = _search(np.frombuffer(doc_ids, "<i8"), np.frombuffer(null, bool), postings, asked_of, k, {x["item_id"]: x["score"] for x in least.as_py() or []}, None)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 3)], ["item_id", "doc_id", "score"])

    best = shards.select("block", "body").join(written(bounds, "bounds"), "block", "left").select("body", "least").mapInArrow(second, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, **settings) -> DataFrame:
    """Index of ``docs``, then the ``k`` best documents of each of ``items``."""
    index, documents = build_index(docs, **settings)
    return search(index, documents, items, k)


#: From the definition: all scores, then the ten best.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*) AS nn, sum(len(t))::BIGINT AS ll FROM d WHERE len(t) > 0),
w AS (SELECT id, unnest(t) AS term FROM d),
tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY id, term),
df AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT id, doc_id, 10 + (90 * len(t) * nn) // ll AS m FROM d, s WHERE len(t) > 0),
r AS (SELECT item_id, doc_id, id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN m USING (id) GROUP BY item_id, doc_id, id),
p AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM p WHERE rank <= 10
"""
