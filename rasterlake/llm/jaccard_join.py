"""Operator 5, n-gram Jaccard join: an exact metric-space join of documents' shingle sets, up to connected components.

The distance is 1 - |A and B| / |A or B|; documents link at 0.15 or less. Almost all pairs of a corpus stand at
exactly 1, where the triangle inequality says nothing and cells around pivots would copy every document
everywhere, so the space is first cut into regions that hold every pair below that: two linked documents share one
of the first n - ceil(0.85 n) + 1 shingles of their sets, and k of the first n - ceil(0.85 n) + k, in one order for all
(frequent shingles last); a region is the documents with one such shingle. Inside regions distances differ, and pivots work:

1. Equal sets fold into their smallest doc_id (128-bit signatures and sizes); a task folds them before the shuffle.
2. Prefix regions of up to ``small`` documents compare all pairs of fitting sizes. Larger ones compare every document with their smallest doc_id: those within 0.15
   are one component at once. Compared pairs are verified on whole sets, in groups by the smaller document and in chunks of bounded size.
3. Of documents in large prefix regions that are still in different components, those go on that share enough of their prefixes with another (only shingles of
   large regions are compared, a small part of the sets). Large prefix regions whose documents are still in different components are clusters of a metric space of their own, joined by ``voronoi``: pivots are drawn from
   each region, every document goes to the region of its nearest pivot and, as two linked documents' distances to any pivot differ by at most 0.15, is
   copied to those regions whose pivot is at most 0.3 farther away: no link is lost. Documents that share nothing with any pivot make a region
   of their own, with those at 0.85 or more from all. Regions over ``block`` documents or ``weight`` shingles are
   divided again by pivots of their own, as long as that makes them smaller; one whose documents are all about as far from every pivot is
   joined as it is, in blocks. Tasks intersect the sets of documents whose components differ, and return one link for two components.
   After this no pair that could join two components is left, so components are exact.

Sets hold 64-bit hashes of shingles. A-Z are lower-cased; a document with fewer words than a shingle has its whole sequence as the
only one; without words or text the set is empty and links with nothing. Rows with one doc_id are versions of one
document; a null doc_id links with nothing and is its own component (null). No rows give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import among, batched, components, flagged, id_text, in_rows, requested, written
from rasterlake.llm.grams import shingles, words
from rasterlake.llm.suffix_dedup import ODD, mixed

ROW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("n", "<i4")])
#: Pivots that a region draws; how much smaller than the region its largest part must be; how much all parts together may hold.
PIVOTS, SMALLER, COPIED = 8, 0.8, 3.0


def sets_of(raws: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(raws)
    tokens, good = shingles(w, size)
    first = np.append(0, w.ends)
    out = []
    for t in range(len(raws)):
        a, b = int(first[t]), int(first[t + 1])
        if b - a >= size:
            out.append(np.unique(tokens[a : b - size + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mixed(h * ODD[9] + w.hash[k : k + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def level(n):
    """How many shingles of their prefixes two linked documents must share, by the size of the one for which that's fewer."""
    return 1 + n // 20


def prefix(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + int(level(n)))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, True))


def shared_counts(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, rare: int = 16, slab: int = 2048) -> np.ndarray:
    """How many elements each set of ``one`` shares with each of ``two``: rare elements by their pairs of sets, others as products of 0/1 matrices."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    begin = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
    count = np.diff(np.append(begin, len(every)))
    row, column = (np.full(len(sets), -1) for _ in range(2))
    row[one], column[two] = np.arange(len(one)), np.arange(len(two))
    both = np.zeros(len(one) * len(two), np.float32)
    for c in range(2, rare + 1):
        at = begin[count == c]
        for k in range(0, len(at), 1 << 12):
            held = owner[at[k : k + (1 << 12), None] + np.arange(c)]
            i, j = np.broadcast_to(row[held][:, :, None], (len(held), c, c)).ravel(), np.broadcast_to(column[held][:, None, :], (len(held), c, c)).ravel()
            use = (i >= 0) & (j >= 0)
            both += np.bincount(i[use] * len(two) + j[use], minlength=len(both)).astype(np.float32)
    both = both.reshape(len(one), len(two))
    often = np.flatnonzero(count > rare)
    for k in range(0, len(often), slab):
        part = often[k : k + slab]
        has = np.zeros((len(sets), len(part)), np.float32)
        has[owner[np.repeat(begin[part], count[part]) + np.arange(count[part].sum()) - np.repeat(np.cumsum(count[part]) - count[part], count[part])], np.repeat(np.arange(len(part)), count[part])] = 1
        both += has[one] @ has[two].T
    return both


def nearest(sets: list[np.ndarray], pivots: list[np.ndarray], epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Each set's region and the regions (sets x pivots + 1) that it belongs to.

    A set's own region is that of its nearest pivot; it belongs to those too whose pivot is at most 2 ``epsilon`` farther away. Sets that share nothing with any pivot
    have the last region, to which those belong that stand at 1 - ``epsilon`` or more from every pivot.
    """
    every, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    ends = np.append(0, np.cumsum(sizes))
    distance = np.empty((len(sets), len(pivots)))
    for j, p in enumerate(pivots):
        place = np.minimum(np.searchsorted(p, every), len(p) - 1)
        hits = np.append(0, np.cumsum(p[place] == every))
        both = hits[ends[1:]] - hits[ends[:-1]]
        distance[:, j] = 1 - both / (sizes + len(p) - both)
    least = distance.min(1)
    inside = np.column_stack([(distance <= least[:, None] + 2 * epsilon + 1e-9) & (least < 1)[:, None], least >= 1 - epsilon - 1e-9])
    return np.where(least < 1, distance.argmin(1), len(pivots)), inside


def in_block_pairs(rows: DataFrame) -> DataFrame:
    """Rows (region, doc, label, n, blocks) dealt to blocks by doc, once for each pair of blocks p <= q that has theirs."""
    dealt = rows.withColumn("at", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("region", F.least("at", "o").alias("p"), F.greatest("at", "o").alias("q"), (F.col("at") <= F.col("o")).alias("first"), (F.col("at") >= F.col("o")).alias("second"), "doc", "label", "n")


def fitting(part: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block's rows, second block's rows, whether two of them may be linked by their labels and sizes)."""
    label, n, doc = (part[c].to_numpy() for c in ("label", "n", "doc"))
    one, two = (np.flatnonzero(part[c].to_numpy(zero_copy_only=False)) for c in ("first", "second"))
    x, y = one[:, None], two[None, :]
    return one, two, (label[x] != label[y]) & (doc[x] != doc[y]) & (100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64))


def with_partner(members: DataFrame, keys: DataFrame, percent: int, block: int, weight: int) -> DataFrame:
    """Documents (doc) of ``members`` (cluster, doc, label, n) that share enough prefix shingles with one of another component in their cluster.

    ``keys`` (doc, keys, most) has a document's shingles in large prefix regions and the most that it shares with any other in small ones: only these few are compared here.
    """

    def able(part: pa.Table) -> pa.Table:
        one, two, may = fitting(part, percent)
        if not may.any():
            return pa.table({"doc": pa.array([], pa.int64())})
        ends = np.append(0, np.cumsum(pa.compute.list_value_length(part["keys"]).to_numpy()))
        flat = part["keys"].combine_chunks().flatten().to_numpy()
        n, most, doc = (part[c].to_numpy() for c in ("n", "most", "doc"))
        both = shared_counts([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], one, two)
        x, y = one[:, None], two[None, :]
        i, j = np.nonzero(may & (both + np.minimum(most[x], most[y]) >= level(np.minimum(n[x], n[y]).astype(np.int64))))
        return pa.table({"doc": pa.array(np.unique(doc[np.append(one[i], two[j])]))})

    sizes = members.join(keys, "doc").groupBy("cluster").agg(F.greatest(F.ceil(F.sum(F.size("keys")) / weight), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    dealt = in_block_pairs(members.join(sizes, "cluster").withColumnRenamed("cluster", "region")).join(keys, "doc")
    return dealt.groupBy("region", "p", "q").applyInArrow(able, "doc long").distinct()


def voronoi(members: DataFrame, space: DataFrame, percent: int, block: int, weight: int) -> DataFrame:
    """Links (a, b) between components, one at least for any two that have some, in each cluster of ``members`` (cluster, doc, label, n); ``space`` has the sets (doc, raw)."""
    epsilon = 1 - percent / 100

    def sized(rows: DataFrame) -> DataFrame:
        """Regions that have two components or more, with their size."""
        found = rows.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("docs"), (F.min("label") != F.max("label")).alias("mixed")).where("mixed").drop("mixed")
        return found.withColumn("blocks", F.greatest(F.ceil(F.col("total") / weight), F.ceil(F.col("docs") / block)).cast("int"))

    def assign(part: pa.Table) -> pa.Table:
        pivot = part["pivot"].to_pylist()
        sets = [np.frombuffer(r, "<u8") for r in part["raw"].to_pylist()]
        chosen = [s for s, p in zip(sets, pivot, strict=True) if p]
        rest = np.array([k for k, p in enumerate(pivot) if not p], np.int64)
        home, inside = nearest([sets[k] for k in rest], chosen, epsilon)
        i, j = np.nonzero(inside)
        names = mixed(np.array([part["region"][0].as_py()], np.int64).view(np.uint64) + ODD[11] * (np.arange(len(chosen) + 1, dtype=np.uint64) + np.uint64(1))).view(np.int64)
        rows = part.select(["region", "doc", "label", "n"]).take(pa.array(rest[i]))
        return rows.append_column("part", pa.array(names[j])).append_column("at_home", pa.array(home[i] == j))

    finished, now = [], members.select(F.col("cluster").alias("region"), "doc", "label", "n")
    while True:
        sizes = written(sized(now), "region-sizes")
        finished.append(now.join(sizes.where("blocks = 1"), "region"))
        large = sizes.where("blocks > 1")
        if not large.limit(1).count():
            break
        rows = written(now.join(large, "region"), "regions")
        # A region's pivots are of bounded number, so they can go to each of its chunks.
        drawn = rows.withColumn("r", F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("doc", "region"), "doc"))).where(F.col("r") <= PIVOTS)
        drawn = drawn.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        both = dealt.select("region", "chunk", "doc", "label", "n", F.lit(False).alias("pivot")).union(drawn.select("region", "chunk", "doc", "label", "n", F.lit(True)))
        parts = both.join(space, "doc").groupBy("region", "chunk").applyInArrow(assign, "region long, doc long, label long, n int, part long, at_home boolean")
        parts = written(parts.distinct(), "region-parts")
        whole = parts.groupBy("region", "part").agg(F.sum("n").alias("w")).groupBy("region").agg(F.max("w").alias("most"), F.sum("w").alias("all")).join(large, "region")
        divided = whole.where((F.col("most") <= SMALLER * F.col("total")) & (F.col("all") <= COPIED * F.col("total"))).select("region")
        finished.append(rows.join(divided, "region", "left_anti"))
        now = written(parts.join(divided, "region", "left_semi").select(F.col("part").alias("region"), "doc", "label", "n").distinct(), "regions")

    def compare_blocks(part: pa.Table) -> pa.Table:
        one, two, may = fitting(part, percent)
        if not may.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = shared_counts([np.frombuffer(r, "<u8") for r in part["raw"].to_pylist()], one, two)
        label, n, doc = (part[c].to_numpy() for c in ("label", "n", "doc"))
        i, j = np.nonzero(may & (100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)))
        i, j = one[i], two[j]
        _, k = np.unique(np.stack([np.minimum(label[i], label[j]), np.maximum(label[i], label[j])], 1), axis=0, return_index=True)
        return pa.table({"a": pa.array(doc[i[k]]), "b": pa.array(doc[j[k]])})

    last = finished[0]
    for more in finished[1:]:
        last = last.unionByName(more)
    return written(in_block_pairs(last).join(space, "doc").groupBy("region", "p", "q").applyInArrow(compare_blocks, "a long, b long").distinct(), "region-links")


def join(docs: DataFrame, size: int = 4, percent: int = 85, small: int = 16, block: int = 1024, weight: int = 1 << 20, task_bytes: int = 2 << 20, shuffle_bytes: int = 8 << 20, shard_bytes: int = 16 << 20, hot_in_task: int = 4, most_hot: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    ``most_hot`` bounds the frequent shingles that are ordered last (and sent to all tasks); it changes how much is compared, never what is found.
    """
    import zstandard

    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held in batched(batches, task_bytes):
            sets = sets_of(held, size)
            n = np.array([len(s) for s in sets], np.int32)
            one = np.array([int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            two = np.array([int(mixed(s * ODD[10]).sum(dtype=np.uint64)) if len(s) else 0 for s in sets], np.uint64)
            value, count = np.unique(np.concatenate(sets), return_counts=True) if n.sum() else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = count >= hot_in_task
            m, k = len(ids), int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids, *[None] * k], pa.int64()), pa.array(np.append(n, np.zeros(k, np.int32))),
                    pa.array(np.append(one.view(np.int64), value[often].view(np.int64))), pa.array(np.append(two.view(np.int64), count[often])), pa.array(np.repeat([False, True], [m, k])),
                ],
                ["doc_id", "n", "one", "two", "often"],
            )

    summary = written(texts.mapInArrow(summarise, "doc_id long, n int, one long, two long, often boolean"), "sets")
    hot = np.sort(np.array([r["one"] for r in summary.where("often").groupBy("one").agg(F.sum("two").alias("k")).orderBy(F.desc("k"), "one").limit(most_hot).collect()], np.int64).view(np.uint64))
    sets = summary.where("NOT often")
    same = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "one", "two").agg(F.min("doc_id").alias("head"))

    def prefixes(ids: list[int], held: list[bytes]) -> list[np.ndarray]:
        """The prefixes of the texts' sets; of equal sets only that of the smallest id."""
        order = sorted(range(len(ids)), key=ids.__getitem__)
        found = sets_of([held[k] for k in order], size)
        every = np.concatenate(found)
        place = np.searchsorted(hot, every)
        often = hot[np.minimum(place, len(hot) - 1)] == every if len(hot) else np.zeros(len(every), bool)
        made, seen = [], set()
        for k, s, end in zip(order, found, np.cumsum([len(s) for s in found]).tolist(), strict=True):
            if not len(s) or (mark := s.tobytes()) in seen:
                continue
            seen.add(mark)
            frequent = often[end - len(s) : end]
            use = np.concatenate([s[~frequent], s[frequent]])[: prefix(len(s), percent)]
            rows = np.empty(len(use), ROW)
            rows["key"], rows["doc"], rows["n"] = use, ids[k], len(s)
            made.append(rows)
        return made

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress

        def dealt(made: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(made)
            shard = (rows["key"] % np.uint64(shards)).astype(np.int64)
            rows = rows[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            begins = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            out = [(int(shard[a]), press(packed(rows[a:b]))) for a, b in zip(begins, np.append(begins[1:], len(rows)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["shard", "rows"])

        made, held_bytes = [], 0
        for ids, held in batched(batches, task_bytes):
            made += prefixes(ids, held)
            held_bytes += sum(map(len, held))
            if held_bytes >= shuffle_bytes and made:
                yield dealt(made)
                made, held_bytes = [], 0
        if made:
            yield dealt(made)

    def compare(part: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        rows = np.unique(np.concatenate([unpacked(open_(r)) for r in part["rows"].to_pylist()]))
        begins = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
        sizes = np.diff(np.append(begins, len(rows)))
        a, b = [], []
        # Regions of one size together: all their pairs in a few array steps.
        for g in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
            block = rows[begins[sizes == g][:, None] + np.arange(g)]
            i, j = np.triu_indices(g, 1)
            a.append(block[:, j].ravel())
            b.append(block[:, i].ravel())
        n_small = sum(map(len, a))
        large = sizes > small
        member = rows[np.repeat(large, sizes)]
        pivot = rows[np.repeat(begins[large], sizes[large])] if large.any() else member
        x, y = np.concatenate([*a, member]), np.concatenate([*b, pivot])
        at_pivot = np.arange(len(x)) >= n_small
        fit = (x["doc"] != y["doc"]) & (100 * np.minimum(x["n"], y["n"]).astype(np.int64) >= percent * np.maximum(x["n"], y["n"]).astype(np.int64))
        x, y, at_pivot = x[fit], y[fit], at_pivot[fit]
        pairs = np.stack([np.maximum(x["doc"], y["doc"]), np.minimum(x["doc"], y["doc"]), level(np.minimum(x["n"], y["n"]).astype(np.int64))], 1)
        order = np.lexsort(pairs.T[::-1])
        pairs, at_pivot = pairs[order], at_pivot[order]
        at = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(1))[: len(pairs)])
        both = np.append(0, np.cumsum(at_pivot))
        ends = np.append(at[1:], len(pairs))
        pivoted = both[ends] - both[at]
        pairs, counts = pairs[at], [ends - at - pivoted, pivoted]
        none = lambda k, t: pa.nulls(k, t)
        p, m = len(pairs), len(member)
        return pa.concat_tables([
            pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "need": pa.array(pairs[:, 2].astype(np.int32)), "shared": pa.array(counts[0].astype(np.int32)), "at_pivot": pa.array(counts[1].astype(np.int32)), "key": none(p, pa.int64()), "n": none(p, pa.int32())}),
            pa.table({"a": pa.array(member["doc"]), "b": pa.array(pivot["doc"]), "need": none(m, pa.int32()), "shared": none(m, pa.int32()), "at_pivot": none(m, pa.int32()), "key": pa.array(member["key"].view(np.int64)), "n": pa.array(member["n"])}),
        ])

    stage = written(texts.where("doc_id IS NOT NULL").mapInArrow(emit, "shard long, rows binary").groupBy("shard").applyInArrow(compare, "a long, b long, need int, shared int, at_pivot int, key long, n int"), "regions")

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, both, n_a, n_b): the sizes of intersection and sets."""
        chunked = written(pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(1 << 20)).alias("h")), "pairs")
        many = chunked.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 256).alias("chunks"))
        dealt = chunked.join(many, "b").select("a", "b", F.pmod("h", F.col("chunks")).alias("chunk"))
        asked = dealt.select(F.col("a").alias("doc_id"), "b", "chunk", F.lit(0).alias("side")).union(dealt.select("b", "b", "chunk", F.lit(1)).distinct())
        def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole, held in batched(whole_rows(batches), task_bytes):
                rows = []
                for (doc, asked), s in ((x.values(), s) for x, s in zip(whole, sets_of(held, size), strict=True)):
                    raw = s.tobytes()
                    rows += [(r["b"], r["chunk"], r["side"], doc, raw) for r in asked]
                    if len(rows) >= 500:
                        yield excerpt_batch(rows)
                        rows = []
                if rows:
                    yield excerpt_batch(rows)

        def whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in (batch.slice(k, 512) for k in range(0, len(batch), 512)):
                    yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([part.column(0), part.column(2)], ["doc", "asked"]), part.column(1)], ["id", "text"])

        def excerpt_batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["b", "chunk", "side", "doc", "raw"])

        def check(part: pa.Table) -> pa.Table:
            side, doc, raws = part["side"].to_pylist(), part["doc"].to_pylist(), part["raw"].to_pylist()
            heads = [np.frombuffer(r, "<u8") for s, r in zip(side, raws, strict=True) if s == 1]
            rows = [(d, part["b"][0].as_py(), overlap(np.frombuffer(r, "<u8"), h), len(r) // 8, len(h)) for s, d, r in zip(side, doc, raws, strict=True) if s == 0 for h in heads]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            return pa.table({c: pa.array(v, t) for c, v, t in zip(("a", "b", "both", "n_a", "n_b"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)})

        cut = requested(texts, in_rows(asked)).select("doc_id", "text", "asked").mapInArrow(excerpts, "b long, chunk long, side int, doc long, raw binary")
        return written(cut.groupBy("b", "chunk").applyInArrow(check, "a long, b long, both int, n_a int, n_b int").distinct(), "verified")

    near = F.col("both") * 100 >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))
    folded = sets.join(same, ["n", "one", "two"]).where("doc_id > head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    head_of = written(folded, "heads")
    found = stage.where("key IS NULL").groupBy("a", "b", "need").agg(F.sum("shared").alias("shared"), F.sum("at_pivot").alias("at_pivot"))

    def moved(pairs: DataFrame) -> DataFrame:
        """Pairs of folded documents become pairs of their heads, so that each pair of sets is verified once."""
        for c in ("a", "b"):
            pairs = pairs.join(head_of.select(F.col("a").alias(c), F.col("b").alias("h")), c, "left").withColumn(c, F.coalesce("h", c)).drop("h")
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    first = verified(moved(found.where("shared + at_pivot >= need").select("a", "b")))
    links = first.where(near).select("a", "b")
    regions = stage.where("key IS NOT NULL").select("key", F.col("a").alias("doc"), "n", F.col("b").alias("pivot"))
    # A document that can't share enough with any other, all its large regions and its best small-region partner counted, links with none of them.
    partner = found.select("a", "shared").union(found.select("b", "shared")).groupBy(F.col("a").alias("doc")).agg(F.max("shared").alias("most"))
    needed = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 20)
    within = regions.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("k")).join(partner, "doc", "left").where(F.col("k") + F.coalesce("most", F.lit(0)) >= needed)
    regions = among(regions, "doc", written(within.select("doc").distinct(), "able"))
    if regions.limit(1).count():
        labels = components(links.union(head_of))
        headed = regions
        for c in ("doc", "pivot"):
            headed = headed.join(head_of.select(F.col("a").alias(c), F.col("b").alias(f"{c}_head")), c, "left").withColumn(f"{c}_head", F.coalesce(f"{c}_head", c))
        both_labels = headed.join(labels.withColumnRenamed("node", "doc_head"), "doc_head", "left").withColumn("label", F.coalesce("component", "doc_head")).drop("component")
        both_labels = both_labels.join(labels.withColumnRenamed("node", "pivot_head"), "pivot_head", "left").withColumn("cluster", F.coalesce("component", "pivot_head"))
        open_keys = both_labels.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("key")
        opened = both_labels.join(open_keys, "key")
        # The same again, counting only what is still open.
        reach = opened.groupBy("doc", "doc_head", "n").agg(F.count_distinct("key").alias("k")).join(partner, "doc", "left").groupBy("doc_head", "n").agg(F.max(F.col("k") + F.coalesce("most", F.lit(0))).alias("k"))
        able = reach.where(F.col("k") >= needed).select("doc_head")
        member = written(opened.join(able, "doc_head", "left_semi").select("cluster", F.col("doc_head").alias("doc"), "label", "n").distinct(), "open-clusters")
        # What small regions add: the most shingles shared with a document of another component that hasn't been verified yet.
        head_label = written(opened.select("doc", "doc_head", "label").distinct().join(opened.groupBy("doc_head").agg(F.count_distinct("key").alias("k")), "doc_head"), "open-documents")
        # Pairs that share enough have been verified; others link only if the open regions that each document is in can give what they lack.
        apart = found.where("shared + at_pivot < need").select("a", "b", "shared", (F.col("need") - F.col("shared")).alias("lack"))
        for c in ("a", "b"):
            apart = flagged(apart, c, head_label.select("doc", "k")).join(head_label.select(F.col("doc").alias(c), F.col("doc_head").alias(f"{c}_head"), F.col("label").alias(f"{c}_label"), "k").hint("merge"), c).where("lack <= k").drop("k")
        apart = apart.where("a_label <> b_label").select(F.greatest("a_head", "b_head").alias("a"), F.least("a_head", "b_head").alias("b"), "shared").join(first.select("a", "b"), ["a", "b"], "left_anti")
        apart = apart.select("a", "shared").union(apart.select("b", "shared")).groupBy(F.col("a").alias("doc")).agg(F.max("shared").alias("most"))
        keys = opened.groupBy(F.col("doc_head").alias("doc")).agg(F.collect_set("key").alias("keys")).join(apart, "doc", "left").select("doc", "keys", F.coalesce("most", F.lit(0)).cast("int").alias("most"))
        keys = written(keys.join(member.select("doc").distinct(), "doc"), "open-keys")
        member = written(member.join(written(with_partner(member, keys, percent, block, weight), "with-partner"), "doc", "left_semi").select("cluster", "doc", "label", "n"), "open-clusters")

        def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(k, 500) for whole in batches for k in range(0, len(whole), 500)):
                found = sets_of([t.as_py().encode() for t in batch.column(1)], size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["doc", "raw"])

        space = written(requested(texts, member.select(F.col("doc").alias("doc_id")).distinct()).select("doc_id", "text").mapInArrow(whole_sets, "doc long, raw binary"), "open-sets")
        links = links.union(voronoi(member, space, percent, block, weight))
    labels = components(links.union(head_of))
    return sets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def packed(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in (rows["key"], np.diff(rows["doc"], prepend=0), rows["n"]))


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // ROW.itemsize
    rows = np.empty(n, ROW)
    rows["key"], rows["doc"], rows["n"] = np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<i8", n, 8 * n).cumsum(), np.frombuffer(raw, "<i4", n, 16 * n)
    return rows


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs``, all columns, with one document of each component; rows without words or doc_id stay."""
    gone = join(docs, id_col=id_col, text_col=text_col, **settings).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = written(gone, "gone")
    return among(docs, id_col, gone, "left_anti")
