"""Operator 13, source divergence audit: how term shares differ between the sources of a language, by two-dimensional group-block tiling.

Groups are the (lang, source) pairs. Each language keeps the terms that ``least_docs`` of its documents have. A task counts the terms of some
megabytes of text at a time, by group, so that a hot group is summed before any shuffle. The kept counts of a language are cut into vocabulary
chunks by the hash of the term, as many as keep a chunk at ``entries`` counts, and each chunk's counts are packed into one row for each block
of ``block`` groups. Each pair of blocks is a task: packed rows are replicated to the pairs their block is in, and a task adds up its
submatrix of distances over successive chunks (``span`` of them, so that a large vocabulary is more tasks; their sums are added).
A count of 0 has a share too, so chunks are compared in dense form, ``slice_terms`` terms at a time. Shares are whole numbers: 64 bits as long
as counts allow that, else Python's.

Null texts, languages and sources are ''. A group without terms is compared like all others; in a language without kept terms all distances are 0,
and there are no terms to report. A language with one source has no pairs. Repeated rows count each time. Empty tables give no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import written
from rasterlake.llm.terms import LETTERS, counted, terms

SCALE, PRIOR = 1_000_000_000, 5
COUNT = "lang string, source string, term string, n long, docs long"


def counts_of(docs: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for each group."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    names = [c.split(" ")[0] for c in COUNT.split(", ")]

    def count(langs: list[str], sources: list[str], held: list[bytes]) -> pa.RecordBatch:
        known: dict[tuple[str, str], int] = {}
        group = np.array([known.setdefault(g, len(known)) for g in zip(langs, sources, strict=True)], np.int64)
        t = terms(held, LETTERS)
        first, term, doc, tf = counted(t, t.text)
        key = term * len(known) + group[doc]
        o = np.argsort(key, kind="stable")
        key, tf = key[o], tf[o]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        n, docs = (np.add.reduceat(tf, at), np.diff(np.append(at, len(key)))) if len(at) else (tf, tf)
        term, group = key[at] // len(known), pa.array(np.append(key[at] % len(known), np.arange(len(known))))
        lang, source = (pa.array([g[k] for g in known], pa.string()).take(group) for k in (0, 1))
        none = np.zeros(len(known), np.int64)
        words = pa.concat_arrays([t.strings(first).take(pa.array(term)), pa.nulls(len(known), pa.string())])
        return pa.RecordBatch.from_arrays([lang, source, words, pa.array(np.append(n, none)), pa.array(np.append(docs, none))], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, sources, held, size = [], [], [], 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                langs.append(lang.as_py())
                sources.append(source.as_py())
                held.append(text.as_py().encode())
                size += len(held[-1])
                if size >= batch_bytes:
                    made = count(langs, sources, held)
                    yield from (made.slice(k, 1 << 14) for k in range(0, len(made), 1 << 14))
                    langs, sources, held, size = [], [], [], 0
        if held:
            made = count(langs, sources, held)
            yield from (made.slice(k, 1 << 14) for k in range(0, len(made), 1 << 14))

    return rows.mapInArrow(emit, COUNT).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str):
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exact."""
    return F.expr(f"1 + (cast({n} + {PRIOR} as decimal(19,0)) * {SCALE}) div cast({total} + {PRIOR} * {kept} as decimal(19,0))")


def shares(n: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """The same of rows of counts."""
    whole = total + PRIOR * kept
    if n.size and int(n.max()) + PRIOR > (1 << 63) // SCALE - 1:
        return (1 + (n.astype(object) + PRIOR) * SCALE // whole.astype(object)[:, None]).astype(np.int64)
    return 1 + (n + PRIOR) * SCALE // whole[:, None]


PACK = "lang string, chunk long, block int, n_terms int, entries binary, kept long, names array<string>, totals array<bigint>"
ENTRY = np.dtype([("row", "<i4"), ("term", "<i4"), ("n", "<i8")])


def packed(part: pa.Table, block: int) -> pa.Table:
    """One chunk's counts as a row for each block of groups; ``part``: lang, chunk, blocks, g, term, n."""
    term = part["term"].combine_chunks().dictionary_encode()
    rows = np.empty(len(part), ENTRY)
    g = part["g"].to_numpy()
    rows["row"], rows["term"], rows["n"] = g % block, term.indices.to_numpy(), part["n"].to_numpy()
    blocks = part["blocks"][0].as_py()
    of = [rows[g // block == b].tobytes() for b in range(blocks)]
    return pa.table({"lang": part["lang"].combine_chunks()[:1].take(pa.array([0] * blocks)), "chunk": part["chunk"].combine_chunks()[:1].take(pa.array([0] * blocks)), "block": pa.array(range(blocks), pa.int32()), "n_terms": pa.array([len(term.dictionary)] * blocks, pa.int32()), "entries": pa.array(of, pa.binary()), "kept": pa.nulls(blocks, pa.int64()), "names": pa.nulls(blocks, pa.list_(pa.string())), "totals": pa.nulls(blocks, pa.list_(pa.int64()))})


def tiled(part: pa.Table, slice_terms: int) -> pa.Table:
    """Distances between the groups of two blocks (or within one) over the chunks of one task, in both directions."""
    order = part.select(["chunk", "block"]).to_pandas().reset_index().sort_values(["chunk", "block"])["index"].to_numpy()
    blocks = sorted(set(part["block"].to_pylist()))
    heads = {r["block"]: r for r in part.select(["block", "names", "totals", "kept"]).to_pylist() if r["names"] is not None}
    names = {b: heads[b]["names"] for b in blocks}
    totals = {b: np.array(heads[b]["totals"], np.int64) for b in blocks}
    kept = heads[blocks[0]]["kept"]
    a, b = blocks[0], blocks[-1]
    out = np.zeros((len(names[a]), len(names[b])), np.int64)
    sides: dict[int, np.ndarray] = {}
    for r in order.tolist():
        if part["names"][r].is_valid:
            continue
        at, n_terms = part["block"][r].as_py(), part["n_terms"][r].as_py()
        sides[at] = np.frombuffer(part["entries"][r].as_py(), ENTRY)
        if len(sides) < len(blocks):
            continue
        for lo in range(0, n_terms, slice_terms):
            width = min(slice_terms, n_terms - lo)
            dense = {}
            for k, entries in sides.items():
                here = entries[(entries["term"] >= lo) & (entries["term"] < lo + width)]
                counts = np.zeros((len(names[k]), width), np.int64)
                counts[here["row"], here["term"] - lo] = here["n"]
                dense[k] = shares(counts, totals[k], kept)
            for row, p in enumerate(dense[a]):
                out[row] += np.abs(dense[b] - p).sum(1)
        sides = {}
    i, j = np.indices(out.shape).reshape(2, -1)
    if a == b:
        i, j = i[i != j], j[i != j]
    value = out[i, j]
    x, y = (pa.array(names[k], pa.string()).take(pa.array(z)) for k, z in ((a, i), (b, j)))
    if a != b:
        x, y, value = pa.concat_arrays([x, y]), pa.concat_arrays([y, x]), np.append(value, value)
    return pa.table({"lang": part["lang"].combine_chunks()[:1].take(pa.array(np.zeros(len(value), np.int64))), "source": x, "item": y, "value": pa.array(value)})


def audit(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, block: int = 64, entries: int = 1 << 17, span: int = 16, slice_terms: int = 4096) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by distance ('pair'), and the terms that stand out most ('term')."""
    counts = written(counts_of(docs), "term-counts")
    kept = written(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    counts_kept = written(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    sizes = counts_kept.groupBy("lang").agg(F.count(F.lit(1)).alias("entries"))
    totals = counts_kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(sizes, "lang", "left")
    groups = groups.withColumns({"g": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, "groups": F.count(F.lit(1)).over(Window.partitionBy("lang")), **{c: F.coalesce(c, F.lit(0)) for c in ("total", "kept", "lang_total", "entries")}})
    groups = written(groups.withColumns({"blocks": F.ceil(F.col("groups") / block).cast("int"), "chunks": F.ceil(F.col("entries") / entries)}), "groups")

    terms_of = counts_kept.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    terms_of = terms_of.select("lang", "source", F.col("term").alias("item"), (share("n", "total", "kept") - share("lang_n", "lang_total", "kept")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = terms_of.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)

    entries_of = counts_kept.join(groups.select("lang", "source", "g", "blocks", "chunks"), ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk"), "blocks", "g", "term", "n")
    rows = entries_of.groupBy("lang", "chunk").applyInArrow(lambda part: packed(part, block), PACK)
    of_block = groups.groupBy("lang", (F.floor(F.col("g") / block)).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("g", "source", "total"))).alias("s"), F.max("kept").alias("kept"), F.max("blocks").alias("blocks"), F.max("chunks").alias("chunks"))
    # Each block's sources and totals go to all its tasks, as a chunk before the others.
    spans = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("chunks") / span) - 1, F.lit(0))))
    heads = of_block.select("lang", F.lit(-1).cast("long").alias("chunk"), "block", F.lit(0).alias("n_terms"), F.lit(None).cast("binary").alias("entries"), "kept", F.col("s.source").alias("names"), F.col("s.total").alias("totals"), spans.alias("span"))
    blocks = of_block.select("lang", F.col("blocks")).distinct()
    dealt = rows.withColumn("span", F.floor(F.col("chunk") / span)).union(heads).join(blocks, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other", "blocks")
    pairs = dealt.groupBy("lang", "a", "b", "span").applyInArrow(lambda part: tiled(part, slice_terms), "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(top.select("lang", "source", F.lit("term"), "item", "value", "rank"))


#: From the definition: every group with every kept term.
SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT lang, source, id, unnest(t) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n, k.lang_n::HUGEINT AS lang_n FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 5)) // (t.total + 5 * v.v) AS p, 1 + (1000000000 * (c.lang_n + 5)) // (v.lang_total + 5 * v.v) AS q FROM c JOIN t ON t.lang = c.lang AND t.source = c.source JOIN v ON v.lang = c.lang),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""
