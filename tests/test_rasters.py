"""Raster operators against plain NumPy, known values and round trips."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rasterlake.functions import codecs
from rasterlake.operators import context, custom, study
from rasterlake.plans import steps


def given(spark, images: dict[str, np.ndarray]):
    ones = [(k, int(r), int(c)) for k, m in images.items() for r, c in zip(*np.nonzero(m), strict=True)]
    return {"ones": spark.createDataFrame(ones or [("x", 0, 0)], "image_id string, r int, c int"), "dim": spark.createDataFrame([(k, *m.shape) for k, m in images.items()], "image_id string, h int, w int")}


def run(spark, select: str, images: dict[str, np.ndarray]):
    return steps.run(spark, select, **given(spark, images)).collect()


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(20260608)
    return {"a": (rng.random((32, 31)) < 0.15).astype(np.uint8), "b": (rng.random((20, 26)) < 0.5).astype(np.uint8)}


def histogram(m: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for r in range(0, m.shape[0] - m.shape[0] % 3, 3):
        for c in range(0, m.shape[1] - m.shape[1] % 3, 3):
            p = int("".join(map(str, m[r : r + 3, c : c + 3].ravel())), 2)
            out[p] = out.get(p, 0) + 1
    return out


def test_histogram_and_absent_patterns(spark, images):
    got = {k: {} for k in images}
    for r in run(spark, "SELECT image_id, pat, n FROM hist", images):
        got[r.image_id][r.pat] = r.n
    assert got == {k: histogram(m) for k, m in images.items()}
    zeros = {(r.image_id, r.pat) for r in run(spark, "SELECT image_id, pat FROM zeros", images)}
    assert zeros == {(k, p) for k, m in images.items() for p in range(512) if p not in histogram(m)}


def test_distance_one_tables_match_a_plain_greedy(spark, images):
    got = {}
    for r in run(spark, "SELECT image_id, peak, zero FROM h1map", images):
        got.setdefault(r.image_id, {})[r.peak] = [r.peak, r.zero]
    assert got == {k: t for k, m in images.items() if (t := custom.adaptive_tables(histogram(m), distance_one=True))}


def test_wire_bits_and_worked_example():
    assert [steps.wire_bits(t) for t in (0, 1, 2, 5, 10, 20, 40, 64, 100, 256)] == [96, 112, 120, 152, 200, 280, 424, 576, 776, 1416]
    assert codecs.combination_rank([5, 9, 12]) == 261
    data = codecs.encode_tables([5, 9, 12], [5 ^ 1, 9 ^ 16, 12 ^ 256], 7)
    assert int.from_bytes(data[12:], "big") == 190313
    assert codecs.decode_tables(data) == ([5, 9, 12], [4, 25, 268], 7)


@pytest.mark.parametrize("t", [0, 1, 7, 25, 80])
def test_table_codec(t):
    peaks = [5 * k for k in range(t)]
    zeros = [p ^ (1 << (p % 9)) for p in peaks]
    data = codecs.encode_tables(peaks, zeros, 1234)
    assert codecs.decode_tables(data) == (peaks, zeros, 1234) and 8 * len(data) == steps.wire_bits(t)


def test_other_codecs():
    assert codecs.unpack_bits(codecs.pack_bits([3, 0, 7], 3), 3, 3) == [3, 0, 7]
    tables = {5: [5, 7, 1, 0], 9: [9, 8]}
    assert codecs.decode_multi(codecs.encode_multi(tables, (4, 5), 9, 0.5)) == (tables, (4, 5), 9, 0.5)
    assert codecs.decode_single_peak(codecs.encode_single_peak([4, 5, 6, 7], 3, (8, 9))) == ([4, 5, 6, 7], 3, (8, 9))
    assert codecs.decode_centres(codecs.encode_centres([1, 200, 70000], [1, 0, 1], 5, (512, 512))) == ([1, 200, 70000], [1, 0, 1], 5, (512, 512))
    assert codecs.decode_context(codecs.encode_context([1, 0, 1], (3, 4), 7, -1, 2)) == ([1, 0, 1], (3, 4), 7, -1, 2)
    assert codecs.decode_uniform(codecs.encode_uniform([(3, 8), (900, 0)], (30, 40), 0.7))[0] == [(3, 8), (900, 0)]
    with pytest.raises(ValueError):
        codecs.unwire(b"")
    with pytest.raises(ValueError):
        codecs.encode_tables([5], [6], 1)


@pytest.mark.parametrize("t", [0, 1, 2, 7, 80])
def test_side_information_of_all_versions_is_read(t):
    import struct

    peaks = list(range(3, 3 + 6 * t, 6))
    flips = [p % 9 for p in peaks]
    tables = {p: [p, p ^ (1 << f)] for p, f in zip(peaks, flips, strict=True)}
    bitmap = bytearray(64)
    for p in peaks:
        bitmap[p // 8] |= 1 << (p % 8)
    nibbles = bytes(sum(f << (4 * k) for k, f in enumerate(flips[i : i + 2])) for i in range(0, t, 2))
    two = struct.pack(">4sBIII BfBH", b"ABMA", 2, 50, 60, 99, 3, 0.1, 1, t) + bytes(bitmap) + nibbles
    three = [struct.pack(">4sBIHB", b"ABMA", 3, 99, t, mode) + body for mode, body in ((0, bytes(bitmap) + nibbles), (1, codecs.pack_bits([p << 4 | f for p, f in zip(peaks, flips, strict=True)], 13)))]
    assert codecs.decode_any(codecs.wire(two)) == (tables, 99, (50, 60))
    assert [codecs.decode_any(codecs.wire(x)) for x in three] == [(tables, 99, (0, 0))] * 2
    assert codecs.decode_any(codecs.encode_tables(peaks, [z for _, z in tables.values()], 99)) == (tables, 99, (0, 0))
    assert codecs.decode_any(codecs.encode_multi(tables, (50, 60), 99, 0.5)) == (tables, 99, (50, 60))
    with pytest.raises(ValueError):
        codecs.decode_any(codecs.wire(three[0][:11] + b"\7" + three[0][12:]))
    with pytest.raises(ValueError):
        codecs.decode_any(codecs.wire(two[: struct.calcsize(">4sBIII BfB")] + struct.pack(">H", t + 1) + bytes(bitmap) + nibbles))


def test_embedding_comes_back_exactly(spark):
    rng = np.random.default_rng(3)
    big = {"k": (rng.random((600, 300)) < 0.03).astype(np.uint8)}
    rows = run(spark, "SELECT e.image_id, count(*) AS n, sum(CASE WHEN x.bit = e.bit AND x.peak = e.peak THEN 1 ELSE 0 END) AS same FROM embedded e LEFT JOIN extracted x ON x.image_id = e.image_id AND x.i = e.i AND x.br = e.br AND x.bc = e.bc GROUP BY e.image_id", big)
    assert rows and all(r.n == r.same > 0 for r in rows)


def flip_cost(m: np.ndarray, r: int, c: int) -> float:
    return sum(w * abs(int(m[r + i, c + j]) - (1 - int(m[r, c]))) for i, j, w in steps.kernel() if 0 <= r + i < m.shape[0] and 0 <= c + j < m.shape[1])


def test_flip_costs_equal_the_pointwise_sum(spark, images):
    for r in run(spark, "SELECT image_id, r, c, cost FROM flip_cost_map", images):
        assert math.isclose(r.cost, flip_cost(images[r.image_id], r.r, r.c), abs_tol=1e-12)


def test_levels(spark, images):
    table = {(nn, fn): k for nn, fn, k in steps.level_order()}
    assert all(table[nn, fn] + table[4 - nn, 4 - fn] == 26 for nn, fn in table)
    for r in run(spark, "SELECT image_id, r, c, lvl FROM level_px", images):
        m = images[r.image_id]
        v = m[r.r, r.c]
        edges = sum(m[r.r + i, r.c + j] != v for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        corners = sum(m[r.r + i, r.c + j] != v for i, j in ((1, 1), (1, -1), (-1, 1), (-1, -1)))
        assert r.lvl == table[edges, corners]


def test_difference_and_back(spark, images):
    for r in run(spark, "SELECT image_id, r, c, d FROM diff", images):
        assert r.d == context.difference(images[r.image_id])[r.r, r.c]
    for r in run(spark, "SELECT image_id, r, c, v FROM undone", images):
        assert r.v == images[r.image_id][r.r, r.c]
    assert all((context.undifference(context.difference(m)) == m).all() for m in images.values())


def test_context_counts_follow_edits_and_moves():
    rng = np.random.default_rng(5)
    diff = (rng.random((9, 14)) < 0.3).astype(np.uint8)
    at = context.Stream(diff, 17, 0)
    for step, count in ((1, 60), (-1, 40)):
        for _ in range(count):
            at.write(int(rng.integers(0, 16)))
            at.move(step)
            assert at.counts.tolist() == context.Stream(diff, 17, at.head).counts.tolist()
            heads, counts = at.stretch(step)
            assert all(c.tolist() == context.Stream(diff, 17, int(k)).counts.tolist() for k, c in zip(heads, counts, strict=True))


def test_context_roles():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 5, (200, 16))
    for row, main, rare, other in zip(counts.tolist(), *(x.tolist() for x in context.roles(counts)), strict=True):
        assert main == min(range(1, 16), key=lambda p: (-row[p], p))
        assert rare == min((q for p, q in steps.substitutes() if p == main and q), key=lambda p: (row[p], p))
        assert other == min((p for p in range(1, 16) if p not in (main, rare) and p.bit_count() % 2 == rare.bit_count() % 2), key=lambda p: (row[p], p))


def test_context_method_gives_message_and_raster_back():
    rng, exact = np.random.default_rng(0), 0
    for _ in range(120):
        h, w = rng.integers(3, 40), rng.integers(6, 40)
        image = (rng.random((h, w)) < 0.4 * rng.random()).astype(np.uint8)
        bits, length = rng.integers(0, 2, rng.integers(1, 20)).tolist(), int(rng.integers(1, h * w))
        diff = context.difference(image)
        try:
            end, marks = context.embed(diff, bits, length)
            stego = context.undifference(diff)
            back = context.difference(stego)
            exact += context.extract(back, marks, end, length) == bits and bool((context.undifference(back) == image).all())
        except ValueError:
            continue
    assert exact >= 30


def test_context_runs_report_failures_as_data(spark, images):
    rows = study.context_runs(**given(spark, images), payload_bits=16, divisors=(1, 10)).collect()
    assert len(rows) == 4 and all(r.available == (r.error is None) for r in rows)


@pytest.fixture(scope="module")
def blots():
    rng = np.random.default_rng(8)
    out = {}
    for k in range(3):
        image = (rng.random((66, 64)) < 0.03).astype(np.uint8)
        image[10:40, 8:50] |= (rng.random((30, 42)) < 0.25).astype(np.uint8)
        out[f"i{k}"] = image
    return out | {"tiny": np.zeros((5, 5), np.uint8)}


@pytest.mark.parametrize("method", ["adaptive", "distance_one", "single_peak"])
def test_tables_give_message_and_raster_back(spark, blots, method):
    rasters = given(spark, blots)
    payload = spark.createDataFrame([(k, 40) for k in blots], "image_id string, bits long")
    _, checks, flips, message, back = study.through_tables(method, rasters["ones"], rasters["dim"], payload)
    assert {r.image_id for r in checks.where("error IS NOT NULL").collect()} == {"tiny"} and flips.count() > 0
    got = {(r.image_id, r.i): r.bit for r in message.collect()}
    assert got == {(k, i): ((i * 1103515245 + 12345) // 65536) % 2 for k in blots if k != "tiny" for i in range(40)}
    assert {tuple(r) for r in back.select("image_id", "r", "c").collect()} == {(k, int(r), int(c)) for k, m in blots.items() if k != "tiny" for r, c in zip(*np.nonzero(m), strict=True)}


def test_runs_of_all_methods_are_rows_with_or_without_an_error(spark, blots):
    rasters = given(spark, blots)
    runs = study.method_runs(rasters["ones"], rasters["dim"], 32)
    rows = runs.collect()
    assert len(rows) == len(blots) * len(study.METHODS) and {r.method for r in rows} == set(study.METHODS)
    assert all((r.error is None) == r.available and (not r.available or (r.message_exact and r.reversible and r.changed_pixels is not None and r.drd >= 0)) for r in rows)
    assert not any(r.available for r in rows if r.image_id == "tiny") and sum(r.available for r in rows) >= 12
    assert {r.method for r in study.method_summary(runs).collect()} == set(study.METHODS)


def test_alpha_search_observes_and_names_the_best(spark, blots):
    rasters = given(spark, {k: m for k, m in blots.items() if k != "tiny"})
    seen = study.optimize_alpha(rasters["ones"], rasters["dim"], 16, (0.0, 1.0), 1, 21)
    assert 2 <= len(seen) <= 3 and seen[-1][1] == min(o for _, o in seen) and all(0 <= a <= 1 for a, _ in seen)


def test_empty_image_has_no_tables_and_zero_net(spark):
    rows = run(spark, "SELECT * FROM capacity", {"e": np.zeros((9, 9), np.uint8), "x": np.eye(9, dtype=np.uint8)})
    assert {r.image_id: r.net_bits for r in rows} == {"e": 0, "x": 0}


def test_expected_improvement():
    got = study.expected_improvement((np.linspace(0, 1, 11) - 0.5) ** 2, np.full(11, 0.1), 0.1)
    assert np.isfinite(got).all() and (got >= 0).all()
    assert study.expected_improvement(np.array([0.0]), np.array([0.0]), 1.0)[0] == 0


def test_gray_maps(spark, tmp_path):
    from rasterlake.sources import images as source
    from rasterlake.sources import reports

    (tmp_path / "2.pgm").write_bytes(b"P5\n# note\n4 1\n255\n" + bytes([0, 127, 128, 255]))
    (tmp_path / "10.pgm").write_bytes(b"P2 2 1 255\n1 0\n")
    rows = source.pgm_rows(spark, str(tmp_path))
    ones, dim = source.raster(rows, 128)
    assert {(r.image_id, r.c) for r in ones.collect()} == {("2", 2), ("2", 3)}
    assert {(r.image_id, r.c) for r in source.raster(rows)[0].collect()} == {("2", 1), ("2", 2), ("2", 3), ("10", 0)}
    assert [r.number for r in source.listed(spark, str(tmp_path)).collect()] == [2, 10]
    assert reports.write_pgm(ones, dim, f"file://{tmp_path}/out").count() == 2
    assert source.parse_pgm((tmp_path / "out" / "2.pgm").read_bytes()).tolist() == [[0, 0, 255, 255]]


def png(gray: np.ndarray) -> bytes:
    """An 8-bit PNG, of one channel or of three."""
    import struct
    import zlib

    h, w = gray.shape[:2]
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in gray.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if gray.ndim == 2 else 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_decoded_images(spark, tmp_path):
    from rasterlake.sources import images as source

    rng = np.random.default_rng(1)
    gray, colour = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (4, 3, 3))
    (tmp_path / "g.png").write_bytes(png(gray))
    (tmp_path / "c.png").write_bytes(png(colour))
    got = {(r.image_id, r.r): list(r.gray) for r in source.decoded_rows(spark, str(tmp_path)).collect()}
    want = {("g", k): row.tolist() for k, row in enumerate(gray)} | {("c", k): [(299 * r + 587 * g + 114 * b + 500) // 1000 for r, g, b in row.tolist()] for k, row in enumerate(colour)}
    assert got == want


def test_message_and_reports(spark, tmp_path):
    from rasterlake.sources import reports

    rows = reports.message_rows(spark, 20, spark.createDataFrame([("a", 3), ("b", 5)], "image_id string, number long"), 40).collect()
    assert [r.bit for r in sorted(rows, key=lambda r: (r.image_id, r.i))] == [int(b) for k in (43, 45) for b in np.random.default_rng(k).integers(0, 2, 20)]
