import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataflux.operators import audio as A
from strataflux.operators import blocks as B
from strataflux.operators import pixels as P
from strataflux.operators import streams as S
from strataflux.sources import ranges
from strataflux.sources import binaries as N


@pytest.fixture(scope="module")
def image(spark):
    """Two images; the first holds most pixels and a few colours."""
    rng = random.Random(6)
    rows = [(0, y, x, rng.choice([10, 200, 201]), rng.choice([5, 90]), rng.randrange(256)) for y in range(21) for x in range(33)]
    rows += [(1, y, x, rng.randrange(256), rng.randrange(256), rng.randrange(256)) for y in range(6) for x in range(5)]
    return spark.createDataFrame(rows, "img bigint, y bigint, x bigint, r bigint, g bigint, b bigint").cache()


def same(a, b):
    cols = sorted(a.columns)
    return a.select(cols).exceptAll(b.select(cols)).count() == 0 and b.select(cols).exceptAll(a.select(cols)).count() == 0


def test_geometry_identities(image):
    four = image
    for _ in range(4):
        four = P.rotate_px(four)
    assert same(four, image)
    assert same(P.flip_px(P.flip_px(image)), image)
    assert same(P.rotate_px(image, 2), P.flip_px(P.flip_px(image), horizontal=False)) or same(
        P.rotate_px(image, 2), P.flip_px(P.flip_px(image, horizontal=False)))
    assert same(P.negate(P.negate(image)), image)
    assert same(P.rgb1_to_rgb(P.rgb_to_rgb1(image)), image)
    assert same(P.downsample(P.replicate(image, 2, 2), 2, 2), image)


def test_histogram_counts_every_pixel(image):
    assert P.colour_histogram(image).agg(F.sum("cnt")).first()[0] == image.count()


def test_levels():
    assert P.split_levels(256) == (6, 7, 6) and P.split_levels(16) == (2, 4, 2) and P.split_levels(8) == (2, 2, 2) and P.split_levels(12) == (2, 3, 2) and P.split_levels(27) == (3, 3, 3)
    for colours in range(8, 2000):
        r, g, b = P.split_levels(colours)
        assert b <= r <= g and r * g * b <= colours < r * (g + 1) * b and b**3 <= colours < (b + 1) ** 3


def test_dither_matrix(spark):
    cells = spark.range(256).select(P.dither_cell(F.expr("id div 16"), F.col("id") % 16).alias("c"), "id").orderBy("id").collect()
    grid = [r.c for r in cells]
    assert sorted(grid) == list(range(256))
    assert grid[:4] == [0, 192, 48, 240] and grid[16:18] == [128, 64]


def test_median_cut(image):
    cut = P.median_cut(P.colour_histogram(image), 8)
    boxes = P.box_stats(cut)
    for img in (0, 1):
        own = boxes.where(F.col("img") == img).collect()
        assert 1 <= len(own) <= 8 and sorted(r.box for r in own) == list(range(len(own)))
        assert all(r.n_colours > 0 for r in own)
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                assert any(a[f"{c}_max"] < b[f"{c}_min"] or b[f"{c}_max"] < a[f"{c}_min"] for c in P.CELLS)
    assert cut.agg(F.sum("cnt")).first()[0] == image.count()


def test_median_cut_stops_at_single_colours(spark):
    df = spark.createDataFrame([(0, 0, i, 8 * i, 0, 0) for i in range(3)], "img bigint, y bigint, x bigint, r bigint, g bigint, b bigint")
    assert P.palette(P.colour_histogram(df), 16).count() == 3


def test_nearest_is_nearest(image):
    colours = P.palette(P.colour_histogram(image), 6)
    table = defaultdict(list)
    for r in colours.collect():
        table[r.img].append((r.idx, r.r, r.g, r.b))
    got = P.nearest(image, colours).collect()
    assert len(got) == image.count()
    for p in got:
        centre = (p.r // 8 * 8 + 4, p.g // 4 * 4 + 2, p.b // 8 * 8 + 4)
        best = min((sum(((a - b) * s) ** 2 for a, b, s in zip(centre, c[1:], (2, 3, 1))), c[0]) for c in table[p.img])
        assert p.idx == best[1]


def test_crop_keeps_one_line(spark):
    plain = spark.createDataFrame([(0, y, x, 7, 7, 7) for y in range(5) for x in range(6)], "img bigint, y bigint, x bigint, r bigint, g bigint, b bigint")
    assert P.auto_crop(plain).count() == 1
    assert [tuple(r) for r in P.crop_box(plain).select("top", "bottom", "left_", "right_").collect()] == [(4, 0, 5, 0)]


def test_smooth_brute_force(image):
    got = {(r.img, r.y, r.x): r.r for r in P.smooth(image, 40).collect()}
    px = {(r.img, r.y, r.x): r.r for r in image.collect()}
    for img, h, w in ((0, 21, 33), (1, 6, 5)):
        for yo in range((h + 1) // 2):
            for xo in range((w + 1) // 2):
                total = 0
                for dy in (-1, 0, 1, 2):
                    for dx in (-1, 0, 1, 2):
                        inner = (dy in (0, 1)) + (dx in (0, 1))
                        weight = {2: 16384 - 40 * 80, 1: 2 * 40 * 16, 0: 40 * 16}[inner]
                        total += weight * px[img, min(h - 1, max(0, 2 * yo + dy)), min(w - 1, max(0, 2 * xo + dx))]
                assert got[img, yo, xo] == (total + 32768) >> 16


@pytest.fixture(scope="module")
def coefs(spark):
    rng = random.Random(9)
    rows = [(0, 0, by, bx, k, rng.choice([0, 0, 0, rng.randint(-40, 40)])) for by in range(4) for bx in range(5) for k in range(64)]
    return spark.createDataFrame(rows, "img bigint, comp bigint, by bigint, bx bigint, k bigint, coef bigint").cache()


def test_block_identities(coefs):
    w, h = 37, 32  # the last tile column is partial
    assert same(B.transform(B.transform(coefs, "flip_h", w, h), "flip_h", w, h), coefs)
    assert same(B.transform(B.transform(coefs, "transpose", w, h), "transpose", h, w), coefs)
    assert same(B.transform(B.transform(coefs, "rot_90", w, h), "rot_270", h, w), coefs)
    assert same(B.zigzag(B.natural(coefs)), coefs)
    assert B.transform(coefs, "flip_h", w, h, trim=True).count() == 4 * 4 * 64


def test_regions():
    assert B.parse_region("33x35+13+20", 125, 124) == (1, 2, 5, 5)
    assert B.parse_region("8x8-0-0", 64, 64) == (7, 7, 1, 1)
    with pytest.raises(ValueError):
        B.parse_region("900x8+0+0", 64, 64)


def test_transform_inverts_as_matrix():
    basis = B.cosine_basis()
    assert np.allclose(basis @ basis.T, np.eye(64))


def test_quantize_rounds_away_from_zero(spark):
    df = spark.createDataFrame([(0, v) for v in (-24, -23, 8, 7)], "k bigint, coef bigint")
    assert [r.coef for r in B.quantize(df, B.LUMINANCE).collect()] == [-2, -1, 1, 0]


def optimal_cost(counts):
    heap = sorted(counts)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    return cost


def test_code_lengths(coefs):
    stats = B.symbol_stats(coefs, 5)
    lengths = B.code_lengths(stats)
    per = defaultdict(dict)
    for r in lengths.collect():
        per[r.tbl][r.symbol] = r.len
    counts = defaultdict(dict)
    for r in stats.collect():
        counts[r.tbl][r.symbol] = r.cnt
    for tbl, lens in per.items():
        assert set(lens) == set(counts[tbl])
        assert sum(2.0 ** -n for n in lens.values()) < 1 and max(lens.values()) <= 16
        cost = sum(counts[tbl][s] * n for s, n in lens.items())
        assert cost <= optimal_cost(list(counts[tbl].values()) + [1])
    assert sum(v for v in counts["dc"].values()) == 20


def test_code_lengths_limit():
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lens = B._lengths(dict(enumerate(fib)))
    assert max(lens.values()) == 16 and len(lens) == 30 and sum(2.0 ** -n for n in lens.values()) < 1
    assert B._lengths({5: 3}) == {5: 1}


def test_symbol_stats_by_hand(spark):
    block = [(0, 0, 0, 0, k, {0: 5, 1: -3, 40: 1}.get(k, 0)) for k in range(64)]
    df = spark.createDataFrame(block, "img bigint, comp bigint, by bigint, bx bigint, k bigint, coef bigint")
    got = {(r.tbl, r.symbol): r.cnt for r in B.symbol_stats(df, 1).collect()}
    # 38 zeros: two runs of sixteen and six more
    assert got == {("dc", 3): 1, ("ac", 2): 1, ("ac", 0xF0): 2, ("ac", 6 * 16 + 1): 1, ("ac", 0): 1}


def test_display_order(spark):
    kinds = "IPBBPBBI"
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "stream bigint, decode_no bigint, ptype string")
    shown = [r.decode_no for r in S.display_order(df, width=3).orderBy("display_no").collect()]
    assert shown == [0, 2, 3, 1, 5, 6, 4, 7]
    refs = {r.decode_no: (r.past_no, r.future_no) for r in S.reference_pictures(df, width=2).collect()}
    assert refs[2] == (0, 1) and refs[4] == (1, None) and refs[5] == (1, 4) and refs[0] == (None, None)


def test_payload_reassembly(spark, folder):
    rows = [(0, "packet", 224, i, f"p{i};", len(f"p{i};")) for i in range(50)] + [(0, "packet", 225, 100 + i, "x", 1) for i in range(9)]
    df = spark.createDataFrame(rows, "stream bigint, kind string, stream_id bigint, seq bigint, payload string, payload_bytes bigint").repartition(3)
    pieces = S.reassemble(df, width=8)
    got = pieces.orderBy("start_byte").collect()
    text = "".join(r.payload for r in got)
    assert text == "".join(f"p{i};" for i in range(50))
    assert all(text[r.start_byte:].startswith(r.payload) for r in got)
    ranges.write_payload(pieces, f"{folder}/out")
    assert b"".join(r.payload for r in ranges.read_payload(spark, f"{folder}/out").orderBy("start_byte").collect()) == text.encode()


def test_audio(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "sample_id bigint, idx bigint, amp double")
    assert A.sample_copy(df, 3, 3).count() == 1
    assert [r.amp for r in A.sample_direction(df, backward=True).orderBy("idx").collect()] == [float(i) for i in range(7, -1, -1)]
    assert [r.amp for r in A.resample(df, "1", "2").orderBy("idx").collect()] == [i // 2 for i in range(16)]
    tone = A.spectrum(df, 8).orderBy("k").collect()
    assert np.allclose([complex(r.re, r.im) for r in tone], np.fft.fft(np.arange(8)))


def ppm(kind, body):
    return kind + b"\n# c\n3 2\n255\n" + body


def test_files_on_disk(spark, tmp_path):
    data = bytes(range(18))
    (tmp_path / "a.ppm").write_bytes(ppm(b"P6", data))
    (tmp_path / "b.ppm").write_bytes(ppm(b"P3", b" ".join(str(v).encode() for v in data)))
    (tmp_path / "c.pgm").write_bytes(b"P5 2 1 1\n" + bytes([0, 1]))
    (tmp_path / "d.prg").write_bytes(bytes.fromhex("601A") + b"\0" * 30)
    (tmp_path / "e.doc").write_bytes(b"hello")
    df = N.read_binary(spark, str(tmp_path))
    px = N.read_pixels(df).collect()
    by = Counter(r.img[-5:] for r in px)
    assert by == {"a.ppm": 6, "b.ppm": 6, "c.pgm": 2}
    for name in ("a.ppm", "b.ppm"):
        assert {(r.y, r.x, r.r, r.g, r.b) for r in px if r.img.endswith(name)} == {(i // 3, i % 3, *data[3 * i:3 * i + 3]) for i in range(6)}
    assert sorted(r.r for r in px if r.img.endswith("pgm")) == [0, 255]
    types = {r.type: r.files for r in N.inventory(df).collect()}
    assert types == {"pixmap": 1, "text": 2, "greymap": 1, "program": 1}


def test_small_images_share_a_frame():
    def image(i):
        return f"i{i}", b"P6 2 1 255\n" + bytes(range(i, i + 6))

    files = pd.DataFrame([image(i) for i in range(200)] + [("grey", b"P5 400 300 255\n" + bytes(120_000)), ("text", b"P2 1 2 1 0 1"), image(7)], columns=["path", "content"])
    frames = list(N._pixel_frames([files]))
    assert len(frames) == 3 and max(map(len, frames)) <= N.PIXELS_PER_BATCH
    px = pd.concat(frames)
    assert len(px) == 200 * 2 + 120_000 + 2 + 2
    assert [tuple(r) for r in px[px["img"] == "i7"][["y", "x", "r", "g", "b"]].to_numpy()] == [(0, 0, 7, 8, 9), (0, 1, 10, 11, 12)] * 2
    grey = px[px["img"] == "grey"]
    assert (grey["y"] * 400 + grey["x"]).tolist() == list(range(120_000))
    assert [tuple(r) for r in px[px["img"] == "text"][["y", "x", "r"]].to_numpy()] == [(0, 0, 0), (1, 0, 255)]


def test_start_codes_meet_chunk_edges(spark):
    rng = random.Random(7)
    content = bytes(rng.choice([0, 0, 1, 9]) for _ in range(5000))
    df = spark.createDataFrame([("f", content)], "path string, content binary")
    want = [i for i in range(len(content) - 3) if content[i:i + 3] == b"\0\0\1"]
    for size in (1, 7, 64, 1 << 20):
        assert sorted(r["at"] for r in N.scan_start_codes(df, size).collect()) == want


def test_hex_records(spark):
    df = spark.createDataFrame([(1, bytes(range(40)))], "id bigint, content binary")
    for fmt in ("s", "intel", "tek"):
        lines = [r.line for r in N.to_hex_records(df, "id", fmt, 16).orderBy("addr").collect()]
        assert len(lines) == 4
        if fmt == "s":
            for line in lines:
                assert sum(bytes.fromhex(line[2:])) & 255 == 255
        if fmt == "intel":
            for line in lines[:-1]:
                assert sum(bytes.fromhex(line[1:])) & 255 == 0


def test_default_tables():
    for (cls, tbl), (counts, _) in B.DEFAULT_CODES.items():
        lengths = B.default_lengths(cls, tbl)
        assert len(lengths) == (12 if tbl == "dc" else 162)
        assert [list(lengths.values()).count(n) for n in range(1, 17)] == [int(c) for c in counts.split()]
        assert sum(2 ** (16 - n) for n in lengths.values()) < 2**16  # the code of ones stays free
    assert B.default_lengths("luminance", "ac")[0x01] == 2 and B.default_lengths("luminance", "ac")[0xF0] == 11
    assert B.default_lengths("chrominance", "ac")[0x00] == 2 and B.default_lengths("chrominance", "dc")[0x0B] == 11


def test_default_cost(spark):
    counts = [("luminance", "dc", 0, 10), ("luminance", "dc", 1, 5), ("luminance", "dc", 13, 4), ("chrominance", "ac", 0, 7)]
    got = {(r.cls, r.tbl): (r.default_bits, r.optimal_bits, r.uncoded) for r in B.default_cost(spark.createDataFrame(counts, "cls string, tbl string, symbol long, cnt long")).collect()}
    assert got == {("luminance", "dc"): (10 * 2 + 5 * 3, 10 * 1 + 5 * 2, 4), ("chrominance", "ac"): (14, 7, 0)}


def test_quantize_by_component(spark):
    rows = [(0, c, 0, 0, k, v) for c in (0, 1, 2) for k, v in ((0, 100), (1, -100), (63, 149), (63, -148))]
    df = spark.createDataFrame(rows, "img long, comp long, by long, bx long, k long, coef long")
    got = sorted((r.comp, r.k, r.coef) for r in B.quantize_components(df, B.LUMINANCE, B.CHROMINANCE).collect())
    half = lambda v, t: (abs(v) + t // 2) // t * (1 if v >= 0 else -1)
    assert got == sorted((c, k, half(v, (B.LUMINANCE if c == 0 else B.CHROMINANCE)[k])) for _, c, _, _, k, v in rows)
    wide = sorted((r.comp, r.k, r.coef) for r in B.quantize_components(df, B.LUMINANCE, B.CHROMINANCE, big_gamut=True).collect())
    assert wide == sorted((c, k, half(v, B.LUMINANCE[k] if c == 0 else 2 * B.CHROMINANCE[k])) for _, c, _, _, k, v in rows)


def test_marker_processors(spark):
    start, scan = b"\xff\xd8", b"\xff\xda\x00\x04"
    files = [("a", start + b"\xff\xdd\x00\x04\x01\x02" + scan), ("b", start + b"\xff\xdd\x00\x05\x01\x02\x03" + b"\xff\xfe\x00\x04hi" + scan), ("c", None), ("d", b""), ("e", b"no image"),
             ("f", start + b"\xff\xc0\x00\x08\x08\x00\x10\x00\x20\x03" + scan)]
    df = spark.createDataFrame(files, "path string, content binary")
    got = [tuple(r)[:1] + tuple(r)[1:] for r in N.process_markers(df).orderBy("path").collect()]
    assert [g for g in got if g[0] == "a"] == [("a", 0xDD, 2, "interval", 258, None)]
    assert [g for g in got if g[0] == "b"] == [("b", 0xDD, 2, None, None, "wrong length of a restart interval")]
    assert {g[0] for g in got} == {"a", "b", "f"}
    assert ("f", 0xC0, 2, "width", 32, None) in got and ("f", 0xC0, 2, None, None, "short frame header") in got
    own = N.process_markers(df, {0xFE: lambda body: [("length", len(body))]}).collect()
    assert [tuple(r) for r in own] == [("b", 0xFE, 9, "length", 2, None)]
