"""Joint segmentation against a plain loop, in chunks of any size, and back again."""

import random

import pytest

from strataflux.operators import segments as G


def plain(values):
    """The longest piece at each place, found by looking ahead value by value."""
    out, at, n = [], 0, len(values)

    def solid(i):
        k = 1
        while i + k < n and k < G.MOST and values[i + k] == values[i]:
            k += 1
        return k

    def pattern(i):
        if i + 3 >= n or values[i] == values[i + 1]:
            return 0
        k = 2
        while i + k + 1 < n and k < G.MOST and (values[i + k], values[i + k + 1]) == (values[i], values[i + 1]):
            k += 2
        return k if k >= 4 else 0

    def best(i):
        s, p = solid(i), pattern(i)
        return (1, s) if s >= 2 and s >= p else (2, p) if p else (0, 0)

    while at < n:
        kind, size = best(at)
        if not kind:
            size = 1
            while at + size < n and size < G.MOST and not best(at + size)[0]:
                size += 1
        out.append((G.KINDS[kind], size, values[at : at + (size if not kind else kind)]))
        at += size
    return out


def sequence(seed, n):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        a, b, k = r.randrange(5), r.randrange(5), r.choice([1, 1, 2, 3, 5, 60, 150, 300])
        out += r.choice([[a] * k, [a, b] * k, [(3 * i + i // 7) % 97 + 10 for i in range(k)]])
    return out[:n]


def test_one_sequence():
    for seed in range(300):
        values = sequence(seed, random.Random(seed).choice([0, 1, 2, 3, 4, 5, 10, 200, 1000]))
        assert G.segment(values) == plain(values), values[:40]


@pytest.mark.parametrize("chunk", [132, 150, 1 << 14])
def test_chunks_equal_one_walk(spark, chunk):
    lengths = [1, 2, 127, 128, 129, 300, 900, 1500]
    data = {i: sequence(100 + i, n) for i, n in enumerate(lengths)}
    data |= {20 + i: sequence(i, 600) for i in range(40)}  # literals of up to 300 values end everywhere around the edges
    data[8], data[9], data[None] = [7] * 700, [1, 2] * 350 + [1], [3] * 5
    rows = [(p, i, v, "x") for p, values in data.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "part bigint, at bigint, v bigint, size string").repartition(5)
    found = G.segments(df, ["part"], "at", "v", chunk=chunk)
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r.part is None, r.part or 0, r.start)):
        assert r.start == sum(size for _, size, _ in got.get(r.part, []))
        got.setdefault(r.part, []).append((r.kind, r.size, r["values"]))
    assert got == {p: plain(values) for p, values in data.items()}
    back = G.expand(found, ["part"], "at", "v").collect()
    assert {(r.part, r.at, r.v) for r in back} == {(p, i, v) for p, i, v, _ in rows} and len(back) == len(rows)


def test_no_rows(spark):
    assert G.segments(spark.createDataFrame([], "part bigint, pos bigint, v bigint"), ["part"], "pos", "v").count() == 0
