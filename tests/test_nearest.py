import math
import random

import numpy as np
import pytest

from strataflux.operators import pixels as P
from strataflux.operators import nearest as N
from strataflux.operators.nearest import nearest_by_cells


def brute(v, centroids):
    if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in centroids)[1]


@pytest.fixture(scope="module")
def points():
    rng = random.Random(5)
    whole = [(i * 3, [float(rng.randrange(6)) for _ in range(3)]) for i in range(150)]  # many equal ones: ties by key
    far = [(1000 + i, [100.0 + rng.random(), -50.0 + rng.random(), rng.random()]) for i in range(40)]
    return whole + far


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    some = [(i, [float(rng.randrange(6)) for _ in range(3)], "x") for i in range(300)]
    hot = [(1000 + i, [99.0, -50.0, 0.5], "hot") for i in range(400)]
    odd = [(2000, None, "null"), (2001, [math.nan, 0.0, 0.0], "nan"), (2002, [math.inf, 0.0, 0.0], "inf"), (2003, [], "empty"), (2004, [1.0, None, 2.0], "gap"), (0, [0.0, 0.0, 0.0], "again")]
    return some + hot + odd


@pytest.mark.parametrize("pivots, block, spread", [(1, 1000, 1), (4, 3, 2), (64, 7, 16), (500, 1, 3)])
def test_equal_to_brute_force(spark, points, rows, pivots, block, spread):
    vectors = spark.createDataFrame(rows, "id long, vec array<double>, key string").repartition(3)
    centroids = spark.createDataFrame(points, "k long, centroid array<double>")
    got = nearest_by_cells(vectors, centroids, "vec", "k", pivots=pivots, block=block, spread=spread)
    assert got.columns == ["id", "key", "nearest"]
    want = sorted((i, key, str(brute(v, points))) for i, v, key in rows)
    assert sorted((r.id, r.key, str(r.nearest)) for r in got.collect()) == want


def test_no_centroid(spark, rows):
    vectors = spark.createDataFrame(rows, "id long, vec array<double>, key string")
    none = spark.createDataFrame([(1, None), (2, [math.nan, 0.0, 0.0])], "k long, centroid array<double>")
    got = nearest_by_cells(vectors, none, "vec", "k").collect()
    assert len(got) == len(rows) and all(r.nearest is None for r in got)
    assert nearest_by_cells(vectors.limit(0), none, "vec", "k").count() == 0


def test_large_tables_are_not_refused(spark, points, rows):
    good = [r for r in rows if brute(r[1], points) is not None]
    vectors = spark.createDataFrame(good, "id long, vec array<double>, key string")
    centroids = spark.createDataFrame(points, "k long, centroid array<double>")
    small = P.nearest_vectors(vectors, centroids, "vec", "k").select("id", "key", "nearest")
    large = P.nearest_vectors(vectors, centroids, "vec", "k", limit=10).select("id", "key", "nearest")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_closest_measures_as_one_point_at_a_time():
    r = np.random.default_rng(1)
    for dim, scale in ((1, 1.0), (3, 1e-170), (64, 1.0), (64, 1e160)):
        points = r.normal(size=(300, dim))
        points = np.concatenate([points, points[5:30]]) * scale  # equal points: the first counts
        vectors = np.concatenate([r.normal(size=(300, dim)) * scale, points[:50], (points[:40] + points[1:41]) / 2])
        with np.errstate(over="ignore"):
            got, want = N.closest(vectors, points), N._closest_by_point(vectors, points)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
