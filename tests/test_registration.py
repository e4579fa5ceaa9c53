"""Planted similarities are found again from star patterns; strangers are not registered."""

import math

import numpy as np

from starledger.operators import registration

STARS = "frame int, star int, x double, y double, flux double"


def sky(rng, n=10):
    return [(float(x), float(y)) for x, y in rng.uniform(-800, 800, (n, 2))]


def moved(points, degrees, scale, dx, dy, rng=None, noise=0.0):
    c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    jitter = lambda: float(rng.normal(0, noise)) if noise else 0.0
    return [(c * x - s * y + dx + jitter(), s * x + c * y + dy + jitter()) for x, y in points]


def rows(frame, points, order=None):
    order = order or range(len(points))
    return [(frame, k, *points[i], 100.0 - i) for k, i in enumerate(order)]


def test_planted_moves(spark):
    rng = np.random.default_rng(4)
    plans = [(0.0, 1.0, 0.0, 0.0), (3.0, 1.0, 10.0, -4.0), (-179.7, 1.0, 0.0, 0.0), (120.0, 0.95, -200.0, 300.0), (0.5, 1.04, 2.0, 1.0), (45.0, 1.0, 0.0, 999.0)]
    data, pairs = [], []
    for k, (turn, size, dx, dy) in enumerate(plans):
        base = sky(rng)
        target, frame = 100 + k, k
        back = moved(base, turn, size, dx, dy)
        data += rows(frame, base) + rows(target, back, rng.permutation(len(back)).tolist())
        pairs.append((frame, target))
    found = {r.frame: r for r in registration.registered(spark.createDataFrame(pairs, "frame int, target int"), spark.createDataFrame(data, STARS)).collect()}
    for k, (turn, size, dx, dy) in enumerate(plans):
        r = found[k]
        assert abs((r.rotation - turn + 180) % 360 - 180) < 1e-6 and abs(r.scale - size) < 1e-9 and abs(r.dx - dx) < 1e-6 and abs(r.dy - dy) < 1e-6 and r.n == registration.STARS


def test_noise_strays_and_strangers(spark):
    """Noise of a tenth of a pixel and two strays of eight stars: within 0.1 pixel and 0.05 degree; another sky has no row."""
    rng = np.random.default_rng(11)
    data, pairs, want = [], [], {}
    for k in range(12):
        base, turn, dx, dy = sky(rng, 8), float(rng.uniform(-20, 20)), float(rng.uniform(-50, 50)), float(rng.uniform(-50, 50))
        seen = moved(base, turn, 1.0, dx, dy, rng, 0.1)
        seen[3], seen[6] = sky(rng, 2)
        data += rows(k, base) + rows(100 + k, seen)
        pairs.append((k, 100 + k))
        want[k] = (turn, dx, dy)
    data += rows(500, sky(rng)) + rows(501, sky(rng)) + [(502, 0, 1.0, 2.0, 5.0)] + rows(503, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)])
    pairs += [(500, 501), (502, 500), (503, 500), (504, 500)]
    found = {r.frame: r for r in registration.registered(spark.createDataFrame(pairs, "frame int, target int"), spark.createDataFrame(data, STARS)).collect()}
    assert set(found) == set(want)
    for k, (turn, dx, dy) in want.items():
        assert abs(found[k].rotation - turn) < 0.05 and abs(found[k].dx - dx) < 0.2 and abs(found[k].dy - dy) < 0.2 and found[k].n >= 6
    errors = [math.hypot(found[k].dx - dx, found[k].dy - dy) for k, (_, dx, dy) in want.items()]
    assert np.median(errors) < 0.1


def test_triangles_do_not_depend_on_the_frame(spark):
    """Shapes are the same after a turn and another scale, corner by corner."""
    base = sky(np.random.default_rng(2), 6)
    data = spark.createDataFrame(rows(1, base) + rows(2, moved(base, 77.0, 1.7, 5.0, -9.0)), STARS)
    shapes = registration.triangles(registration.kept(data)).collect()
    key = lambda r: (r.star_a, r.star_b, r.star_c)
    one, two = ({key(r): (r.short, r.middle) for r in shapes if r.frame == f} for f in (1, 2))
    assert set(one) == set(two) and len(one) > 5 and all(np.allclose(one[k], two[k]) for k in one)
