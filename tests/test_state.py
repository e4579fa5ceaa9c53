"""Operators that no SQL expresses, against plain replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starledger.operators import dml, frames, joins, kernels, ordering, polygons, rollups, secondary
from starledger.plans import QUERIES
from starledger.sources import feeds, sinks, tables


def ordered(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "frames").select("id", "camera_id", "create_date", "adu", "exposure", "file_size").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.create_date, r.id)):
        by.setdefault(r.camera_id, []).append(r)
    return by


def replay(values, target=75.0, exposure=1.0):
    """The controller's rules written out: found by one value, lost by the mean of six."""
    found, level, history, out = False, None, [], []
    for adu in values:
        adu = 0.1 if adu <= 0 else adu
        deviation, scale = (20, 0.5) if exposure < 0.001 else (10, 1.0)
        if found:
            history.append(adu)
            last = history[-6:]
            if len(last) == 6 and not level - deviation <= sum(last) / 6 <= level + deviation:
                found = False
        elif target - deviation <= adu <= target + deviation:
            found, level, history = True, adu, []
        else:
            exposure = exposure - (exposure - exposure * (target / adu)) * scale
            exposure = min(max(exposure, 1e-5), 60.0)
        out.append((found, exposure))
    return out


def test_exposure_by_hand():
    m = ordering.Exposure(exposure=1.0)
    got = [m.step(v) for v in (150.0, 80.0, 95.0, 95.0, 95.0, 95.0, 95.0, 95.0, 150.0)]
    # twice too bright halves the exposure; 80 finds; six values of mean 95 lose it; then 150 halves again
    assert got[0] == (False, 0.5) and got[1] == (True, 0.5) and [f for f, _ in got[2:7]] == [True] * 5
    assert got[7] == (False, 0.5) and got[8] == (False, 0.25)


def test_exposure_states(spark, sf_dir):
    want = {}
    for rows in ordered(spark, sf_dir).values():
        for r, (found, exposure) in zip(rows, replay([r.adu for r in rows]), strict=True):
            want[r.id] = (found, round(exposure, 8))
    for name in ("exposure_states", "stream_exposures"):
        got = {r.id: (r.found, r.exposure) for r in QUERIES[name](spark, sf_dir).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == f and abs(got[i][1] - e) < 1e-7 for i, (f, e) in want.items())
    assert {f for f, _ in want.values()} == {True, False}


STREAMS = {"stream_night_rollup", "stream_15min", "stream_sliding", "stream_history", "stream_sessions", "stream_buffer", "stream_exposures", "stream_notifications", "stream_fresh", "stream_dedup"}


@pytest.fixture(scope="module")
def many_files(spark, sf_dir, tmp_path_factory):
    """The frames in three files in order of time, each a micro-batch of its own."""
    folder = tmp_path_factory.mktemp("many")
    events = tables.stored(spark, sf_dir, "events").orderBy("ts", "event_id").toPandas()
    (folder / "events.parquet").mkdir()
    import pyarrow as pa
    import pyarrow.parquet as pq

    whole = pa.Table.from_pandas(events, preserve_index=False).cast(pq.read_schema(f"{sf_dir}/events.parquet").remove_metadata())
    for i in range(3):
        lo, hi = len(events) * i // 3, len(events) * (i + 1) // 3
        pq.write_table(whole.slice(lo, hi - lo), folder / "events.parquet" / f"part-{i}.parquet")
    return f"{folder}"


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_streams_over_many_batches(spark, sf_dir, many_files, name):
    rows = lambda d: sorted(repr(tuple(r)) for r in QUERIES[name](spark, d).collect())
    assert rows(many_files) == rows(sf_dir)


def test_gate_keeps_outliers_out(spark, sf_dir):
    want = {}
    for rows in ordered(spark, sf_dir).values():
        taken = []
        for r in rows:
            ok = len(taken) < 15 or abs(r.adu - np.mean(taken)) <= 3 * np.std(taken) + 1e-9
            want[r.id] = bool(ok)
            if ok:
                taken.append(r.adu)
    got = {r.id: r.taken for r in QUERIES["rotation_gate"](spark, sf_dir).collect()}
    assert got == want
    assert not all(want.values())


def test_stream_notifications_as_batch(spark, sf_dir):
    assert {r.id for r in QUERIES["stream_notifications"](spark, sf_dir).collect()} == {r.id for r in QUERIES["notification_dedup"](spark, sf_dir).collect()}


def test_budget(spark, sf_dir):
    want = set()
    for rows in ordered(spark, sf_dir).values():
        files, size, seeds = 20, 100_000, []
        newest = sorted(rows, key=lambda r: (-r.create_date.timestamp(), r.id))
        for r in newest:
            if len(seeds) < 3 and not any(abs(r.exposure - s.exposure) <= 0.05 * max(abs(r.exposure), abs(s.exposure)) for s in seeds):
                seeds.append(r)
        for r in [*seeds, *[r for r in newest if r not in seeds]]:
            if files and r.file_size <= size:
                files, size = files - 1, size - r.file_size
                want.add(r.id)
    assert {r.id for r in QUERIES["budget_selection"](spark, sf_dir).collect()} == want


def test_fisheye_turns_the_cameras_azimuth_up(spark):
    from starledger.functions import sky

    at = lambda alt, az: spark.range(1).select(*[c.alias(n) for n, c in sky.fisheye(F.lit(alt), F.lit(az), 1000.0, 1000.0, 560.0, 30.0).items()]).first()
    assert np.allclose(at(90.0, 123.0), (1000, 560)) and np.allclose(at(0.0, 30.0), (1000, 60)) and np.allclose(at(0.0, 120.0), (500, 560))
    assert abs(560 - at(45.0, 30.0).y - 500 * np.sin(np.radians(22.5)) / np.sin(np.radians(45))) < 1e-9


def test_hot_camera_is_cut_by_day(spark, sf_dir):
    """One camera with all rows: windows that ran over it are as they were, in tasks of a day each."""
    rows = tables.table(spark, sf_dir, "frames").withColumn("camera_id", F.lit(1))
    w = ordering.Window.partitionBy("camera_id").orderBy("create_date", "id")
    got = ordering.placed(rows, ["camera_id"], [F.to_date("create_date")], [F.col("create_date"), F.col("id")])
    want = rows.withColumn("at", F.row_number().over(w))
    pick = lambda d, c: {r.id: r[c] for r in d.select("id", c).collect()}
    assert pick(got, "at") == pick(want, "at")
    reading = F.when(F.col("stars") % 40 == 0, F.col("adu"))
    assert pick(ordering.held(rows, reading), "reading") == pick(rows.withColumn("reading", F.last(reading, ignorenulls=True).over(w.rowsBetween(ordering.Window.unboundedPreceding, 0))), "reading")
    plain = rows.withColumn("run", F.sum(F.col("exclude").cast("int")).over(w)).withColumn("n", F.count("*").over(ordering.Window.partitionBy("run").orderBy("create_date", "id")))
    means = pick(ordering.moving_average(rows, "adu", F.col("exclude")), "mean")
    assert all((means[r.id] is not None) == (r.n >= 6) for r in plain.collect())


def test_greedy_pairs_is_one_ordered_pass(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({(float(d), int(a), int(b)) for d, a, b in zip(rng.integers(1, 20, 300), rng.integers(0, 60, 300), rng.integers(0, 60, 300), strict=True)})
    left, right, want = set(), set(), set()
    for d, a, b in pairs:
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b, d))
    got = joins.greedy_pairs(spark.createDataFrame([(a, b, d) for d, a, b in pairs], "lid bigint, rid bigint, distance double"))
    assert {tuple(r) for r in got.collect()} == want


def test_greedy_pairs_of_a_long_chain(spark):
    """Distances that rise along a chain settle one pair a round: the rest is one pass, or more rounds where it is too long for one."""
    chain = spark.range(5000).selectExpr("id div 2 + id % 2 as lid", "id div 2 as rid", "cast(id as double) as distance")
    assert {(r.lid, r.rid) for r in joins.greedy_pairs(chain).collect()} == {(k, k) for k in range(2500)}
    short = chain.where("distance < 24").withColumn("g", F.lit("x"))
    assert {(r.g, r.lid, r.rid) for r in joins.greedy_pairs(short, by=("g",), rounds=1, most=4).collect()} == {("x", k, k) for k in range(12)}


def test_star_match_takes_every_frame_of_a_day(spark):
    sf_dir, groups = "/root/testdata/sf0.01", {}  # in sf0.001 a camera's day has four frames
    for r in tables.table(spark, sf_dir, "frames").select("id", "camera_id", "day_date").collect():
        groups.setdefault((r.camera_id, r.day_date), []).append(r.id)
    want, pairs = set(), 0
    apart = lambda a, b: (a * 37 % 1000 - b * 37 % 1000) ** 2 + (a * 91 % 1000 - b * 91 % 1000) ** 2
    for ids in groups.values():
        found = sorted((d, a, b) for a in ids if a % 2 == 0 for b in ids if b % 2 and (d := apart(a, b)) <= 1600)
        left, right = set(), set()
        pairs += len(found)
        for _, a, b in found:
            if a not in left and b not in right:
                left.add(a), right.add(b), want.add((a, b))
    assert max(a for a, _ in want) >= 400
    assert {(r.lid, r.rid) for r in QUERIES["star_match"](spark, sf_dir).collect()} == want
    assert sum(r.pairs for r in QUERIES["star_match_candidates_all"](spark, sf_dir).collect()) == pairs


def test_smoke_is_worst_that_meets(spark):
    hexagon = [(2 * np.cos(k * np.pi / 3), 2 * np.sin(k * np.pi / 3)) for k in range(6)]
    rng = np.random.default_rng(0)
    boxes = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-4, 4, (200, 2)))]

    def meets(x, y):  # dense points of the box against the half planes, with a margin
        g = np.stack(np.meshgrid(np.linspace(x - 0.5, x + 0.5, 101), np.linspace(y - 0.5, y + 0.5, 101)), -1).reshape(-1, 2)
        inside = np.ones(len(g), bool)
        for (ax, ay), (bx, by) in zip(hexagon, hexagon[1:] + hexagon[:1], strict=True):
            inside &= (bx - ax) * (g[:, 1] - ay) - (by - ay) * (g[:, 0] - ax) >= -1e-9
        return bool(inside.any())

    shapes = spark.createDataFrame([(0, [[(float(x), float(y)) for x, y in hexagon]])], "polygon int, rings array<array<struct<x:double,y:double>>>")
    df = spark.createDataFrame([(i, x - 0.5, y - 0.5, x + 0.5, y + 0.5) for i, x, y in boxes], "id int, left double, low double, right double, high double")
    got = {r.id for r in polygons.boxes_meet(df, shapes, 2.0).collect()}
    wrong = [i for i, x, y in boxes if (i in got) != meets(x, y)]
    assert len(wrong) <= 2  # the grid of points may miss a touching corner


def test_two_means_parts_two_clouds(spark):
    rng = np.random.default_rng(3)
    pts = np.exp(np.concatenate((rng.normal(0, 0.1, (200, 2)), rng.normal(2, 0.1, (100, 2)))))
    low, high = rollups.two_means(spark.createDataFrame(pts.tolist(), "a double, b double"), ["a", "b"])
    assert abs(np.log(low["a"])) < 0.1 and abs(np.log(high["a"]) - 2) < 0.1


def test_adaptive_stretch_is_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(10, 120, (8, 8))
    px = spark.createDataFrame([(0, 0, y, x, int(a[y, x])) for y in range(8) for x in range(8)], "frame bigint, stack int, y int, x int, v int")
    got = {(r.y, r.x): r.v for r in frames.adaptive_midtones(px).collect()}
    x = a / 255
    s = x[::2, ::2]
    med = np.median(s)
    shadow = np.clip(med - 2.8 * np.median(np.abs(s - med)) * 1.4826, 0, 1)
    mtf = lambda v, m: (m - 1) * v / ((2 * m - 1) * v - m)
    m = mtf(med - shadow, 0.25)
    want = np.floor(mtf(np.maximum((x - shadow) / (1 - shadow), 0), m) * 255)
    assert all(abs(got[y, c] - want[y, c]) <= 1 for y in range(8) for c in range(8))


def test_kernels():
    a = np.full((16, 16), 12.0)
    a[4:6, 9:11] = 200.0
    assert kernels.blobs(a) == [(9.5, 4.5, 4 * 188.0)]
    assert kernels.shift_between(np.random.default_rng(0).random((16, 16)), np.roll(np.random.default_rng(0).random((16, 16)), (3, -2), (0, 1))) == (3, -2)
    assert kernels.median_filter(a)[0, 0] == 12 and kernels.debayer(a).shape == (16, 16, 3)
    assert kernels.protection_mask(a, 1.0, 1).shape == a.shape
    assert np.allclose(kernels.gaussian_filter(np.full((8, 8), 5.0)), 5.0)


def test_blobs_over_a_gradient():
    a = np.add.outer(np.linspace(0, 400, 64), np.linspace(0, 300, 64))
    a[10:13, 40:43] += 150
    a[50, 20] += 150
    got = kernels.blobs(a, mesh=8, least=60.0)
    assert sorted((round(x), round(y)) for x, y, _ in got) == [(20, 50), (41, 11)]
    assert [(round(x), round(y)) for x, y, _ in kernels.blobs(a, mesh=8, least=60.0, area=4)] == [(41, 11)]


def test_template_hits_by_plain_loops():
    rng = np.random.default_rng(12)
    disc = np.array([[0.0, 1.0, 0.0], [1.0, 2.0, 1.0], [0.0, 1.0, 0.0]])
    for _ in range(20):
        a = rng.integers(0, 100, (9, 9)).astype(float)
        want = []
        for y in range(7):
            for x in range(7):
                score = np.corrcoef(a[y : y + 3, x : x + 3].ravel(), disc.ravel())[0, 1]
                if score >= 0.6 and all((x - p) ** 2 + (y - q) ** 2 > 4 for p, q, _ in want):
                    want.append((x, y, score))
        got = kernels.template_hits(a, disc)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_every_line_with_the_votes_is_given():
    assert kernels.lines(np.full((20, 20), 7.0), 5, 10, 8) == [] and kernels.lines(np.random.default_rng(1).normal(0, 1, (30, 30)), 5, 10, 8) == []
    a = np.zeros((40, 40))
    a[:, 10:] += 100  # an upright edge
    found = kernels.lines(a, 20, 40, 20)
    assert len(found) == 1 and found[0][0] == 0.0 and abs(found[0][1] - 10) <= 1
    b = a.copy()
    b[25:, :] += 100  # and one across it
    angles = sorted(x[0] for x in kernels.lines(b, 20, 40, 15))
    assert angles == [0.0, 90.0]
    c = np.add.outer(np.arange(40), np.arange(40)) > 40
    assert any(abs(x[0] - 45) <= 5 for x in kernels.lines(c * 100.0, 20, 40, 15))


def test_holes_are_filled_in_row_order():
    a = np.arange(36.0).reshape(6, 6)
    holes = np.zeros((6, 6), bool)
    holes[3, 3] = holes[3, 5] = holes[0, 0] = True
    got = kernels.filled(a, holes)
    assert got[3, 3] == max(a[1, 3], a[3, 1]) and got[3, 5] == max(a[1, 5], got[3, 3]) and got[0, 0] == max(a[2, 0], a[0, 2])
    assert (kernels.filled(a, holes, most=2) == a).all()


def test_wavelets_keep_what_is_not_noise():
    rng = np.random.default_rng(4)
    flat = np.full((16, 16), 50.0)
    flat[4:8, 4:8] = 90
    noisy = flat + rng.normal(0, 2, flat.shape)
    got = kernels.wavelet_denoise(noisy)
    assert np.abs(got - flat).mean() < 0.6 * np.abs(noisy - flat).mean()
    assert np.allclose(kernels.wavelet_denoise(noisy, factor=0.0), noisy) and kernels.wavelet_denoise(np.ones((3, 3))).tolist() == np.ones((3, 3)).tolist()


def test_wavelets_by_plain_transform(spark):
    """Each coefficient by its own dot product with the Haar functions of two levels."""
    a = np.random.default_rng(6).normal(100, 20, (8, 8))
    basis = []
    for n in (2, 4):
        half, block = np.ones(n) / n**0.5, np.concatenate([np.ones(n // 2), -np.ones(n // 2)]) / n**0.5
        for i in range(0, 8, n):
            for j in range(0, 8, n):
                for k, (u, v) in enumerate(((half, block), (block, half), (block, block))):
                    f = np.zeros((8, 8))
                    f[i : i + n, j : j + n] = np.outer(u, v)
                    basis.append((n, k, f))
    finest = [abs((a * f).sum()) for n, k, f in basis if n == 2 and k == 2]
    limit = np.median(finest) / 0.6745 * np.sqrt(2 * np.log(64))
    want = np.kron(a.reshape(2, 4, 2, 4).mean(axis=(1, 3)), np.ones((4, 4)))
    for _, _, f in basis:
        c = (a * f).sum()
        want = want + np.sign(c) * max(abs(c) - limit, 0) * f
    assert np.allclose(kernels.wavelet_denoise(a), want)


def test_best_match_falls_back_and_breaks_ties(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    lib = spark.sql(f"select * from values (1, 7, 100, 5, 30.0, {at}), (2, 7, 100, 5, 12.0, {at}), (3, 7, 100, 5, 12.0, {at} + interval 1 day), (4, 8, 50, 5, 40.0, {at}) as t(id, k, gain, exposure, temp, create_date)")
    req = spark.createDataFrame([(10, 7, 90, 3, 10.0), (11, 8, 50, 5, 0.0), (12, 9, 1, 1, 1.0), (13, 7, 200, 1, 1.0)], "id int, k int, gain int, exposure int, temp double")
    got = {r.id: (r.calibration_id, r.tier) for r in joins.best_match(req, lib, ["k"], 5.0).collect()}
    assert got == {10: (3, 0), 11: (4, 1), 12: (None, None), 13: (None, None)}


def test_asof_ignores_equal_times_and_far_rows(spark):
    rows = spark.createDataFrame([("a", 80, False), ("b", 100, True), ("c", 100, False), ("d", 120, False), ("e", 500, True)], "i string, t bigint, bad boolean").withColumn("k", F.lit(1))
    got = {r.i: (r.before, r.after) for r in joins.asof_neighbours(rows, F.col("bad"), ["k"], "t", "i", 90).collect()}
    assert got == {"b": ("a", "d"), "e": (None, None)}


def test_polygons_of_any_xml(spark):
    folder = "<Folder id='f'><name><![CDATA[Smoke (Heavy) & more]]></name>{}</Folder>"
    placemark = "<Placemark x='1'><Polygon><outerBoundaryIs><LinearRing><coordinates>\n 1,2,0\n 3,4,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
    docs = [(1, f"<?xml version='1.0'?><kml xmlns='http://www.opengis.net/kml/2.2'><Document>{folder.format(placemark * 2)}{folder.format('')}</Document></kml>"), (2, "no xml"), (3, None), (4, "<kml><Document/></kml>")]
    got = feeds.kml_rings(spark.createDataFrame(docs, "id int, kml string")).collect()
    assert [(r.id, r.folder, [tuple(p) for p in r.ring]) for r in got] == [(1, "Smoke (Heavy) & more", [(1.0, 2.0), (3.0, 4.0)])] * 2


def test_elements_of_a_bad_group_are_all_left_out(spark):
    good = ["TITLE", "1 ".ljust(69, "x"), "2 ".ljust(69, "x")]
    rows = [("a", i, v) for i, v in enumerate(good)] + [("b", i, v) for i, v in enumerate([*good, "T", "1 short", "2 ".ljust(69, "x")])]
    got = feeds.element_records(spark.createDataFrame(rows, "grp string, line int, value string")).collect()
    assert [r.grp for r in got] == ["a"]


def test_fits_records(spark, tmp_path):
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    head = "".join([card("SIMPLE", "T"), card("BITPIX", 16), card("NAXIS1", 2), card("NAXIS2", 2), card("EXPTIME", 1.5), card("GAIN", 100), "END".ljust(80)]).ljust(2880)
    (tmp_path / "good.fit").write_bytes(head.encode() + np.array([1, 2, 3, 4], ">i2").tobytes())
    (tmp_path / "bad.fit").write_bytes(b"no frame")
    (tmp_path / "empty.fit").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in feeds.fits_records(feeds.binary_files(spark, str(tmp_path), "*.fit")).collect()}
    assert set(got) == {"good.fit", "bad.fit"}
    assert got["good.fit"].median == 2.5 and got["good.fit"].exposure == 1.5 and got["bad.fit"].error


def test_sinks(spark, tmp_path, sf_dir):
    df = tables.table(spark, sf_dir, "frames").select("id", "camera_id", "day_date", "create_date", "adu")
    sinks.append_rows(df.where("id < 50"), str(tmp_path / "t"))
    sinks.append_rows(df.where("id >= 50"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == df.count()
    sinks.status_json(df.groupBy("camera_id").count(), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 8
    sinks.snapshot(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == df.count()


def test_empty_and_single_groups(spark, sf_dir):
    none = tables.table(spark, sf_dir, "frames").where("id < 0")
    assert rollups.night_rollup_defaults(none).count() == 0
    assert rollups.robust(none, ["camera_id"], "adu").count() == 0
    one = tables.table(spark, sf_dir, "frames").where("id = 5")
    r = rollups.robust(one, ["camera_id"], "adu").first()
    assert r.mad == 0 and r.median == r.trimmed_median
    assert dml.suppressed(none.withColumn("t", F.lit(1).cast("bigint")), ["camera_id"], "t", 10).count() == 0
    assert secondary.within_budget(none, 5, 5, 2, 0.1).count() == 0


@pytest.mark.parametrize("late", [False, True])
def test_all_or_defaults_with_null(spark, late):
    df = spark.createDataFrame([(1, 2.0, None if late else 3)], "id int, kpindex double, smoke_rating int")
    from starledger.operators.filters import all_or_defaults

    r = df.select(*all_or_defaults({"kpindex": 0.0, "smoke_rating": -1})).first()
    assert tuple(r) == ((0.0, -1) if late else (2.0, 3))


def test_lens_fit_finds_the_parameters(spark, sf_dir):
    from starledger.plans.arrays import LENSES

    got = {r.frame: r for r in QUERIES["lens_fit"](spark, sf_dir).collect()}
    for i, (azimuth, lat, lon, diameter, ox, oy, mirror) in enumerate(LENSES):
        r = got[i]
        if mirror:
            assert not r.success and r.reason == "chirality_mismatch"
            continue
        assert r.success and r.matched >= 40 and r.rms < 2
        assert abs(r.azimuth - azimuth) < 0.5 and abs(r.latitude_offset - lat) < 1 and abs(r.longitude_offset - lon) < 1
        assert abs(r.diameter - diameter) < 0.01 * diameter and abs(r.offset_x - ox) < 8 and abs(r.offset_y - oy) < 8


def test_noise_is_no_fit(spark):
    from starledger.operators import lens

    rng = np.random.default_rng(9)
    frames_ = spark.createDataFrame([(i, 40.0, -75.0, 1.77e9, 1920, 1920, 1700.0) for i in (0, 1)], "frame bigint, latitude double, longitude double, epoch double, width int, height int, diameter double")
    stars = spark.createDataFrame([(i, float(a), float(z)) for i, (a, z) in enumerate(zip(rng.uniform(0, 360, 80), rng.uniform(-30, 80, 80), strict=True))], "star bigint, ra double, dec double")
    noise = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1920, (60, 2)))], "frame bigint, rid bigint, rx double, ry double")
    got = {r.frame: r for r in lens.solve(frames_, stars, noise).collect()}
    assert not got[0].success and not got[1].success and got[1].reason == "too_few_matches"


def test_repair():
    from starledger.operators.repair import repaired

    a = np.full((4, 4), 20_000.0)
    assert (repaired(a, (2.0, 2.0, 2.0, 2.0), 60_000) == 10_000).all()
    a[0, 1] = 61_000  # a clipped first green below its neighbours stays, above it is lifted
    a[1::2, 0::2] = 50_000
    assert repaired(a, (2.0, 4.0, 2.0, 2.0), 60_000)[0, 1] == 25_000
    a[:] = 65_535
    out = repaired(a, (1.0, 2.0, 2.0, 1.0), 60_000)
    assert (out == 65_535).all()


def test_unknown_strategy_is_told():
    from starledger.operators import strategies

    with pytest.raises(ValueError, match="average"):
        strategies.named(strategies.STACKS, "none")


def test_every_frame_asks_for_a_calibration(spark, sf_dir):
    ids = {r.id for r in tables.table(spark, sf_dir, "frames").select("id").collect()}
    got = {r.id: (r.calibration_id, r.tier) for r in QUERIES["best_calibration_all"](spark, sf_dir).collect()}
    assert got.keys() == ids
    assert all(got[r.id] == (r.calibration_id, r.tier) for r in QUERIES["best_calibration"](spark, sf_dir).collect())


def test_every_frame_star_and_column_counts(spark, sf_dir, tmp_path):
    frames = QUERIES["geometry_all"](spark, sf_dir).groupBy("frame").count().collect()
    assert len(frames) == tables.stored(spark, sf_dir, "embeddings").count() and {r["count"] for r in frames} == {3 * 64 + 20}
    nation = tables.stored(spark, sf_dir, "nation")
    nation.union(nation.withColumn("n_nationkey", (F.col("n_nationkey") + 25).cast(nation.schema["n_nationkey"].dataType))).write.parquet(f"{tmp_path}/nation.parquet")
    tables.stored(spark, sf_dir, "supplier").write.parquet(f"{tmp_path}/supplier.parquet")
    for name in ("star_projection", "star_projection_all"):
        assert max(r.star for r in QUERIES[name](spark, str(tmp_path)).collect()) >= 25
    want = {r.camera_id: min(r["count"], 1000) for r in tables.table(spark, sf_dir, "frames").groupBy("camera_id").count().collect()}
    assert {r.camera_id: len(r.ids) for r in QUERIES["stream_buffer_1000"](spark, sf_dir).collect()} == want and max(want.values()) > 100
