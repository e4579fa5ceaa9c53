"""Cases in which queries once differed from their SQL, or took work that grew faster than the input."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from starledger.plans import ORACLES, QUERIES

from .test_queries import rows

START = datetime.datetime(2024, 1, 1)


def folder(tmp_path, sf_dir, **tables):
    """A folder with the named tables as given and the others as stored, and DuckDB's view of it."""
    con = duckdb.connect()
    for t in ("events", "supplier", "part"):
        path = f"{sf_dir}/{t}.parquet"
        if t in tables:
            path = f"{tmp_path}/{t}.parquet"
            pq.write_table(tables[t], path)
        else:
            (tmp_path / f"{t}.parquet").symlink_to(path)
        con.sql(f"create view {t} as select * from read_parquet('{path}')")
    return str(tmp_path), con


def events(at, users=None, values=None, kinds=None):
    """Events at the given microseconds after ``START``."""
    n = len(at)
    return pa.table({
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array([START + datetime.timedelta(microseconds=t) for t in at], pa.timestamp("us")), "user_id": pa.array(users or [1] * n, pa.int64()),
        "event_type": ["view"] * n, "value": pa.array(values or [float(i % 200) for i in range(n)]), "props": [f'{{"k": {k}}}' for k in kinds or [i % 100 for i in range(n)]],
    })


@pytest.mark.parametrize("name", ["epoch_and_offset", "long_term_keogram"])
def test_fractions_of_a_second_round_as_in_the_sql(spark, sf_dir, tmp_path, name):
    """Halves go to the even second, and a frame half a second before the hour is the next hour's."""
    at = [0, 500_000, 1_500_000, 2_500_000, 3_499_999, 3_500_001, 3_599_400_000, 3_599_500_000, 3_599_999_999, 7_199_499_999, 7_199_700_000]
    sf, duck = folder(tmp_path, sf_dir, events=events(at))
    assert rows(QUERIES[name](spark, sf).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_entries_of_dense_fingerprints_are_never_broadcast(spark):
    """Hundreds of entries to a member: their table is small in files only."""
    from pyspark.sql import functions as F
    from starledger.llm import simhash
    from starledger.llm.common import stored

    flips = [F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id, {k}), 64) as int))") for k in (1, 2)]
    distinct = stored(spark.range(3000).select(F.xxhash64((F.col("id") / 300).cast("int")).bitwiseXOR(flips[0]).bitwiseXOR(flips[1]).alias("fp")).distinct(), "distinct")
    hot = stored(simhash.dense_halves(distinct, 8), "dense")
    assert not hot.isEmpty()
    index = simhash._index(distinct)
    keyed = index.select("fp", F.shiftleft("v", 6).bitwiseOR(F.col("slot").cast("bigint")).alias("key"))
    for df in (simhash._found(keyed, keyed), simhash._stars(stored(index.join(hot, ["slot", "v"], "left_semi"), "members"))):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()


def test_calibrations_of_one_setting_meet_the_requests_once(spark):
    """A library that has each setting many times is reduced to the newest of each before it is joined."""
    from pyspark.sql import functions as F
    from starledger.operators import joins

    lib = spark.range(20_000).select("id", F.lit(1).alias("k"), (F.col("id") % 2).alias("gain"), F.lit(1).alias("exposure"), F.lit(0.0).alias("temp"), F.timestamp_seconds(F.col("id") % 700).alias("create_date"))
    req = spark.range(3).select("id", F.lit(1).alias("k"), F.lit(0).alias("gain"), F.lit(1).alias("exposure"), F.lit(0.0).alias("temp"))
    got = joins.best_match(req, lib, ["k"], 5.0)
    assert {tuple(r)[-2:] for r in got.collect()} == {(698, 0)}  # of gain 0 the newest, and of those the least id
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(age" in plan[plan.rindex("Join Inner") :]


def test_exposures_hold_few_rows_as_objects(spark, tmp_path, monkeypatch):
    """The controller goes through a camera's rows in parts; over two files it goes on from its state."""
    from starledger.operators import ordering
    from starledger.streaming import live

    monkeypatch.setattr(live, "STEP_ROWS", 7)
    values = [float(v) for v in (150, 80, 95, 95, 95, 95, 95, 95, 150, 60, 75, 90, 200, 74, 76)] * 2
    (tmp_path / "events.parquet").mkdir()
    for i, rs in enumerate((range(16), range(16, 30))):
        pq.write_table(events([r * 10**6 for r in rs], values=[values[r] for r in rs]).set_column(0, "event_id", pa.array(list(rs)[::-1], pa.int64())), tmp_path / f"events.parquet/{i}.parquet")
    machine = ordering.Exposure()
    want = [machine.step(v) for v in values]
    got = {r.id: (r.found, r.exposure) for r in live.drained(live.exposures(live.frames(spark, str(tmp_path)))).collect()}
    at = [*range(15, -1, -1), *range(29, 15, -1)]
    assert [got[i] for i in at] == want


@pytest.mark.parametrize("most", [500_000, 100])
def test_points_of_one_place_match_as_in_one_ordered_pass(spark, most):
    """Sixty points a place: pairs of places are found, not of points, and ties go by ids."""
    from starledger.operators import joins

    points = [(g, i, (i * 7 + g) % 10, (i * 3) % 10) for g in range(2) for i in range(g * 1000, g * 1000 + 400)]
    side = lambda k, p: spark.createDataFrame([x for x in points if x[1] % 2 == k], f"g int, {p}id bigint, {p}x bigint, {p}y bigint")
    near = ((a, b, (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) for a in points for b in points if a[0] == b[0] and a[1] % 2 == 0 and b[1] % 2)
    left, right, want = set(), set(), set()
    for _, a, b in sorted((d, a[1], b[1]) for a, b, d in near if d <= 9):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    got = joins.greedy_match(side(0, "l"), side(1, "r"), 3.0, ("g",), most=most)
    assert {(r.lid, r.rid) for r in got.collect()} == want and want
