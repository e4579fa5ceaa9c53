"""Joins (J1-J17)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in order; Spark keeps only the first of each partition before it shuffles."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("nth = 1").drop("nth")


def first_match_left(left: DataFrame, right: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Every left row with the first right row of its key, if any."""
    return left.join(first_per_key(right, by, order), by, "left")


def best_match(requests: DataFrame, library: DataFrame, equal: list[str], temp_range: float) -> DataFrame:
    """The calibration of each request.

    Equal keys must agree and gain and exposure be at least the requested ones. Of those within
    ``temp_range`` above the requested temperature the least gain, exposure and temperature and
    the newest wins; without one the rest compete, with the highest temperature first.
    ``requests``: id, the equal keys, gain, exposure, temp; ``library``: the same and create_date.
    """
    # of calibrations that agree in all that is compared only the newest can win: what is left grows with the settings, not with the library
    age = (-F.unix_micros(F.col("create_date").cast("timestamp"))).alias("age")
    newest = library.groupBy(*equal, "gain", "exposure", "temp").agg(F.min(F.struct(age, "id")).alias("first"))
    lib = newest.select(*equal, *[F.col(c).alias(f"cal_{c}") for c in ("gain", "exposure", "temp")], F.col("first.age").alias("cal_age"), F.col("first.id").alias("cal_id"))
    # frames share their settings, so each setting is looked up once
    setting = [*equal, "gain", "exposure", "temp"]
    met = requests.select(*setting).distinct().join(lib, equal).where((F.col("cal_gain") >= F.col("gain")) & (F.col("cal_exposure") >= F.col("exposure")))
    near = (F.col("cal_temp") >= F.col("temp")) & (F.col("cal_temp") <= F.col("temp") + temp_range)
    rank = F.struct(
        F.when(near, 0).otherwise(1).alias("tier"), F.col("cal_gain"), F.col("cal_exposure"), F.when(near, F.col("cal_temp")).otherwise(-F.col("cal_temp")).alias("t"), F.col("cal_age").alias("age"), F.col("cal_id")
    )
    # a minimum combines on the map side; a ranking window would sort all candidates
    best = met.groupBy(*setting).agg(F.min(rank).alias("best"))
    return requests.join(best, setting, "left").select(*requests.columns, F.col("best.cal_id").alias("calibration_id"), F.col("best.tier").alias("tier"))


def asof_neighbours(rows: DataFrame, wanted: Column, by: list[str], time: str, ident: str, most_seconds: int) -> DataFrame:
    """For each wanted row the last other row before and the first after it, at other times.

    Rows of equal time never pair. Partners lie within ``most_seconds``, so time is cut into
    slots of that length and other rows stand in their own slot and both beside it: a slot of
    a key is all that a task must sort, however many rows the key has.
    """
    own = F.floor(F.col(time) / most_seconds)
    slots = F.when(wanted, F.array(own)).otherwise(F.array(own - 1, own, own + 1))
    spread = rows.withColumns({"wanted": wanted, "slot": F.explode(slots)})
    other = F.when(~F.col("wanted"), F.struct(F.col(time).alias("t"), F.col(ident).alias("i")))
    # both frames run forward from the partition's start, the second in descending time
    past = Window.partitionBy(*by, "slot").orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    future = Window.partitionBy(*by, "slot").orderBy(F.desc(time)).rangeBetween(Window.unboundedPreceding, -1)
    found = spread.select(*by, "slot", time, ident, "wanted", F.max(other).over(past).alias("b"), F.min(other).over(future).alias("a"))
    inside = lambda s: F.when(F.abs(F.col(f"{s}.t") - F.col(time)) <= most_seconds, F.col(f"{s}.i"))
    return found.where("wanted").select(*by, ident, inside("b").alias("before"), inside("a").alias("after"))


def interval_join(targets: DataFrame, rows: DataFrame, by: list[str], time: str, before: int, after: int) -> DataFrame:
    """Rows within ``before`` and ``after`` seconds of a target, both ends closed.

    Time is cut into slots as long as the interval, a target names the two or three slots that
    it touches, and the slots join by equality: no comparison of every pair. ``targets``: target
    key columns with ``at``; seconds are whole.
    """
    width = before + after
    slot = lambda c: F.floor(c / width)
    spread = targets.withColumn("slot", F.explode(F.sequence(slot(F.col("at") - before), slot(F.col("at") + after))))
    return spread.join(rows.withColumn("slot", slot(F.col(time))), [*by, "slot"]).where((F.col(time) >= F.col("at") - before) & (F.col(time) <= F.col("at") + after)).drop("slot")


def capture_triplets(rows: DataFrame, seconds: int, roles: tuple[str, ...] = ("preceding", "bad", "following")) -> DataFrame:
    """Target, capture and the newest file of each role of the same capture within ``seconds``.

    ``rows``: id, camera_id, wanted, t (whole seconds), doc (JSON with a list ``roles`` of
    capture_id and role). A file may have several roles; the first names a wanted row's capture.
    """
    read = rows.withColumn("roles", F.from_json("doc", "roles array<struct<capture_id:string,role:string>>")["roles"])
    files = read.select("id", "camera_id", "t", F.explode("roles").alias("r")).select("id", "camera_id", "t", F.col("r.capture_id").alias("capture"), "r.role")
    targets = read.where("wanted").select(F.col("id").alias("target"), "camera_id", F.col("t").alias("at"), F.get("roles", F.lit(0))["capture_id"].alias("capture"))
    met = interval_join(targets, files, ["camera_id", "capture"], "t", seconds, seconds)
    return met.groupBy("target", "capture").agg(*[F.max(F.when(F.col("role") == r, F.col("id"))).alias(r) for r in roles])


def grid_lookup(points: DataFrame, grid: DataFrame, half_lon: int, half_lat: int) -> DataFrame:
    """Greatest and mean grid value in a box around each point; longitudes wrap at 360.

    ``points``: id, lon, lat (whole degrees); ``grid``: lon, lat, value.
    """
    around = points.select("id", F.explode(F.sequence(F.col("lon") - half_lon, F.col("lon") + half_lon)).alias("lon"), "lat").select("id", F.pmod("lon", F.lit(360)).alias("lon"), F.explode(F.sequence(F.col("lat") - half_lat, F.col("lat") + half_lat)).alias("lat"))
    return around.join(grid, ["lon", "lat"]).groupBy("id").agg(F.count("*").alias("cells"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value"))


def by_any_name(names: DataFrame, things: DataFrame, columns: list[str]) -> DataFrame:
    """Things by any of their names; several names of one thing match once.

    The names are exploded, so the join is one equality join.
    """
    exploded = things.select("id", F.explode(F.array_distinct(F.array_compact(F.array(*columns)))).alias("name"))
    return names.join(exploded, "name").distinct()


def nearest_in_cells(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...] = ()) -> DataFrame:
    """J13, first half: all pairs of points of one group at most ``radius`` apart, by cells of that size.

    ``left``: lid, lx, ly; ``right``: rid, rx, ry; both the columns ``by``, which must agree. A
    left point names the nine cells around it.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    near = F.array(*[F.struct((cell("lx") + i).alias("cx"), (cell("ly") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = left.withColumn("c", F.explode(near)).select(*by, "lid", "lx", "ly", "c.cx", "c.cy")
    b = right.select(*by, "rid", "rx", "ry", cell("rx").alias("cx"), cell("ry").alias("cy"))
    d = F.sqrt((F.col("lx") - F.col("rx")) ** 2 + (F.col("ly") - F.col("ry")) ** 2)
    return a.join(b, [*by, "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).select(*by, "lid", "rid", "distance")


def _one_pass(pairs: pd.DataFrame) -> pd.DataFrame:
    """The greedy choice among the pairs of one group, in order."""
    ordered = pairs.sort_values(["distance", "lid", "rid"])
    left, right, kept = set(), set(), []
    for i, a, b in zip(ordered.index, ordered["lid"], ordered["rid"], strict=True):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            kept.append(i)
    return ordered.loc[kept]


def greedy_pairs(pairs: DataFrame, by: tuple[str, ...] = (), rounds: int = 8, most: int = 500_000) -> DataFrame:
    """J13, second half: one partner each in a group, the closest pairs first, ties by lid, then rid.

    A pair that is the first of all pairs of both its ends is surely chosen; those are taken
    in each round and their ends leave, which gives what one ordered pass would. What is left
    after ``rounds`` rounds are chains that give way one pair at a time: groups with no more
    than ``most`` pairs left are settled by one pass each, larger ones by more rounds, however
    many it takes.
    """
    from starledger.sources.sinks import stored

    order, key = F.struct("distance", "lid", "rid"), list(by) or ["all"]
    pairs = pairs if by else pairs.withColumn("all", F.lit(0))
    columns = [*by, "lid", "rid", "distance"]
    left, taken, n = stored(pairs.select(*key, "lid", "rid", "distance"), "pairs"), None, 0
    while True:
        n += 1
        firsts = left.withColumn("o", order).withColumns({"l": F.min("o").over(Window.partitionBy(*key, "lid")), "r": F.min("o").over(Window.partitionBy(*key, "rid"))}).where("o = l and o = r")
        firsts = stored(firsts.select(*key, "lid", "rid", "distance"), "chosen")
        taken = firsts if taken is None else taken.union(firsts)
        left = stored(left.join(firsts.select(*key, "lid"), [*key, "lid"], "left_anti").join(firsts.select(*key, "rid"), [*key, "rid"], "left_anti"), "pairs")
        if left.isEmpty():
            return taken.select(*columns)
        if n >= rounds:
            sizes = left.groupBy(*key).count()
            few = left.join(sizes.where(F.col("count") <= most).select(*key), key, "left_semi").select(*key, "lid", "rid", "distance")
            taken = taken.union(stored(few.groupBy(*key).applyInPandas(_one_pass, few.schema), "chosen"))
            left = stored(left.join(sizes.where(F.col("count") > most).select(*key), key, "left_semi"), "pairs")
            if left.isEmpty():
                return taken.select(*columns)


def _by_places(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The greedy choice of one group from its places and the pairs of places.

    Points of a place are alike but for their ids, so at each distance a place gives its least
    ids first: the next point of all left places takes the least point of its right ones.
    """
    ids = {side: {(x, y): i.tolist() for x, y, i in zip(r["lx"], r["ly"], r["ids"], strict=True)} for side in "lr" for r in [rows[rows["kind"] == side]]}
    nth = {side: dict.fromkeys(ids[side], 0) for side in "lr"}
    met, out = rows[rows["kind"] == "pair"], []
    for distance, level in met.groupby("distance", sort=True):
        beside: dict = {}
        for a, b in zip(zip(level["lx"], level["ly"], strict=True), zip(level["rx"], level["ry"], strict=True), strict=True):
            beside.setdefault(a, []).append(b)
        heap = [(ids["l"][a][nth["l"][a]], a) for a in beside if nth["l"][a] < len(ids["l"][a])]
        heapq.heapify(heap)
        while heap:
            lid, a = heapq.heappop(heap)
            rights = [(ids["r"][b][nth["r"][b]], b) for b in beside[a] if nth["r"][b] < len(ids["r"][b])]
            if not rights:
                continue
            rid, b = min(rights)
            out.append((lid, rid, distance))
            nth["r"][b] += 1
            nth["l"][a] += 1
            if nth["l"][a] < len(ids["l"][a]):
                heapq.heappush(heap, (ids["l"][a][nth["l"][a]], a))
    found = pd.DataFrame(out, columns=["lid", "rid", "distance"])
    return found.assign(**{c: rows[c].iloc[0] for c in by})[[*by, "lid", "rid", "distance"]]


def greedy_match(left: DataFrame, right: DataFrame, radius: float, by: tuple[str, ...], most: int = 500_000) -> DataFrame:
    """``greedy_pairs`` of the points within ``radius``, by places: points at one place are never paired one by one.

    ``left``: lid, lx, ly; ``right``: rid, rx, ry; both the columns ``by``. Groups with more than
    ``most`` points and pairs of places go through ``greedy_pairs``.
    """
    from starledger.sources.sinks import stored

    key = list(by)
    place = lambda df, p: df.groupBy(*key, f"{p}x", f"{p}y").agg(F.array_sort(F.collect_list(f"{p}id")).alias("ids"))
    lefts, rights = stored(place(left, "l"), "places"), stored(place(right, "r"), "places")
    heads = lambda df, p: df.select(*key, F.struct(f"{p}x", f"{p}y").alias(f"{p}id"), f"{p}x", f"{p}y")
    met = nearest_in_cells(heads(lefts, "l"), heads(rights, "r"), radius, by)
    pairs = met.select(*key, F.lit("pair").alias("kind"), "lid.lx", "lid.ly", "rid.rx", "rid.ry", "distance")
    points = [df.select(*key, F.lit(p).alias("kind"), F.col(f"{p}x").alias("lx"), F.col(f"{p}y").alias("ly"), F.col(f"{p}x").alias("rx"), F.col(f"{p}y").alias("ry"), "ids") for df, p in ((lefts, "l"), (rights, "r"))]
    rows = stored(points[0].unionByName(points[1]).unionByName(pairs, allowMissingColumns=True), "met")
    size = rows.groupBy(*key).agg(F.sum(F.when(F.col("kind") == "pair", F.lit(1)).otherwise(F.size("ids"))).alias("size"))
    size = size.where(F.col("size") > most).select(*key)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select(*key, "lid").schema) + f", rid {right.schema['rid'].dataType.simpleString()}, distance double"
    settled = rows.join(size, key, "left_anti").groupBy(*key).applyInPandas(lambda g: _by_places(g, key), types)
    if size.isEmpty():
        return settled
    crowded = lambda df: df.join(size, key, "left_semi")
    return settled.unionByName(greedy_pairs(nearest_in_cells(crowded(left), crowded(right), radius, by), by))
