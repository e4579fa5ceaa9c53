"""Observatory tables read from the stored Parquet tables.

The stored tables are no sky data, so each observatory table is an explicit mapping of one of
them. ``VIEWS`` has the same mappings in SQL, for checks against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: table -> (stored table, columns in Spark SQL, columns in DuckDB SQL where they differ)
_K = "cast(get_json_object(props, '$.k') as int)"
_FRAME = {
    "id": ("event_id", None),
    "camera_id": ("cast(user_id % 8 as int)", None),
    "create_date": ("ts", None),
    "day_date": ("cast(ts - interval 12 hours as date)", None),
    "night": ("(hour(ts) < 6 or hour(ts) >= 18)", None),
    "exposure": ("value / 100", None),
    "elapsed": ("value / 50 + 1", None),
    "gain": (f"{_K} * 10", "cast(props->>'k' as int) * 10"),
    "binmode": (f"1 + {_K} % 2", "1 + cast(props->>'k' as int) % 2"),
    "adu": ("value", None),
    "sqm": ("15 + value / 100", None),
    "stars": (_K, "cast(props->>'k' as int)"),
    "kpindex": (f"if({_K} % 10 = 9, null, cast({_K} as double) / 10)", "case when cast(props->>'k' as int) % 10 = 9 then null else cast(props->>'k' as double) / 10 end"),
    "ovation_max": (f"{_K} % 30", "cast(props->>'k' as int) % 30"),
    "smoke_rating": (f"if({_K} % 7 = 6, null, {_K} % 4)", "case when cast(props->>'k' as int) % 7 = 6 then null else cast(props->>'k' as int) % 4 end"),
    "moonphase": (f"cast({_K} as double)", "cast(props->>'k' as double)"),
    "detections": (f"{_K} % 5", "cast(props->>'k' as int) % 5"),
    "exclude": ("event_type = 'error'", None),
    "event_type": ("event_type", None),
    "data": ("props", None),
    "file_size": ("cast(floor(value * 100) as bigint)", None),
    "filename": (f"if({_K} % 3 = 0, concat('/srv/frames/images/', event_id, '.jpg'), concat('ccd/', event_id, '.jpg'))", "case when cast(props->>'k' as int) % 3 = 0 then '/srv/frames/images/' || event_id || '.jpg' else 'ccd/' || event_id || '.jpg' end"),
    "remote_url": ("if(event_type = 'view', concat('https://cdn.example.org/', event_id, '.jpg'), null)", "case when event_type = 'view' then 'https://cdn.example.org/' || event_id || '.jpg' end"),
    "s3_key": ("if(event_type in ('view', 'purchase'), concat('frames/', event_id, '.jpg'), null)", "case when event_type in ('view', 'purchase') then 'frames/' || event_id || '.jpg' end"),
    "thumbnail_uuid": ("if(event_type = 'click', null, user_id)", "case when event_type = 'click' then null else user_id end"),
}
_CAMERA = {
    "id": ("cast(s_suppkey as int)", None),
    "name": ("s_name", None),
    "name_alt1": ("concat('cam-', s_suppkey)", "'cam-' || s_suppkey"),
    "name_alt2": ("if(s_suppkey % 2 = 0, upper(s_name), null)", "case when s_suppkey % 2 = 0 then upper(s_name) end"),
    "hidden": ("s_suppkey % 4 = 3", None),
    "latitude": ("s_acctbal / 200", None),
    "longitude": ("s_acctbal / 100", None),
    "utc_offset": ("cast((s_nationkey - 12) * 3600 as int)", None),
    "connect_date": ("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(s_nationkey as int))", "timestamp '2024-01-01 00:00:00' + to_days(s_nationkey)"),
    "daytime_save": ("s_suppkey % 3 = 0", None),
}
_THUMBNAIL = {"uuid": ("c_custkey", None), "camera_id": ("cast(c_custkey % 8 as int)", None), "width": ("cast(150 + c_nationkey as int)", None), "filename": ("concat('thumb/', c_custkey, '.jpg')", "'thumb/' || c_custkey || '.jpg'")}
_CALIBRATION = {
    "id": ("p_partkey", None),
    "camera_id": ("cast(p_partkey % 8 as int)", None),
    "bitdepth": ("if(p_partkey % 3 = 0, 8, 16)", "case when p_partkey % 3 = 0 then 8 else 16 end"),
    "binmode": ("cast(1 + p_partkey % 2 as int)", None),
    "gain": ("p_size * 20", None),
    "exposure": ("cast(floor((p_retailprice - 900) / 20) as int)", None),
    "temp": ("cast(p_partkey % 40 as double) - 10", None),
    "active": ("p_type <> 'SMALL'", None),
    "create_date": ("timestamp_ntz'2023-01-01 00:00:00' + make_interval(0, 0, 0, cast(p_partkey % 300 as int))", "timestamp '2023-01-01 00:00:00' + to_days(cast(p_partkey % 300 as int))"),
}
_VIDEO = {
    "id": ("o_orderkey", None),
    "camera_id": ("cast(o_custkey % 8 as int)", None),
    "day_date": ("cast(o_orderdate as date)", None),
    "day_year": ("if(o_orderkey % 5 = 0, null, cast(year(o_orderdate) as int))", "case when o_orderkey % 5 = 0 then null else cast(year(o_orderdate) as int) end"),
    "day_month": ("if(o_orderkey % 5 = 0, null, cast(month(o_orderdate) as int))", "case when o_orderkey % 5 = 0 then null else cast(month(o_orderdate) as int) end"),
    "night": ("o_orderkey % 2 = 0", None),
    "create_date": ("o_orderdate", None),
    "success": ("o_orderstatus <> 'P'", None),
    "uploaded": ("o_orderpriority = '1-URGENT'", None),
    "file_size": ("cast(floor(o_totalprice) as bigint)", None),
    "priority": ("if(o_orderpriority = '4-NOT SPECIFIED', null, cast(substring(o_orderpriority, 1, 1) as int))", "case when o_orderpriority = '4-NOT SPECIFIED' then null else cast(substring(o_orderpriority, 1, 1) as int) end"),
}
#: keogram, startrail, startrail video and panorama video rows of a night, and still assets
_ASSET = {
    "id": ("l_orderkey * 1000000 + l_partkey * 100 + l_linenumber", None),
    "kind": ("element_at(array('keogram', 'startrail', 'startrailvideo', 'panoramavideo', 'fitsimage', 'rawimage', 'panoramaimage'), l_linenumber)", "(['keogram', 'startrail', 'startrailvideo', 'panoramavideo', 'fitsimage', 'rawimage', 'panoramaimage'])[l_linenumber]"),
    "camera_id": ("cast(l_suppkey % 8 as int)", None),
    "day_date": ("cast(l_shipdate as date)", None),
    "night": ("l_returnflag <> 'N'", None),
    "create_date": ("l_shipdate", None),
    "frames": ("cast(l_quantity as int)", None),
    "success": ("l_linestatus = 'F'", None),
    "file_size": ("cast(floor(l_extendedprice) as bigint)", None),
    "uploaded": ("l_discount > 0.05", None),
}
TABLES = {"frames": ("events", _FRAME), "cameras": ("supplier", _CAMERA), "thumbnails": ("customer", _THUMBNAIL), "calibrations": ("part", _CALIBRATION), "videos": ("orders", _VIDEO), "assets": ("lineitem", _ASSET)}
#: The same tables for DuckDB, as a WITH clause.
VIEWS = "with " + ",\n".join(f"{name} as (select {', '.join(f'{duck or both} as {c}' for c, (both, duck) in columns.items())} from {stored})" for name, (stored, columns) in TABLES.items())


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An observatory table; columns that a query leaves out are never read."""
    source, columns = TABLES[name]
    return stored(spark, sf_dir, source).selectExpr(*[f"{both} as {c}" for c, (both, _) in columns.items()])
