"""Nested values, table functions, sketched profiles, the paged table and the table of progress."""

import datetime
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from rillwood.functions import tables
from rillwood.operators import nested as N
from rillwood.operators import profile as P
from rillwood.sources import paged
from rillwood.streaming import listener
from rillwood.streaming.versions import StreamingProfile

# -- nested values -----------------------------------------------------------------------------------------------------


def test_paths_of_types():
    text = "OBJECT<a: BIGINT, `b c`: OBJECT<x: DECIMAL(3,1), `y>z`: ARRAY<OBJECT<q: STRING>>>, m: VARIANT, n: VOID>"
    assert N.paths_of(text) == {"a": "BIGINT", "b c.x": "DECIMAL(3,1)", "b c.y>z": "ARRAY<OBJECT<q: STRING>>", "m": "VARIANT", "n": "VOID"}
    assert N.paths_of("BIGINT") == {} and N.paths_of(None) == {} and N.paths_of("OBJECT<>") == {}


def test_columns_by_path(spark):
    rows = [(1, '{"a": 1, "b": {"c": "x", "d": [1, 2]}, "m": 1}'), (2, '{"a": null, "b": {"c": "y"}, "m": "word", "e": true}'), (3, "no json"), (4, None), (5, '{"b": 7, "a": 5}')]
    df = spark.createDataFrame(rows, "id long, j string").select("id", N.variant(F.col("j")).alias("v"))
    types = N.path_types(df.filter("id < 5"), F.col("v"))
    assert types == {"a": "BIGINT", "b.c": "STRING", "b.d": "ARRAY<BIGINT>", "e": "BOOLEAN", "m": "VARIANT"}
    got = N.by_paths(df, F.col("v"), types).select("id", "a", "`b.c`", F.to_json("`b.d`").alias("d"), F.to_json("m").alias("m"), "e").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1, "x", "[1,2]", "1", None), (2, None, "y", None, '"word"', True), (3, None, None, None, None, None), (4, None, None, None, None, None), (5, 5, None, None, None, None)]
    assert N.path_types(df, F.col("v"))["b"] == "VARIANT"  # an object here, a number there
    assert N.by_paths(df.filter("false"), F.col("v")).columns == ["id", "v"]


# -- table functions ---------------------------------------------------------------------------------------------------


def test_columns_follow_the_call(spark):
    tables.register(spark)
    spark.createDataFrame([(1, datetime.datetime(2024, 2, 29, 5, 6, 7)), (2, None)], "id long, ts timestamp").createOrReplaceTempView("_dates")
    got = spark.sql("SELECT id, d.* FROM _dates, LATERAL date_entries(ts, 'quarter,yearday, hour') AS d ORDER BY id")
    assert got.columns == ["id", "quarter", "yearday", "hour"] and [tuple(r) for r in got.collect()] == [(1, 1, 60, 5), (2, None, None, None)]
    got = spark.sql("SELECT id, e.* FROM _dates, LATERAL entries('x,y', id, ts) AS e ORDER BY id, name").collect()
    assert [tuple(r) for r in got] == [(1, "x", "1", 1.0), (1, "y", "2024-02-29 05:06:07", None), (2, "x", "2", 2.0)]
    for wrong in ("date_entries(ts, 'era')", "date_entries(ts, CAST(id AS STRING))", "entries('x', id, ts)"):
        with pytest.raises(Exception, match="parts|constant|name for each"):
            spark.sql(f"SELECT * FROM _dates, LATERAL {wrong}").collect()


# -- sketched profiles -------------------------------------------------------------------------------------------------


def test_sketches_add_up(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("many"), (F.col("id") % 7).cast("string").alias("few"), F.when(F.col("id") < 0, 1).alias("none"))
    parts = [P.sketched_profile(df.filter(F.col("many") % 3 == k), df.columns) for k in range(3)]
    merged = {r.name: r for r in P.sketched_distinct(P.merge_sketched(parts[0].unionByName(parts[1]).unionByName(parts[2]))).collect()}
    assert (merged["few"].n, merged["few"].n_distinct) == (60_000, 7) and (merged["none"].n, merged["none"].n_distinct) == (0, 0)
    assert abs(merged["many"].n_distinct / 20_000 - 1) < 3 * 1.04 / 2 ** (P.SKETCH_BITS / 2)


def test_profile_of_a_stream(spark, tmp_path):
    df = spark.range(900).select((F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, F.col("id") * 1.5).alias("y"))
    for k in range(3):
        df.filter(F.col("x") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    StreamingProfile(spark, f"{tmp_path}/p", ["x", "y"]).start(events).awaitTermination()
    got = {r.name: r for r in StreamingProfile(spark, f"{tmp_path}/p", ["x", "y"]).profile().collect()}
    want = {r.name: r for r in P.numeric_profile(df, ["x", "y"]).collect()}
    for c in ("x", "y"):
        assert (got[c].n, got[c].min, got[c].max) == (want[c].n, want[c].min, want[c].max)
        assert got[c].mean == pytest.approx(want[c].mean) and got[c].variance == pytest.approx(want[c].variance)
    assert got["x"].n_distinct == 50 and abs(got["y"].n_distinct - 450) < 25


# -- the paged table ---------------------------------------------------------------------------------------------------


class Service(BaseHTTPRequestHandler):
    """A collection of 57 rows that answers $count, $filter (by a few words), $select, $orderby, $skip and $top, in pages of 7
    at most."""

    asked: list[dict] = []
    rows = [{"id": i, "name": f"it's {i % 5}" if i % 11 else None, "worth": i / 4, "day": f"2024-01-{i % 28 + 1:02d}", "big": "x" * 100} for i in range(57)]

    def do_GET(self):
        path, _, query = self.path.partition("?")
        ask = {k: v[0] for k, v in urllib.parse.parse_qs(query).items()}
        Service.asked.append(ask | {"path": path})
        found = self.rows
        for c in ask.get("$filter", "").split(" and ") if "$filter" in ask else []:
            if c.endswith(" ne null"):
                found = [r for r in found if r[c.split()[0]] is not None]
            elif c.startswith("startswith(name, "):
                start = c[len("startswith(name, ") : -1][1:-1].replace("''", "'")
                found = [r for r in found if (r["name"] or "").startswith(start)]
            else:
                name, op, value = c.split(" ", 2)
                assert (name, op) == ("id", "gt"), c
                found = [r for r in found if r["id"] > int(value)]
        if path.endswith("/$count"):
            body = str(len(found)).encode()
        else:
            found = sorted(found, key=lambda r: r[ask["$orderby"]])[int(ask["$skip"]) :][: min(7, int(ask["$top"]))]
            body = json.dumps({"d": {"results": [{k: r[k] for k in ask["$select"].split(",")} for r in found]}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/rows"
    server.shutdown()


def test_filters_and_columns_go_to_the_service(spark, service):
    paged.register(spark)
    read = spark.read.format("paged_table").option("url", service).option("order", "id").option("page_rows", 5).option("partition_rows", 12)
    df = read.schema("id long, name string, worth double, day date").load()
    got = df.filter((F.col("id") > 10) & F.col("name").startswith("it's") & (F.col("worth") < 13.1) & F.col("name").isNotNull())
    want = [r for r in Service.rows if r["id"] > 10 and r["name"] and r["worth"] < 13.1]
    assert sorted(map(tuple, got.collect())) == [(r["id"], r["name"], r["worth"], datetime.date.fromisoformat(r["day"])) for r in want]
    counts, pages = [a for a in Service.asked if a["path"].endswith("$count")], [a for a in Service.asked if "$skip" in a]
    assert {"id gt 10", "startswith(name, 'it''s')", "name ne null"} <= set(counts[0]["$filter"].split(" and ")) and "lt" not in counts[0]["$filter"]
    assert all(a["$select"] == "id,name,worth,day" and int(a["$top"]) <= 5 and "id gt 10" in a["$filter"] for a in pages)
    there = len([r for r in Service.rows if r["id"] > 10 and r["name"]])
    assert {int(a["$skip"]) for a in pages} >= set(range(0, there, 12))


def test_pages_are_read_side_by_side(spark, service):
    paged.register(spark)
    df = spark.read.format("paged_table").schema("id long").options(url=service, order="id", page_rows=10, partition_rows=10).load()
    assert df.rdd.getNumPartitions() == 6 and sorted(r.id for r in df.collect()) == list(range(57))
    assert spark.read.format("paged_table").schema("id long").options(url=service, order="id").load().filter("id > 100").count() == 0


def test_conditions():
    from pyspark.sql.datasource import EqualTo, In, Not, StringContains

    assert paged.condition(EqualTo(("a",), "o'x")) == "a eq 'o''x'" and paged.condition(In(("a",), (1, 2))) == "(a eq 1 or a eq 2)"
    assert paged.condition(StringContains(("a",), "b")) == "contains(a, 'b')" and paged.condition(EqualTo(("a",), True)) == "a eq true"
    assert paged.condition(EqualTo(("a", "b"), 1)) is None and paged.condition(Not(EqualTo(("a",), 1))) is None and paged.condition(EqualTo(("a",), 0.5)) is None


# -- the table of progress ---------------------------------------------------------------------------------------------


def settled(spark, path, done):
    """Listeners hear of events a little later."""
    import time

    for _ in range(100):
        try:
            found = listener.counters(spark, path).collect()
            if found and done(found[0]):
                return found
        except Exception:
            pass
        time.sleep(0.2)
    raise AssertionError(found)


def test_counters_outlive_queries(spark, tmp_path):
    at = f"{tmp_path}/progress"
    watch = listener.ProgressTable(spark, at).watch()
    try:
        df = spark.range(100)
        for k in range(4):
            df.filter(F.col("id") % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        bad = {"batch": 2}

        def learn(batch, batch_id):
            if batch_id == bad["batch"]:
                raise ValueError("a bad batch")
            batch.count()

        start = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").writeStream.foreachBatch(learn).queryName("learner").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        with pytest.raises(Exception, match="a bad batch"):
            start().awaitTermination()
        (one,) = settled(spark, at, lambda r: r.failed)
        assert (one.name, one.runs, one.batches, one.rows, one.running) == ("learner", 1, 2, 50, False) and "a bad batch" in one.last_error
        bad.clear(), bad.update(batch=-1)
        start().awaitTermination()
        (two,) = settled(spark, at, lambda r: r.batches == 4 and not r.running)
        assert (two.runs, two.rows, two.failed) == (2, 100, False) and "a bad batch" in two.last_error and two.id == one.id
    finally:
        watch.leave()
