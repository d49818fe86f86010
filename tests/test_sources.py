"""Files as the engine reads and writes them."""

import gzip
import json
import zlib

from rillwood.operators.profile import CATEGORIC, NUMERIC
from rillwood.sources import files, sinks


def test_csv_without_header(spark, tmp_path):
    path = tmp_path / "a.csv.gz"
    with gzip.open(path, "wt") as f:
        f.write("".join(f"{i},{'xy'[i % 2]},{'?' if i % 3 else i / 2}\n" for i in range(40)))
    df = files.read_csv(spark, str(path), header=False)
    assert df.columns == ["0", "1", "2"]
    assert [f.metadata["attribute_type"] for f in df.schema] == [NUMERIC, CATEGORIC, NUMERIC]
    assert df.filter("`2` IS NULL").count() == 26


def test_csv_types_can_be_given(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;kind;v\n1;10;a\n2;20;Unknown\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), types={"kind": CATEGORIC})
    assert [tuple(r) for r in df.collect()] == [(1.0, "10", "a"), (2.0, "20", None)]


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text("% note\n@relation r\n@attribute 'a b' REAL\n@attribute kind {x,y}\n@attribute n INTEGER\n@data\n1.5,x,?\n\n% more\n2,y,3\n")
    df = files.read_arff(spark, str(tmp_path / "a.arff"))
    assert df.columns == ["a b", "kind", "n"]
    assert [tuple(r) for r in df.collect()] == [(1.5, "x", None), (2.0, "y", 3.0)]


def test_event_log_and_back(spark, tmp_path):
    event = {"timestamp": 5, "data": [{"name": "a", "value": "1", "type": "NUMERIC"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text(json.dumps(event) + "\nnot json\n")
    events = files.read_events(spark, str(tmp_path / "in"))
    sinks.log_events(events, str(tmp_path / "log"))
    back = files.read_events(spark, str(tmp_path / "log")).collect()
    assert [(r.timestamp, r.data[0].name) for r in back] == [(5, "a")]


def test_compressed_batches(spark):
    body = zlib.compress(json.dumps([{"timestamp": 1, "data": []}, {"timestamp": 2, "data": []}]).encode())
    df = files.inflate_batches(spark.createDataFrame([(bytearray(body),), (bytearray(b"junk"),), (None,)], "body binary"), "body")
    assert sorted(r.timestamp for r in files.parse_event_batches(df, "body_text").collect()) == [1, 2]


def test_json_and_schema_stay(spark, tmp_path):
    sinks.write_json(spark, {"a": [1, None]}, str(tmp_path / "j"))
    assert sinks.read_json(spark, str(tmp_path / "j")) == {"a": [1, None]}
    df = spark.sql("SELECT 1 AS a, array('x') AS b")
    sinks.write_schema(df, str(tmp_path / "s"))
    assert sinks.read_schema(spark, str(tmp_path / "s")) == df.schema


def test_http_sources(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from rillwood.sources.http import register

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            here = f"http://127.0.0.1:{self.server.server_port}"
            out = {"/lines": '{"a": 1}\nbroken\n{"a": 2}\n', "/p1": json.dumps({"d": {"results": [{"x": 1}], "__next": here + "/p2"}}), "/p2": json.dumps({"value": [{"x": 2}]})}
            self.wfile.write(out[self.path].encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    register(spark)
    at = f"http://127.0.0.1:{server.server_port}"
    assert sorted(r[0] for r in spark.read.format("json_lines_http").option("url", at + "/lines").load().collect()) == ['{"a": 1}', '{"a": 2}']
    assert sorted(r[0] for r in spark.read.format("paged_http").option("url", at + "/p1").load().collect()) == ['{"x": 1}', '{"x": 2}']
    server.shutdown()


def test_lines_are_followed(spark, tmp_path):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from rillwood.sources.http import register

    sent, asked = [f'{{"a": {i}}}\n' for i in range(5)] + ["broken\n"], []

    class Endless(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers["Authorization"])
            self.send_response(200)
            self.end_headers()
            at = 0
            while at < len(sent) or at < 12:  # stays open until all twelve lines are there
                if at < len(sent):
                    self.wfile.write(sent[at].encode())
                    at += 1
                else:
                    time.sleep(0.05)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Endless)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    register(spark)
    options = {"url": f"http://127.0.0.1:{server.server_port}/", "batch_seconds": "1", "batch_lines": "4", "auth": "me:secret"}
    lines = spark.readStream.format("json_lines_http").options(**options).load()
    query = lines.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.sql("SELECT count(*) FROM followed").first()[0] < 5:
            time.sleep(0.3)
        sent.extend(f'{{"a": {i}}}\n' for i in range(5, 11))
        while time.time() < until and spark.sql("SELECT count(*) FROM followed").first()[0] < 11:
            time.sleep(0.3)
        assert sorted(json.loads(r[0])["a"] for r in spark.table("followed").collect()) == list(range(11))
    finally:
        query.stop()
        server.shutdown()
    assert set(asked) == {"Basic bWU6c2VjcmV0"}


def test_profile_stays_with_the_schema(spark, tmp_path):
    from rillwood.operators.profile import numeric_profile

    df = spark.sql("SELECT cast(id AS double) AS x FROM range(5)")
    sinks.write_schema(df, str(tmp_path / "s"), numeric_profile(df, ["x"]))
    assert sinks.read_schema(spark, str(tmp_path / "s")) == df.schema
    got = sinks.read_profile(spark, str(tmp_path / "s")).first()
    assert (got["name"], got["n"], got["mean"], got["max"]) == ("x", 5, 2.0, 4.0)


def test_new_files_come_once_and_are_logged(spark, tmp_path):
    def run():
        q = sinks.log_stream(files.new_files(spark, str(tmp_path / "in"), "a INT"), str(tmp_path / "log"), str(tmp_path / "c"))
        q.awaitTermination()

    for k in range(2):
        sinks.append_line(spark, {"a": k}, str(tmp_path / "in"))
        run()
    assert sorted(r[0] for r in spark.read.schema("a INT").json(str(tmp_path / "log")).collect()) == [0, 1]
