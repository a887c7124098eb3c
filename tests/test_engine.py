"""Sources, detection, evaluation, sinks, services, streaming and the command line."""

from __future__ import annotations

import http.server
import json
import math
import struct
import threading
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from rayline import cli, config, schema
from rayline.functions import rays
from rayline.functions.text import coordinate_text
from rayline.operators import detect as d, scan
from rayline.operators.evaluate import WRONG, evaluated, outcome_label, summary, summary_by
from rayline.operators.lookup import resolve_names, still_missing
from rayline.operators.pairing import paired_fixes
from rayline.sinks import log as sink_log, overlay, results as sink
from rayline.sources import cases, images, live, services
from rayline.streaming.fixes import outcome_windows, paired_stream

LINES = [
    "Previous;Current;Road;Target;Result;City",
    "1, 2;3, 4;road;target;;Athens",
    "   ",
    "1, 2;3, 4;road",
    "1, 2;3, 4;road;",
    "1, 2;3, 4;road;target",
    "1, 2;3, 4; a road ;target;;",
    "1, 2;3, 4;;;;Athens",
    "1, 2, 3;3, 4;a;b;;c",
    "1,2,;3, 4;a;b;;c",
    '"1,2";"3,4";a;b;;c',
    "1,2,3,4,a,b",
    "x, 2;3, 4;a;b;;c",
]


def test_case_file(spark, tmp_path):
    path = tmp_path / "cases.csv"
    path.write_text("\n".join(LINES) + "\n", encoding="utf-8")
    got = [(r["row_number"], r["current_road"], r["target_road"], r["city"]) for r in cases.read_cases(spark, str(path)).orderBy("row_number").collect()]
    assert got == [(1, "road", "target", "Athens"), (4, "road", "target", ""), (5, "a road", "target", ""), (6, "", "", "Athens"), (8, "a", "b", "c")]
    assert [r["row_number"] for r in cases.bad_lines(spark, str(path)).orderBy("row_number").collect()] == [2, 3, 7, 9, 10, 11]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        cases.read_cases(spark, str(empty))


def test_case_numbers_over_many_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("header\n" + "".join(f"1, 2;3, 4;r;t{i};;c\n" + ("\n" if i % 3 == 0 else "") for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = cases.read_cases(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 1 and got.count() == 3000
        assert got.where(F.concat(F.lit("t"), F.col("row_number").cast("string")) != F.col("target_road")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_single_pair(spark):
    assert cases.single_pair(spark, []).first()["previous"]["lat"] == 37.988891
    assert cases.single_pair(spark, ["1,2", "3,4", "more"]).first()["current"]["lon"] == 4.0
    with pytest.raises(ValueError):
        cases.single_pair(spark, ["1,2", "x"])


CHOICES = [  # left, right -> distance, alternative distance, angle, alternative angle
    (10.0, 20.0, 10.0, 20.0, 1.0, 2.0), (20.0, 10.0, 10.0, 20.0, 2.0, 1.0), (10.0, 10.0, 10.0, 10.0, 1.0, 2.0),
    (10.0, None, 10.0, None, 1.0, 2.0), (None, 10.0, 10.0, None, 2.0, 1.0), (None, None, 0.0, None, 0.0, 0.0),
]


def test_choice_of_sides(spark):
    df = spark.createDataFrame([c[:2] for c in CHOICES], "l double, r double").coalesce(1)
    got = [tuple(r["c"]) for r in df.select(d.choose(F.col("l"), F.col("r"), F.lit(1.0), F.lit(2.0)).alias("c")).collect()]
    assert got == [(dist, angle, alt, alt_angle) for _, _, dist, alt, angle, alt_angle in CHOICES]


def test_outcomes(spark):
    rows = [
        (1, "Elaiwn", "Rodwn", "Elaiwn", "x", None), (2, "Kosma", "y", "Olimpias", "Kosma", None), (3, "Kosma", "Olimpias", "Olimpias", None, None),
        (4, "Kosma", "y", None, None, None), (5, "Kosma", "y", "Kosma", "Kosma", "timeout"), (6, "Kosma", "y", "Kosma", "Kosma", None),
    ]
    df = spark.createDataFrame([(*r, "Athens" if r[0] < 4 else "Patra") for r in rows], "row_number int, target_road string, current_road string, road_name string, alternative_road_name string, error string, city string")
    out = evaluated(df)
    got = {r["row_number"]: r for r in out.collect()}
    assert [(got[i]["outcome"], got[i]["detected_road"], got[i]["alternative_used"], got[i]["error_message"]) for i in range(1, 7)] == [
        ("PASS", "Elaiwn", False, None), ("PASS", "Kosma", True, None), ("FAIL", "Olimpias / UNKNOWN", False, WRONG),
        ("FAIL", "UNKNOWN / UNKNOWN", False, WRONG), ("ERROR", "", False, "timeout"), ("PASS", "Kosma", False, None),
    ]
    assert got[3]["primary_is_current_road"] and all(r["iterations"] == 0 for r in got.values())
    s = summary(out).first()
    assert (s["total"], s["passed"], s["passed_direct"], s["passed_alternative"], s["failed"], s["errors"]) == (6, 3, 2, 1, 2, 1) and s["success_rate"] == 50.0
    assert math.isnan(summary(out.where("false")).first()["success_rate"])
    by = {r["city"]: r["total"] for r in summary_by(out, ["city"]).collect()}
    assert by == {"Athens": 3, "Patra": 3, None: 6}
    labels = {r[0] for r in out.select(outcome_label(F.col("outcome"), F.col("alternative_used"))).collect()}
    assert labels == {"PASS           ", "PASS (alt)     ", "FAIL           ", "ERROR          "}
    assert sink.summary_lines(out)[-1] == "  Success rate:        50.0%"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Rasters, responses and cases around three positions; the second has no raster."""
    folder = tmp_path_factory.mktemp("world")
    pixels = np.zeros((400, 400, 3), np.uint8)
    pixels[:, 290:300] = (0, 255, 0)  # a road to the east, 90 to 100 pixels off
    (folder / "png").mkdir()
    for key in ("38.0,24.0", "37.0,23.0"):
        (folder / "png" / f"{key}.png").write_bytes(images.encode_png(pixels))
    (folder / "png" / "36.0,22.0.png").write_bytes(b"no image")
    lines = ["header", "38.0, 23.999;38.0, 24.0;Own;Kosma;;Athens", "37.0, 22.999;37.0, 23.0;Own;Olimpias;;Patra", "35.0, 22.0;35.0, 22.001;Own;X;;Patra", "36.0, 21.999;36.0, 22.0;Own;X;;Patra"]
    (folder / "cases.csv").write_text("\n".join(lines) + "\n")
    tiles = images.read_tiles(spark, str(folder / "png"))
    pairs = cases.read_cases(spark, str(folder / "cases.csv"))
    found = d.with_targets(d.scan_tiles(pairs, tiles))
    key = lambda c: coordinate_text(F.col(f"{c}.lat"), F.col(f"{c}.lon")).alias("k")
    points = [r["k"] for r in found.where("found").select("row_number", key("target")).orderBy("row_number").collect()]
    body = lambda place: json.dumps({"snappedPoints": [{"originalIndex": 0, "placeId": place}]})
    name = lambda n: json.dumps({"results": [{"address_components": [{"long_name": n, "types": ["route"]}]}]})
    spark.createDataFrame([(p, body(f"id{i}")) for i, p in enumerate(points)], "point_key string, body string").write.parquet(str(folder / "snaps"))
    spark.createDataFrame([("id0", name("Kosmas")), ("id1", name("Elli"))], "place_id string, body string").write.parquet(str(folder / "places"))
    tiles.write.parquet(str(folder / "tiles"))
    return folder


def test_detection_end_to_end(spark, world):
    lookups = cli.tables(spark, str(world))
    found = d.detect(cases.read_cases(spark, str(world / "cases.csv")), *lookups)
    rows = {r["row_number"]: r for r in evaluated(found).collect()}
    assert rows[1]["chosen"]["distance"] == pytest.approx(26.5, abs=0.6) and rows[1]["chosen"]["alt_distance"] is not None
    assert [rows[i]["outcome"] for i in (1, 2, 3, 4)] == ["PASS", "FAIL", "ERROR", "ERROR"]
    assert rows[3]["error_message"] == "no raster for this position" and rows[4]["error_message"] == "raster could not be decoded"
    text = found.where("row_number = 1").select(d.result_text(found)).first()[0]
    assert text.splitlines()[0] == "DetectionResult {" and "road             = Kosmas" in text and len(text.splitlines()) == 8


def test_pairs_of_hot_entities(spark):
    """An entity of many fixes is cut into ranges; pairs are those of a plain window."""
    rows = [(e, i * 7919 % 500, float(i), float(-i)) for e, n in (("hot", 500), ("b", 30), (None, 200), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "entity string, ts long, lat double, lon double").repartition(5)
    key = lambda r: (r["entity"] or "", r["ts"], r["lat"], r["prev_lat"], r["prev_lon"])
    plain = sorted(map(key, paired_fixes(df, "entity", ["ts"]).collect()))
    assert len(plain) == 499 + 29 + 199
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = paired_fixes(df, "entity", ["ts"], most=50)
        assert sorted(map(key, cut.collect())) == plain and set(cut.columns) == {*df.columns, "prev_lat", "prev_lon"}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_one_scan(spark, world):
    """Rasters are scanned once, however many columns follow from the hits."""
    found = evaluated(d.detect(cases.read_cases(spark, str(world / "cases.csv")), *cli.tables(spark, str(world))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_scan_by_tile(spark, monkeypatch):
    """Any channels; a point of many rays is cut; rasters that are missing, broken or repeated."""
    monkeypatch.setattr(scan, "ROWS_A_COPY", 10)
    pixels = np.zeros((200, 200, 3), np.uint8)
    pixels[:, 150:] = (0, 255, 0)
    rgba = np.concatenate([pixels, np.full((200, 200, 1), 255, np.uint8)], axis=2)
    raw = lambda p: ("", p.shape[0], p.shape[1], p.shape[2], 16, bytearray(p.tobytes()))
    tiles = spark.createDataFrame([("a", raw(pixels)), ("b", raw(rgba)), ("b", raw(rgba)), ("c", ("", -1, -1, -1, -1, bytearray())), ("d", None), (None, raw(pixels))], schema.TILES)
    rows = [(i, "a", 90.0, 0.0) for i in range(95)] + [(100 + i, p, 90.0, 0.0) for i, p in enumerate("bcdxy")] + [(200, None, 90.0, 0.0), (201, "a", None, 90.0)]
    df = spark.createDataFrame(rows, "id long, point_key string, left double, copy double").withColumn("row", F.lit("kept")).withColumn("error", F.lit("old"))
    out = scan.scan_rays(df, tiles, F.col("point_key"), F.col("left"), F.col("copy"))
    assert set(out.columns) == {*df.columns, "hits"}
    got = {r["id"]: (r["hits"] and tuple(r["hits"]), r["error"], r["row"]) for r in out.collect()}
    hit = pytest.approx(13.25)
    assert len(got) == len(rows) and all(got[i] == ((hit, None), None, "kept") for i in [*range(95), 100])
    assert got[201] == ((None, hit), None, "kept") and got[101] == (None, scan.BROKEN, "kept")
    assert all(got[i] == (None, scan.MISSING, "kept") for i in (102, 103, 104, 200))


def test_sinks_and_command_line(spark, world, tmp_path, capsys):
    out = tmp_path / "deep" / "results.csv"
    assert cli.main(["evaluate", str(world / "cases.csv"), str(out), "--tables", str(world), "--images", str(tmp_path / "debug")], spark) == 0
    printed = capsys.readouterr().out
    assert "  #001 | PASS            | Target: Kosma                     | Got: Kosmas" in printed and "FAIL:                1/4" in printed
    lines = out.read_text().splitlines()
    assert lines[0] == sink.HEADER and lines[1] == '1;"38.0,23.999";"38.0,24.0";Own;Kosma;Kosmas;PASS;0;NO;Athens'
    assert [p.name for p in (tmp_path / "debug").iterdir()] == ["case-002.png"]
    drawn = spark.read.format("image").load(str(tmp_path / "debug")).first()["image"]
    bgr = np.frombuffer(drawn["data"], np.uint8).reshape(400, 400, 3)
    assert tuple(bgr[200, 200]) == (0, 0, 255) and tuple(bgr[200, 188]) == (0, 0, 255)  # the cross is on top
    assert cli.main(["detect", "38.0,23.999", "38.0,24.0", "--tables", str(world)], spark) == 0
    assert "DetectionResult" in capsys.readouterr().out
    assert cli.main(["detect", "38.0,23.999", "x", "--tables", str(world)], spark) == 1
    assert cli.main(["detect", "35.0,22.0", "35.0,22.001", "--tables", str(world)], spark) == 1


def test_quoted_results(spark, world, tmp_path):
    found = evaluated(d.detect(cases.read_cases(spark, str(world / "cases.csv")), *cli.tables(spark, str(world))).withColumn("city", F.lit("a;b")))
    sink.write_results_csv(found, str(tmp_path / "r"))
    back = spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "r"))
    assert back.columns == sink.COLUMNS and {r["City"] for r in back.collect()} == {"a;b"} and back.count() == 4


def test_lookup_of_distinct_points(spark):
    points = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "point_key string")
    snaps = spark.createDataFrame([("a", '{"snappedPoints":[{"originalIndex":0,"placeId":"p"}]}'), ("b", "broken")], "point_key string, body string")
    places = spark.createDataFrame([("p", '{"results":[{"address_components":[{"types":["route"]}]}]}')], "place_id string, body string")
    got = {r["point_key"]: (r["place_id"], r["road_name"], r["lookup_error"]) for r in resolve_names(points, snaps, places).collect()}
    assert got == {"a": ("p", None, "route without a name"), "b": (None, None, None), "c": (None, None, None)}
    assert [r[0] for r in still_missing(points, snaps, "point_key").collect()] == ["c"]


def test_settings(tmp_path):
    path = tmp_path / "app.properties"
    path.write_text("# comment\ngoogle.maps.api.key=${KEY}\nimage.skip.pixels=40\nimage.step.size=0.5\nstaticmap.road.color=a${KEY}\n")
    s = config.load(str(path), {"KEY": "secret"})
    assert (s.key, s.skip_pixels, s.step_size, s.road_color, s.max_attempts) == ("secret", 40, 0.5, "a${KEY}", 3)
    with pytest.raises(ValueError):
        _ = config.load(str(path), {}).key
    with pytest.raises(ValueError):
        config.Settings(step_size=0)
    with pytest.raises(ValueError):
        config.Settings(max_attempts=0)
    path.write_text("image.skip.pixels=many\n")
    with pytest.raises(ValueError):
        config.load(str(path), {})
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none"))


@pytest.fixture
def service():
    """A local service: /busy fails twice, /gone always, others echo the query."""
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append(self.path)
            busy = self.path.startswith("/busy") and len(calls) < 3
            self.send_response(503 if busy else 404 if self.path.startswith("/gone") else 200)
            self.end_headers()
            self.wfile.write(b"" if busy else self.path.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", calls
    server.shutdown()


def test_retries(service):
    base, calls = service
    s, slept = config.Settings(api_key="k", retry_delay_ms=1000), []
    assert services.get(f"{base}/busy", s, slept.append) == b"/busy" and slept == [1.0, 2.0]
    calls.clear()
    with pytest.raises(OSError):
        services.get(f"{base}/gone", s, slept.append)
    assert len(calls) == 1
    calls.clear()
    with pytest.raises(OSError):
        services.get(f"{base}/gone", s, slept.append, retry_all=True)
    assert len(calls) == 3
    assert [services.is_retryable(c) for c in (429, 500, 503, 404, 400)] == [True, True, True, False, False]


def test_fill_lookup_table(spark, service):
    base, _ = service
    s = config.Settings(api_key="k", batch_delay_ms=0, retry_delay_ms=0)
    keys = spark.createDataFrame([("1.0,2.0",), ("1.0,2.0",), (None,), ("bad",)], "point_key string")
    request = lambda key, s: services.snap_request(key, s, f"{base}/gone" if key == "bad" else f"{base}/snap")
    got = {r["point_key"]: (r["body"], r["error"] is None) for r in services.fill(keys, "point_key", request, s, workers=2).collect()}
    assert got == {"1.0,2.0": ("/snap?points=1.0%2C2.0&key=k", True), "bad": (None, False)}
    assert services.map_request("1.0,2.0", s).count("style=") == 3 and "size=500x500" in services.map_request("1.0,2.0", s)
    assert services.place_request("p", s).endswith("place_id=p&key=k")


def png(width, height, depth, colour, rows, extra=b"", interlaced=0):
    """A PNG of filtered rows as they are."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(rows)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return images.SIGNATURE + part(b"IHDR", head) + extra + part(b"IDAT", packed[:5]) + part(b"IDAT", packed[5:]) + part(b"IEND", b"")


def test_png_decoding_equals_spark(spark, tmp_path):
    """All filters, depths, palettes and passes against the image source of Spark."""
    rng = np.random.default_rng(1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    palette = part(b"PLTE", rng.integers(0, 256, 48, dtype=np.uint8).tobytes())
    rows = lambda length, height: b"".join(bytes([y % 5]) + rng.integers(0, 256, length, dtype=np.uint8).tobytes() for y in range(height))
    passes = b"".join(rows(3 * -(-(19 - c) // dc), -(-(11 - r) // dr)) for r, c, dr, dc in images.PASSES)
    files = {
        "rgb": png(19, 23, 8, 2, rows(57, 23)), "rgba": png(19, 23, 8, 6, rows(76, 23)), "grey": png(19, 23, 8, 0, rows(19, 23)), "palette4": png(19, 23, 4, 3, rows(10, 23), palette),
        "palette1": png(19, 23, 1, 3, rows(3, 23), palette), "passes": png(19, 11, 8, 2, passes, interlaced=1), "own": images.encode_png(rng.integers(0, 256, (7, 9, 3), dtype=np.uint8)),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.png").write_bytes(data)
    want = {r["point_key"]: r["image"] for r in images.read_tiles(spark, str(tmp_path)).collect()}
    bodies = [(k, bytearray(v)) for k, v in files.items()] + [("none", None), ("bad", bytearray(b"<html>")), ("cut", bytearray(files["rgb"][:60]))]
    got = {r["point_key"]: r["image"] for r in images.decoded_tiles(spark.createDataFrame(bodies, "point_key string, body binary")).collect()}
    assert set(got) == {*files, "bad", "cut"} and got["bad"]["width"] == got["cut"]["width"] == -1
    for name in files:
        assert [got[name][c] for c in ("height", "width", "nChannels", "mode")] == [want[name][c] for c in ("height", "width", "nChannels", "mode")], name
        assert bytes(got[name]["data"]) == bytes(want[name]["data"]), name


def test_log(spark, tmp_path, service, caplog):
    base, _ = service
    with caplog.at_level("INFO", "rayline"):
        services.get(f"{base}/busy", config.Settings(api_key="k"), lambda _: None)
        assert [r.levelname for r in caplog.records] == ["WARNING"] * 2 and "attempt 1 of 3 failed" in caplog.text
        caplog.clear()
        (tmp_path / "cases.csv").write_text("\n".join(LINES) + "\n", encoding="utf-8")
        assert sink_log.log_skipped(cases.bad_lines(spark, str(tmp_path / "cases.csv"))) == 6
        assert "line 2 skipped: fewer than four fields" in caplog.text
        caplog.clear()
        rows = [(1, "PASS", "a", "a", None), (2, "FAIL", "a", "b / c", WRONG), (3, "ERROR", "a", "", "timeout")]
        sink_log.log_outcomes(spark.createDataFrame(rows, "row_number int, outcome string, target_road string, detected_road string, error_message string"))
        assert [(r.levelname, r.getMessage()) for r in caplog.records] == [("INFO", "case 1 passed: expected a, detected a"), ("INFO", "case 2 missed: expected a, detected b / c"), ("WARNING", "case 3 failed: timeout")]


def test_live_run(spark, world, tmp_path):
    """From services to an evaluated case: a raster, its points' snaps and their places, each asked once."""
    pixels = np.zeros((400, 400, 3), np.uint8)
    pixels[:, 290:300] = (0, 255, 0)
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            query = urllib.parse.parse_qs(url.query)
            asked.append(url.path)
            bodies = {
                "/map": lambda: images.encode_png(pixels) if query["center"] != ["36.0,22.0"] else b"<html>",
                "/snap": lambda: json.dumps({"snappedPoints": [{"originalIndex": 0, "placeId": "id"}]}).encode(),
                "/place": lambda: json.dumps({"results": [{"address_components": [{"long_name": "Kosmas", "types": ["route"]}]}]}).encode(),
            }
            gone = query.get("center") == ["35.0,22.001"]
            self.send_response(404 if gone else 200)
            self.end_headers()
            self.wfile.write(b"" if gone else bodies[url.path]())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        s = config.Settings(api_key="k", batch_delay_ms=0, retry_delay_ms=0)
        pairs = cases.read_cases(spark, str(world / "cases.csv"))
        urls = tuple(f"{base}/{x}" for x in ("map", "snap", "place"))
        added = live.fill_tables(spark, pairs, str(tmp_path), s, urls)
        assert added == {"tiles": 3, "snaps": asked.count("/snap"), "places": 1} and asked.count("/map") == 4 and added["snaps"] >= 2
        before = len(asked)
        assert live.fill_tables(spark, pairs, str(tmp_path), s, urls) == {"tiles": 0, "snaps": 0, "places": 0}
        assert len(asked) == before + 1  # the one that failed
        rows = {r["row_number"]: r for r in evaluated(d.detect(pairs, *cli.tables(spark, str(tmp_path)), s)).collect()}
        assert [rows[i]["outcome"] for i in (1, 2, 3, 4)] == ["PASS", "FAIL", "ERROR", "ERROR"]
        assert rows[4]["error_message"] == scan.BROKEN and rows[3]["error_message"] == scan.MISSING
    finally:
        server.shutdown()


def test_paired_stream(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "entity string, ts timestamp, lat double, lon double"
    first = [("a", at(0), 1.0, 1.0), ("a", at(1), 2.0, 2.0), ("b", at(0), 9.0, 9.0)]
    second = [("a", at(2), 3.0, 3.0), ("a", at(0), 0.0, 0.0), ("b", at(5), 8.0, 8.0)]
    source, sink_name = tmp_path / "in", "pairs_out"
    source.mkdir()

    def run(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        query = paired_stream(spark.readStream.schema(schema).parquet(str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run(first, sink_name)
    run(second, sink_name)
    got = {(r["entity"], r["lat"], r["prev_lat"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2.0, 1.0), ("a", 3.0, 2.0), ("b", 8.0, 9.0)}


def test_outcome_windows(spark):
    import datetime as dt

    rows = [Row(ts=dt.datetime(2024, 1, 1, 0, m), outcome=o) for m, o in ((1, "PASS"), (2, "PASS"), (7, "FAIL"))]
    got = {(r["window"]["start"].minute, r["outcome"], r["cases"]) for r in outcome_windows(spark.createDataFrame(rows)).collect()}
    assert got == {(0, "PASS", 2), (5, "FAIL", 1)}


def test_answers_of_pairs_at_one_place(spark):
    """Pairs that share a place keep their own answers if these have keys of their own; several answers are one."""
    pixels = np.zeros((32, 32, 3), np.uint8)
    pixels[:, 24:] = (0, 255, 0)
    image = Row(origin="", height=32, width=32, nChannels=3, mode=16, data=bytearray(pixels.tobytes()))
    s, at = config.Settings(skip_pixels=4), "struct<lat:double,lon:double>"
    pairs = spark.createDataFrame([(i, (38.0, 23.999), (38.0, 24.0)) for i in range(4)], f"id long, previous {at}, current {at}")
    own = lambda p: F.concat(F.col("id").cast("string"), F.lit(" "), d.point_key(p))
    tiles = lambda keys: spark.createDataFrame([(k, image) for k in keys], schema.TILES)
    body = lambda i: json.dumps({"snappedPoints": [{"originalIndex": 0, "placeId": f"id{i}"}]})
    name = lambda i: json.dumps({"results": [{"address_components": [{"long_name": f"Road {i}", "types": ["route"]}]}]})
    places = spark.createDataFrame([(f"id{i}", name(i)) for i in range(4)] * 2, "place_id string, body string")

    def found(key, with_raster, snapped):
        rasters = tiles(with_raster)
        target = d.with_targets(d.scan_tiles(pairs, rasters, s, key)).where("found").select("id", key("target").alias("k")).collect()
        snaps = spark.createDataFrame([(r["k"], body(r["id"])) for r in target if r["id"] in snapped] * 2, "point_key string, body string")
        return sorted((r["id"], r["road_name"], r["error"]) for r in d.detect(pairs, rasters, snaps, places, s, key).collect())

    want = [(0, None, scan.MISSING), (1, "Road 1", None), (2, None, None), (3, "Road 3", None)]
    assert found(own, [f"{i} 38.0,24.0" for i in (1, 2, 3)], (1, 3)) == want
    assert found(d.point_key, ["38.0,24.0"] * 2, (1, 3)) == [(i, "Road 3", None) for i in range(4)]


def test_samples_on_the_edge_of_a_pixel():
    """Straight up, sums of steps end a last bit beside the middle: the pixel is the one right of it."""
    pixels = np.zeros((32, 32, 3), np.uint8)
    pixels[:, 16] = (0, 255, 0)
    angles = np.array([0.0, 180.0, 360.0 - 1e-13, 180.0 + 1e-13])
    assert rays.first_hits(pixels, angles, 4, 1.0, 1.0).tolist() == [4.0] * 4


def test_rows_without_filters_from_both_sides_are_decoded_whole(monkeypatch):
    """Filters none, left and above need no diagonals; a mix with the others gives the same bytes."""
    rng = np.random.default_rng(3)
    rows, kinds = rng.integers(0, 256, (9, 6, 3)).astype(np.uint8), rng.integers(0, 3, 9).astype(np.uint8)
    mixed = images.unfiltered(np.concatenate([rows, rows[:1]]), np.append(kinds, np.uint8(4)))[:-1]
    monkeypatch.setattr(images.np, "select", None)
    assert (images.unfiltered(rows, kinds) == mixed).all()


def test_sweep_and_overlay_layers(spark):
    rows = spark.createDataFrame([((38.0, 23.999), (38.0, 24.0))], "previous struct<lat:double,lon:double>, current struct<lat:double,lon:double>")
    got = {r["offset"]: r["metres"] for r in d.sweep(rows, lambda x, y: x >= 290, 400, 400, [-90, 0, 90]).collect()}
    assert got[0.0] == pytest.approx(23.85, abs=0.3) and got[90.0] is None and got[-90.0] is None
    drawn = overlay.draw(np.zeros((300, 300, 3), np.uint8), 90.0, [(60, 60, overlay.YELLOW, "P: x"), (-50, 900, overlay.CYAN, "A")], ["Case"])
    assert tuple(drawn[60, 60]) == overlay.YELLOW and tuple(drawn[150, 200]) == overlay.WHITE and tuple(drawn[150, 150]) == overlay.RED
