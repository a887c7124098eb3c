"""Geometry, rays, names, text and payloads against known values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rayline.functions import geo, names, payloads, rays, text


def one(spark, column, **values):
    """The value of a column over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def lits(*values):
    return [F.lit(float(v)) for v in values]


BEARINGS = [  # previous, current, bearing, left, right, point 26.5 m along the left ray
    ((38.016959, 24.419875), (38.016989, 24.419658), 279.953047, 254.953047, 304.953047, (38.01692713, 24.41936587)),
    ((37.988891, 23.741949), (37.988988, 23.741867), 326.326335, 301.326335, 351.326335, (37.98911191, 23.74160869)),
    ((10, 20), (10, 20), 0, 335, 25, (10.00021599, 19.99989773)),
    ((0, 0), (1, 0), 0, 335, 25, (1.00021599, -0.00010073)),
    ((0, 0), (0, 1), 90, 65, 115, (0.00010072, 1.00021599)),
    ((1, 0), (0, 0), 180, 155, 205, (-0.00021599, 0.00010072)),
    ((0, 0), (0, -1), 270, 245, 295, (-0.00010072, -1.00021599)),
    ((0, 179.9999), (0, -179.9999), 90, 65, 115, (0.00010072, -179.99968401)),
]


@pytest.mark.parametrize("previous,current,bearing,left,right,point", BEARINGS)
def test_bearing_angles_and_projection(spark, previous, current, bearing, left, right, point):
    p, c = lits(*previous), lits(*current)
    assert one(spark, geo.bearing(*p, *c)) == pytest.approx(bearing, abs=1e-6)
    angles = one(spark, geo.search_angles(tuple(c), tuple(p), 25.0))
    assert (angles["left"], angles["right"]) == pytest.approx((left, right), abs=1e-6)
    target = one(spark, geo.project(*c, F.lit(26.5), F.lit(angles["left"])))
    assert (target["lat"], target["lon"]) == pytest.approx(point, abs=1e-8)


def test_normalize_keeps_its_edge(spark):
    got = [one(spark, geo.normalize(F.lit(x))) for x in (-10.0, 370.0, 360.0, 0.0, -1e-15)]
    assert got == [350.0, 10.0, 0.0, 0.0, 360.0]


def test_projection_round_trip(spark):
    rows = spark.range(200).select((F.col("id") * 0.7 - 70).alias("lat"), (F.col("id") * 1.7 - 170).alias("lon"), (F.col("id") * 1.8).alias("a"))
    rows = rows.withColumn("p", geo.project(F.col("lat"), F.col("lon"), F.lit(500.0), F.col("a")))
    back = rows.select(F.abs(geo.bearing(F.col("lat"), F.col("lon"), F.col("p.lat"), F.col("p.lon")) - F.col("a")).alias("d"))
    assert back.agg(F.max("d")).first()[0] < 1e-6


def test_pixels_round_half_up(spark):
    assert [one(spark, geo.half_up(F.lit(x))) for x in (2.5, -2.5, 2.4, -2.6)] == [3, -2, 2, -3]
    p = one(spark, geo.to_pixel(500, 500, F.lit(26.5), F.lit(90.0)))
    assert (p["x"], p["y"]) == (600, 500)
    assert one(spark, geo.pixel_metres(*lits(3, 4))) == pytest.approx(5 * 0.265)


MASKS = [  # road mask, angle, metres
    (lambda x, y: (x >= 600) & (x < 610), 90.0, 26.5),
    (lambda x, y: (y >= 390) & (y <= 400), 0.0, 26.5),
    (lambda x, y: (y >= 390) & (y <= 400), 360.0, 26.5),
    (lambda x, y: y >= 600, 180.0, 26.5),
    (lambda x, y: x <= 400, 270.0, 26.5),
    (lambda x, y: x >= 600, 45.0, 37.63),
    (lambda x, y: (x >= 540) & (x <= 549), 90.0, None),
    (lambda x, y: (x >= 545) & (x <= 555), 90.0, 13.25),
    (lambda x, y: x < -1, 33.0, None),
]


def image(mask, width=1000, height=1000):
    y, x = np.mgrid[0:height, 0:width]
    pixels = np.zeros((height, width, 3), np.uint8)
    pixels[:, :, 1] = np.where(mask(x, y), 255, 0)
    return pixels


@pytest.mark.parametrize("mask,angle,metres", MASKS)
def test_first_hit(spark, mask, angle, metres):
    found = one(spark, rays.scan_mask(F.lit(angle), mask, 1000, 1000))
    stepped = rays.ray_hit(image(mask), angle)
    for got in (found, stepped):
        assert got == (None if metres is None else pytest.approx(metres, abs=1e-6))


def test_scan_limits(spark):
    everywhere = image(lambda x, y: x >= 0, 80, 80)
    assert rays.ray_hit(everywhere, 90.0) is None  # the first sample is outside
    assert rays.ray_hit(np.full((200, 200, 1), 255, np.uint8), 90.0) is None  # grey is no road
    with pytest.raises(ValueError):
        rays.ray_hit(everywhere, 90.0, step=0)
    with pytest.raises(ValueError):
        rays.scan_mask(F.lit(1.0), lambda x, y: x > 0, 10, 10, step=0)
    assert rays.most_steps(1000, 1000) == 658


def test_road_pixels(spark):
    cases = [((49, 201, 49), True), ((50, 201, 0), False), ((0, 200, 0), False), ((0, 201, 50), False)]
    for (r, g, b), want in cases:
        assert one(spark, rays.is_road(F.lit(r), F.lit(g), F.lit(b))) is want


def stepped(pixels, angle, skip, step):
    """One ray, sample after sample."""
    height, width, _ = pixels.shape
    a = math.radians((angle + 270.0) % 360.0)
    x, y = width / 2 + skip * math.cos(a), height / 2 + skip * math.sin(a)
    while 0 <= x < width and 0 <= y < height:
        b, g, r = pixels[int(y), int(x)][:3]
        if g > 200 and r < 50 and b < 50:
            return math.hypot(x - width / 2, y - height / 2) * 0.265
        x, y = x + step * math.cos(a), y + step * math.sin(a)
    return None


def test_many_rays_at_once(monkeypatch):
    monkeypatch.setattr(rays, "RAYS_AT_ONCE", 7)
    rng = np.random.default_rng(4)
    for width, height, skip, step in ((300, 200, 10, 1.0), (200, 300, 40, 0.5), (64, 64, 0, 3.0), (90, 90, 60, 1.0)):
        pixels = np.zeros((height, width, 3), np.uint8)
        pixels[:, :, 1] = np.where(rng.random((height, width)) < 0.004, 255, 0)
        angles = rng.uniform(0, 720, 60)
        got = rays.first_hits(pixels, np.append(angles, np.nan), skip, step)
        want = [stepped(pixels, a, skip, step) for a in angles]
        assert np.isnan(got[-1]) and [None if np.isnan(x) else pytest.approx(x) for x in got[:-1]] == want
    assert [rays.stretches(n) for n in (-1, 0, 7, 8, 30)] == [[], [(0, 0)], [(0, 7)], [(0, 7), (8, 8)], [(0, 7), (8, 23), (24, 30)]]


NAMES = [
    ("Theoxari Kotsika", "Theochari Kotsika", 1), ("Elaiwn", "Eleon", 1), ("Kosma", "Kosma tou Etolou", 2), ("P Tsaldari", "Panagi Tsaldari", 3),
    ("Thlemaxou", "Tilemachou", 3), ("ἀcharnon", "acharnon", 3), ("ab", "cd", 3), ("makedonias leoforos", "makedonias leofabcd", 4), ("", "anything", 2),
    ("UNKNOWN", "UNKNOWN", 0), ("unknown", "unknown", 1), (None, "x", 0), ("x", None, 0), ("Olimpias", "Elli", 0), ("Naidwn", "Rodwn", 3),
]


@pytest.mark.parametrize("a,b,rule", NAMES)
def test_match_rule(spark, a, b, rule):
    x, y = (F.lit(v).cast("string") for v in (a, b))
    assert one(spark, names.match_rule(x, y)) == rule
    assert one(spark, names.match_rule(y, x)) == rule
    assert one(spark, names.fuzzy_match(x, y)) is (rule > 0)


def test_normalize_name(spark):
    cases = {"  Agiou   Spiridonos ": "agiu spiridonos", "Xalkidikis": "kalkidikis", "Foinikwn": "finikon", "Theoxari Kotsika": "teokari kotsika", "wu": "ou", "ou": "u"}
    for raw, want in cases.items():
        assert one(spark, names.normalize_name(F.lit(raw))) == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=15, deadline=None)
@given(st.text("abἀé ", max_size=8), st.text("abἀé ", max_size=8))
def test_levenshtein_counts_code_points(spark, a, b):
    assert one(spark, F.levenshtein(F.lit(a), F.lit(b))) == edits(a, b) == one(spark, F.levenshtein(F.lit(b), F.lit(a)))


COORDINATES = [
    ("38.0, 24.5", (38.0, 24.5)), (" 1 ,\t2", (1.0, 2.0)), ("1,2,", (1.0, 2.0)), ("1,2,3", None), ("1", None), ("", None), ("x, 2", None), ('"1,2"', None),
    ("1e3,-2.5", (1000.0, -2.5)), ("1.0d,2f", (1.0, 2.0)), ("inf,1", None), ("Infinity,1", (math.inf, 1.0)), (None, None), (",1", None),
]


@pytest.mark.parametrize("raw,want", COORDINATES)
def test_parse_coordinate(spark, raw, want):
    got = one(spark, text.parse_coordinate(F.lit(raw).cast("string")))
    assert (got and tuple(got)) == want


def test_renderings(spark):
    assert one(spark, text.coordinate_text(*lits(38.0358, 24.0))) == "38.0358,24.0"
    assert one(spark, text.point_label(*lits(1.5, -2))) == "GeoPoint[lat=1.500000, lon=-2.000000]"
    assert one(spark, text.angles_label(*lits(1.126, 359.999))) == "BearingAngles[left=1.13°, right=360.00°]"
    assert one(spark, text.trimmed(F.lit("\t a b\x01\n"))) == "a b"


SNAPS = [
    ('{"snappedPoints":[{"originalIndex":0,"placeId":"a"}]}', "a"), ("{}", None), ('{"snappedPoints":[]}', None), ("no json", None), (None, None),
    ('{"snappedPoints":[{"originalIndex":1,"placeId":"b"},{"originalIndex":null,"placeId":"a"}]}', "a"),
    ('{"snappedPoints":[{"location":{"latitude":1.5},"originalIndex":0,"placeId":"a"}]}', "a"), ('{"snappedPoints":[{"originalIndex":0,"placeId":null}]}', None),
    ('{"snappedPoints":[{"originalIndex":1,"placeId":"b"},{"originalIndex":0,"placeId":"a"}]}', "a"), ('{"snappedPoints":[{"originalIndex":3,"placeId":"b"}]}', "b"),
    ('{"snappedPoints":[{"originalIndex":0},{"originalIndex":1,"placeId":"b"}]}', None), ('{"snappedPoints":[{"placeId":"b"}]}', "b"),
    ('{"snappedPoints":[{"originalIndex":1,"placeId":"b"},{"originalIndex":"zero","placeId":"a"}]}', "a"),
]


@pytest.mark.parametrize("body,want", SNAPS)
def test_snapped_place(spark, body, want):
    assert one(spark, payloads.snapped_place(F.lit(body).cast("string"))) == want


def place(*components):
    return '{"results":[{"address_components":[' + ",".join(components) + "]}]}"


ROUTES = [
    (place('{"long_name":"A","types":["route"]}', '{"long_name":"B","types":["route"]}'), "A", False), (place('{"long_name":"A","types":["city"]}'), None, False),
    ('{"results":[]}', None, False), ("x", None, False), (place('{"types":["route"]}'), None, True), (place('{"long_name":"C"}', '{"long_name":"D","types":["x","route"]}'), "D", False),
]


@pytest.mark.parametrize("body,name,nameless", ROUTES)
def test_route_name(spark, body, name, nameless):
    assert one(spark, payloads.route_name(F.lit(body))) == name
    assert one(spark, payloads.route_without_name(F.lit(body))) is nameless
