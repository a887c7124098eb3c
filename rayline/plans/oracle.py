"""The registered queries again, as SQL for DuckDB over the same tables."""

from __future__ import annotations

FIXES = """
fixes AS (
  SELECT event_id, user_id, ts, value, 37.9::DOUBLE + ((event_id * 7919) % 100000) / 1e6::DOUBLE AS lat,
    23.6::DOUBLE + ((event_id * 104729) % 100000) / 1e6::DOUBLE AS lon FROM events)"""
PAIRS = f"""{FIXES},
lagged AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fixes WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pairs AS (SELECT *, degrees(atan2(sin(radians(lon) - radians(plon)) * cos(radians(lat)),
    cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon) - radians(plon)))) AS raw
  FROM lagged WHERE plat IS NOT NULL)"""


def norm(a: str) -> str:
    return f"(CASE WHEN ({a}) % 360.0::DOUBLE < 0 THEN ({a}) % 360.0::DOUBLE + 360.0::DOUBLE ELSE ({a}) % 360.0::DOUBLE END)"


def project(lat: str, lon: str, dist: str, angle: str) -> tuple[str, str]:
    s, f1, t = f"(({dist}) / 6371000.0::DOUBLE)", f"radians({lat})", f"radians({angle})"
    f2 = f"asin(sin({f1}) * cos({s}) + cos({f1}) * sin({s}) * cos({t}))"
    l2 = f"(radians({lon}) + atan2(sin({t}) * sin({s}) * cos({f1}), cos({s}) - sin({f1}) * sin({f2})))"
    turn = f"(({l2} + pi()) % (2 * pi()))"
    return f"degrees({f2})", f"degrees(CASE WHEN {turn} < 0 THEN {turn} + 2 * pi() ELSE {turn} END - pi())"


def ray(rows: str, key: str, angle: str, size: int = 160, skip: int = 50, one_in: int = 61, steps: int = 65) -> str:
    """(key, metres) of the first hit on a mask for each row of `rows`; rays without a hit are left out."""
    a = f"radians((({angle}) + 270.0::DOUBLE) % 360.0::DOUBLE)"
    return f"""
  SELECT {key}, ({skip} + k)::DOUBLE * 0.265::DOUBLE AS metres FROM (
    SELECT {key}, cx, sx, min(k) AS k FROM (
      SELECT {key}, cx, sx, k, {size / 2}::DOUBLE + ({skip} + k) * cx AS x, {size / 2}::DOUBLE + ({skip} + k) * sx AS y
      FROM (SELECT {key}, cos({a}) AS cx, sin({a}) AS sx FROM {rows}) r, unnest(range(0, {steps})) AS u(k)) s
    WHERE x >= 0 AND x < {size} AND y >= 0 AND y < {size}
      AND (floor(x + 1e-9::DOUBLE)::BIGINT * 7919 + floor(y + 1e-9::DOUBLE)::BIGINT * 104729) % {one_in} = 0
    GROUP BY {key}, cx, sx) h"""


#: The masks of the queries: production size, and that of tables of rasters.
FULL = {"size": 1000, "skip": 50, "one_in": 499, "steps": 659}
TILE = {"size": 32, "skip": 4, "one_in": 17, "steps": 20}


def both_rays(mask: dict, has_raster: str = "true") -> str:
    """Common table expressions up to c: each pair's angles and both hits, the rays of pairs without a raster left out."""
    return f"""{PAIRS}, h AS (SELECT *, {norm('raw')} AS b FROM pairs),
g AS MATERIALIZED (SELECT *, {norm('b - 25.0::DOUBLE')} AS la, {norm('b + 25.0::DOUBLE')} AS ra FROM h), v AS (SELECT * FROM g WHERE {has_raster}),
l AS ({ray('v', 'event_id', 'la', **mask)}), r AS ({ray('v', 'event_id', 'ra', **mask)}),
c AS (SELECT g.event_id, g.lat, g.lon, la, ra, l.metres AS lm, r.metres AS rm,
  l.metres IS NOT NULL AND (r.metres IS NULL OR l.metres <= r.metres) AS use_left, l.metres IS NULL AND r.metres IS NULL AS nohit
  FROM g LEFT JOIN l USING (event_id) LEFT JOIN r USING (event_id))"""


def detected(mask: dict) -> str:
    return f"""
WITH {both_rays(mask)},
d AS (SELECT *, CASE WHEN nohit THEN 0 WHEN use_left THEN lm ELSE rm END AS d, CASE WHEN nohit THEN 0 WHEN use_left THEN la ELSE ra END AS a,
  CASE WHEN use_left THEN rm ELSE lm END AS ad, CASE WHEN nohit THEN 0 WHEN use_left THEN ra ELSE la END AS aa FROM c)
SELECT event_id, round(d, 6) AS distance, round(a, 6) AS angle, round(ad, 6) AS alt_distance, round(aa, 6) AS alt_angle,
  round(CASE WHEN nohit THEN lat ELSE {_t[0]} END, 7) AS target_lat, round(CASE WHEN nohit THEN lon ELSE {_t[1]} END, 7) AS target_lon FROM d"""


def arrow_scan(**mask: int) -> str:
    return f"""
WITH a AS MATERIALIZED (SELECT event_id, {ANGLE} AS la, {norm(ANGLE + ' + 50.0::DOUBLE')} AS ra FROM events),
l AS ({ray('a', 'event_id', 'la', **mask)}), r AS ({ray('a', 'event_id', 'ra', **mask)})
SELECT event_id, round(l.metres, 6) AS left_metres, round(r.metres, 6) AS right_metres FROM a LEFT JOIN l USING (event_id) LEFT JOIN r USING (event_id)"""


def first_hit(**mask: int) -> str:
    return f"WITH h AS ({ray('events', 'event_id', ANGLE, **mask)}) SELECT e.event_id, round(h.metres, 6) AS metres FROM events e LEFT JOIN h USING (event_id)"


def road_name(prefix: str) -> str:
    """What the places of detect_tables are called: the seventh has no name, the ninth is no road."""
    return f"CASE WHEN event_id % 11 NOT IN (7, 9) THEN 'Road {prefix}' || (event_id % 11) END"


def normal(c: str) -> str:
    out = f"regexp_replace(lower(regexp_replace(regexp_replace({c}, '^[\\x00-\\x20]+', ''), '[\\x00-\\x20]+$', '')), '\\s+', ' ', 'g')"
    for a, b in (("ou", "u"), ("ch", "k"), ("th", "t"), ("ph", "f"), ("ai", "e"), ("ei", "i"), ("oi", "i"), ("x", "k"), ("w", "o")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def rule(a: str, b: str) -> str:
    """The match rule of two expressions, for rows that have their normal forms in columns."""
    x, y = normal(a), normal(b)
    last = lambda s: f"regexp_extract({s}, '[^ ]*$')"
    return f"""(CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = 'UNKNOWN' OR {b} = 'UNKNOWN' THEN 0 WHEN {x} = {y} THEN 1
    WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 2 WHEN levenshtein({last(x)}, {last(y)}) <= 2 THEN 3
    WHEN levenshtein({x}, {y}) <= greatest(2, trunc(least(length({x}), length({y})) * 0.3::DOUBLE)) THEN 4 ELSE 0 END)"""


NAME_PAIRS = "names AS (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"

SCORED = f"""
scored AS (
  SELECT p_partkey::INT AS row_number, p_name AS target_road, p_type AS current_road, p_brand AS city,
    CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS road_name,
    CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN 'x' || p_name ELSE p_brand END AS alternative_road_name,
    CASE WHEN p_partkey % 11 = 0 THEN 'no raster for this position' END AS error FROM part),
named AS (SELECT *, coalesce(road_name, 'UNKNOWN') AS p, coalesce(alternative_road_name, 'UNKNOWN') AS o FROM scored),
hit AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 3 WHEN {rule('p', 'target_road')} > 0 THEN 0 WHEN {rule('o', 'target_road')} > 0 THEN 1 ELSE 2 END AS h FROM named),
evaluated AS (
  SELECT row_number, target_road, current_road, city, road_name, alternative_road_name,
    CASE h WHEN 3 THEN 'ERROR' WHEN 2 THEN 'FAIL' ELSE 'PASS' END AS outcome,
    CASE h WHEN 3 THEN '' WHEN 0 THEN p WHEN 1 THEN o ELSE p || ' / ' || o END AS detected_road, 0 AS iterations, h = 1 AS alternative_used,
    CASE h WHEN 3 THEN error WHEN 2 THEN 'Wrong road on both directions' END AS error_message,
    error IS NULL AND {rule('p', 'current_road')} > 0 AS primary_is_current_road FROM hit)"""

TALLIES = """count(*) AS total, count(*) FILTER (outcome = 'PASS') AS passed, count(*) FILTER (outcome = 'PASS' AND NOT alternative_used) AS passed_direct,
  count(*) FILTER (outcome = 'PASS' AND alternative_used) AS passed_alternative, count(*) FILTER (outcome = 'FAIL') AS failed,
  count(*) FILTER (outcome = 'ERROR') AS errors, round(count(*) FILTER (outcome = 'PASS') * 100.0::DOUBLE / count(*), 6) AS success_rate"""

CASE_LINES = """
labelled AS (SELECT *, rpad(CASE WHEN outcome = 'PASS' AND alternative_used THEN 'PASS (alt)' ELSE outcome END, 15, ' ') AS label FROM evaluated),
l AS (SELECT row_number, '  #' || CASE WHEN row_number < 1000 THEN lpad(row_number::VARCHAR, 3, '0') ELSE row_number::VARCHAR END || ' | ' || label || ' | Target: '
  || CASE WHEN length(target_road) < 25 THEN rpad(target_road, 25, ' ') ELSE target_road END || ' | Got: ' || detected_road AS line, label FROM labelled)"""

#: The counted lines of the summary, from the fourth on.
COUNTS = (("PASS (direct):", "passed_direct"), ("PASS (alternative):", "passed_alternative"), ("PASS (total):", "passed"), ("FAIL:", "failed"), ("ERROR:", "errors"))
COUNT_ROWS = ", ".join(f"{{'i': {i}, 'label': '{label}', 'n': {name}}}" for i, (label, name) in enumerate(COUNTS, 4))

COORD = """(CASE event_id % 6 WHEN 0 THEN (37 + event_id % 5) || ', 23.' || (event_id % 1000) WHEN 1 THEN ' ' || (37 + event_id % 5) || ' ,23.' || (event_id % 1000) || ','
  WHEN 2 THEN (37 + event_id % 5) || ',23.' || (event_id % 1000) || ',5' WHEN 3 THEN (37 + event_id % 5)::VARCHAR
  WHEN 4 THEN 'x' || (37 + event_id % 5) || ',23.' || (event_id % 1000) ELSE '' END)"""


def coord_parts(c: str) -> str:
    return f"string_split(regexp_replace({c}, ',+$', ''), ',')"


def component(types: str, name: str) -> str:
    return f"""'{{"long_name":"' || {name} || '","types":{types}}}'"""


def place_body(name: str, kind: str) -> str:
    w = lambda inner: f"""'{{"results":[{{"address_components":[' || {inner} || ']}}]}}'"""
    locality, route = '["locality"]', '["route"]'
    return f"""(CASE {kind} WHEN 0 THEN {w(component(locality, "'Athens'") + " || ',' || " + component('["route","x"]', name))}
  WHEN 1 THEN {w(component(route, name) + " || ',' || " + component(route, "'second'"))} WHEN 2 THEN {w(component(locality, name))}
  ELSE '{{"results":[],"status":"ZERO_RESULTS"}}' END)"""


def route(body: str) -> str:
    comps = f"""from_json(json_extract({body}, '$.results[0].address_components'), '[{{"long_name":"VARCHAR","types":["VARCHAR"]}}]')"""
    return f"(list_filter({comps}, lambda c: list_contains(c.types, 'route'))[1]).long_name"


ANGLE = "((event_id * 37 % 360)::DOUBLE + 0.3::DOUBLE)"
_p = project("lat", "lon", "abs(value) * 10.0::DOUBLE", "(event_id * 37 % 360)::DOUBLE")
_t = project("lat", "lon", "d", "a")

SQL = {
    "geo_bearing": f"WITH {PAIRS} SELECT event_id, round({norm('raw')}, 6) AS bearing FROM pairs",
    "geo_search_angles": f"WITH {PAIRS}, h AS (SELECT event_id, {norm('raw')} AS b FROM pairs) SELECT event_id, round({norm('b - 25.0::DOUBLE')}, 6) AS left_angle, round({norm('b + 25.0::DOUBLE')}, 6) AS right_angle FROM h",
    "geo_project_point": f"WITH {FIXES} SELECT event_id, round({_p[0]}, 7) AS lat, round({_p[1]}, 7) AS lon FROM fixes",
    "geo_to_pixel": f"""
WITH r AS (SELECT event_id, (value + 0.0123::DOUBLE) / 0.265::DOUBLE AS m, radians(({ANGLE} + 270.0::DOUBLE) % 360.0::DOUBLE) AS a FROM events),
p AS (SELECT event_id, floor(500.0::DOUBLE + m * cos(a) + 0.5::DOUBLE)::INT AS x, floor(500.0::DOUBLE + m * sin(a) + 0.5::DOUBLE)::INT AS y FROM r)
SELECT event_id, x, y, round(sqrt(((x - 500) * (x - 500) + (y - 500) * (y - 500))::DOUBLE) * 0.265::DOUBLE, 6) AS metres FROM p""",
    "raster_ray_first_hit": first_hit(),
    "raster_ray_full": first_hit(**FULL),
    "raster_pixel_predicate": """
WITH p AS (SELECT event_id, event_id * 31 % 60 AS r, event_id * 17 % 256 AS g, event_id * 13 % 60 AS b FROM events)
SELECT event_id, g > 200 AND r < 50 AND b < 50 AS road, r >= 5 AND r < 55 AND b >= 5 AND b < 45 AS inside FROM p""",
    "detect_primary_alternative": detected({}),
    "detect_full_raster": detected(FULL),
    "detect_tables": f"""
WITH {both_rays(TILE, 'event_id % 13 <> 0 AND event_id % 17 <> 0')},
d AS (SELECT *, CASE WHEN nohit THEN 0 WHEN use_left THEN lm ELSE rm END AS d, CASE WHEN use_left THEN rm ELSE lm END AS ad, NOT nohit AND event_id % 5 <> 0 AS has_main FROM c),
e AS (SELECT *, ad IS NOT NULL AND event_id % 4 <> 0 AS has_other FROM d)
SELECT event_id, round(d, 6) AS distance, round(ad, 6) AS alt_distance, CASE WHEN has_main THEN {road_name('p')} END AS road_name, CASE WHEN has_other THEN {road_name('q')} END AS alternative_road_name,
  CASE WHEN event_id % 13 = 0 THEN 'no raster for this position' WHEN event_id % 17 = 0 THEN 'raster could not be decoded'
  WHEN (has_main OR has_other) AND event_id % 11 = 7 THEN 'route without a name' END AS error FROM e""",
    "multi_angle_sweep": f"""
WITH {PAIRS}, o AS (SELECT event_id, x.o::DOUBLE AS "offset", {norm('raw')} AS b FROM pairs, unnest([-50, -25, 25, 50]) AS x(o)),
g AS MATERIALIZED (SELECT event_id, "offset", {norm('b + "offset"')} AS a FROM o),
h AS MATERIALIZED ({ray('g', 'event_id, "offset"', 'a')})
SELECT g.event_id, g."offset", round(h.metres, 6) AS metres FROM g LEFT JOIN h USING (event_id, "offset")""",
    "name_normalize": "SELECT p_partkey, " + normal("(chr(32) || chr(9) || p_name || '  Xouthai  ' || p_type || ' ' || chr(10))") + " AS normal FROM part",
    "name_fuzzy_rule": f"WITH {NAME_PAIRS} SELECT p_partkey, {rule('a', 'b')}::INT AS rule FROM names",
    "name_primitives": f"""
WITH {NAME_PAIRS} SELECT p_partkey, levenshtein(a, b)::INT AS edits, contains(a, b) OR contains(b, a) AS contained, regexp_extract(a, '[^ ]*$') AS last_word,
  greatest(2, trunc(least(length(a), length(b)) * 0.3::DOUBLE))::INT AS edit_limit, lower(a) = lower(b) AS same FROM names""",
    "json_snap_place": "SELECT event_id, CASE WHEN event_id % 6 <= 2 THEN 'p' || (event_id % 97) END AS place_id FROM events",
    "json_route_name": f"SELECT event_id, {route(place_body('event_type', 'event_id % 4'))} AS road_name FROM events",
    "lookup_road_names": f"""
WITH k AS (SELECT DISTINCT 'p' || user_id AS point_key FROM events),
s AS (SELECT 'p' || s_suppkey AS point_key, 'n' || s_nationkey AS place_id FROM supplier),
n AS (SELECT 'n' || n_nationkey AS place_id, {route(place_body('n_name', 'n_nationkey % 4'))} AS road_name FROM nation)
SELECT k.point_key, s.place_id, n.road_name FROM k LEFT JOIN s USING (point_key) LEFT JOIN n USING (place_id)""",
    "lookup_missing_keys": "SELECT DISTINCT 'p' || user_id AS point_key FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)",
    "evaluate_outcome": f"WITH {SCORED} SELECT row_number, outcome, detected_road, iterations, alternative_used, error_message, primary_is_current_road FROM evaluated",
    "report_summary": f"WITH {SCORED} SELECT {TALLIES} FROM evaluated",
    "report_by_group": f"WITH {SCORED} SELECT city, outcome, {TALLIES} FROM evaluated GROUP BY ROLLUP (city, outcome)",
    "report_case_lines": f"WITH {SCORED}, {CASE_LINES} SELECT row_number, line, label FROM l",
    "coord_parse": f"""
WITH c AS (SELECT event_id, {coord_parts(COORD)} AS q FROM events),
v AS (SELECT event_id, len(q) = 2 AND try_cast(trim(q[1]) AS DOUBLE) IS NOT NULL AND try_cast(trim(q[2]) AS DOUBLE) IS NOT NULL AS ok, q FROM c)
SELECT event_id, CASE WHEN ok THEN trim(q[1])::DOUBLE END AS lat, CASE WHEN ok THEN trim(q[2])::DOUBLE END AS lon FROM v""",
    "csv_parse_lines": f"""
WITH c AS (SELECT event_id, {coord_parts(COORD)} AS q FROM events),
v AS (SELECT event_id, trim(q[1]) AS lat FROM c WHERE len(q) = 2 AND try_cast(trim(q[1]) AS DOUBLE) IS NOT NULL AND try_cast(trim(q[2]) AS DOUBLE) IS NOT NULL)
SELECT event_id, lat::DOUBLE AS prev_lat, (38 + event_id % 3 + 0.5)::DOUBLE AS cur_lat, CASE event_id % 5 WHEN 0 THEN 'A road' WHEN 1 THEN 'A' ELSE '' END AS current_road,
  CASE event_id % 5 WHEN 0 THEN 'Target' WHEN 1 THEN 'B' ELSE '' END AS target_road, CASE event_id % 5 WHEN 0 THEN 'Athens' WHEN 1 THEN '' ELSE 'Patra' END AS city
FROM v WHERE event_id % 5 IN (0, 1, 4)""",
    "csv_format_rows": f"""
WITH {SCORED} SELECT row_number, row_number || ';"' || (37.5::DOUBLE + row_number % 8 / 4.0::DOUBLE) || ',23.25";"' || (37.5::DOUBLE + (row_number + 1) % 8 / 4.0::DOUBLE) || ',23.25";'
  || current_road || ';' || target_road || ';' || detected_road || ';' || outcome || ';0;' || CASE WHEN alternative_used THEN 'YES' ELSE 'NO' END || ';' || city AS line FROM evaluated""",
    "text_labels": """
WITH r AS (SELECT event_id, event_type, 37.9::DOUBLE + event_id % 1000 / 1e4::DOUBLE AS lat, 23.6::DOUBLE + event_id % 777 / 1e4::DOUBLE AS lon FROM events)
SELECT event_id, printf('BearingAngles[left=%.2f°, right=%.2f°]', (event_id % 360 + 0.456)::DOUBLE, (event_id % 90 + 0.111)::DOUBLE) AS angles,
  'DetectionResult {' || chr(10) || printf('  currentPosition  = GeoPoint[lat=%.6f, lon=%.6f]', lat, lon) || chr(10) || printf('  targetPoint      = GeoPoint[lat=%.6f, lon=%.6f]', lon, lat)
  || chr(10) || printf('  distance         = %.2f m', (event_id % 500 + 0.123)::DOUBLE) || chr(10) || printf('  searchAngle      = %.2f°', (event_id % 360 + 0.456)::DOUBLE)
  || chr(10) || '  road             = ' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END
  || chr(10) || '  alternativeRoad  = ' || CASE WHEN event_id % 5 = 0 THEN 'Kosma' ELSE 'unknown' END
  || printf(' (%.2f m, %.2f°)', (CASE WHEN event_id % 3 > 0 THEN event_id % 50 + 0.789 ELSE 0 END)::DOUBLE, (event_id % 90 + 0.111)::DOUBLE) || chr(10) || '}' AS result FROM r""",
    "debug_caption": f"""
WITH {SCORED} SELECT row_number, 'Case #' || CASE WHEN row_number < 1000 THEN lpad(row_number::VARCHAR, 3, '0') ELSE row_number::VARCHAR END || ' — ' || CASE WHEN lower(road_name) = lower(target_road) THEN 'MATCH' ELSE 'MISMATCH' END
  || '|Expected cross-street:  ' || target_road || '|Detected (yellow):      ' || coalesce(upper(road_name), '(none)')
  || '|Alternative (cyan):     ' || coalesce(alternative_road_name, '(none)') || '|White arrow = heading  •  Red cross = current position' AS caption FROM scored""",
    "raster_arrow_scan": arrow_scan(),
    "raster_arrow_full": arrow_scan(**FULL),
    "case_file_rows": f"""
WITH n AS (SELECT *, event_id % 7 = 0 AS blank FROM events WHERE event_id > (SELECT min(event_id) FROM events)),
c AS (SELECT event_id, row_number() OVER (ORDER BY event_id)::INT AS row_number, {coord_parts(COORD)} AS q FROM n WHERE NOT blank),
v AS (SELECT *, len(q) = 2 AND try_cast(trim(q[1]) AS DOUBLE) IS NOT NULL AND try_cast(trim(q[2]) AS DOUBLE) IS NOT NULL AS ok FROM c)
SELECT row_number, 'road ' || event_id AS current_road, 'Target' AS target_road, 'Athens' AS city, CASE WHEN ok THEN trim(q[1])::DOUBLE END AS prev_lat,
  CASE WHEN NOT ok THEN 'bad previous coordinates' END AS reason FROM v""",
    "overlay_layers": """
SELECT p_partkey, '255,0,0' AS centre, '255,0,0' AS cross_end, '255,220,0' AS main, '0,255,255' AS other, '255,220,0' AS ring, '25,25,25' AS box,
  '100,100,100' AS plain, true AS arrow_reaches FROM part""",
    "png_decode": """
WITH s AS (SELECT event_id, event_id % 10 = 0 AS bad, (4 + event_id % 9)::INT AS w, (5 + event_id % 7)::INT AS h FROM events),
p AS (
  SELECT event_id, sum((x * 3 + event_id) % 256)::BIGINT AS red, sum((y * 5 + x) % 256)::BIGINT AS green, sum(x * y % 256)::BIGINT AS blue
  FROM s, unnest(range(0, 12)) AS a(x), unnest(range(0, 11)) AS b(y) WHERE NOT bad AND x < w AND y < h GROUP BY event_id)
SELECT s.event_id, CASE WHEN bad THEN -1 ELSE w END AS width, CASE WHEN bad THEN -1 ELSE h END AS height, CASE WHEN bad THEN -1 ELSE 3 END AS channels,
  coalesce(red, 0)::BIGINT AS red, coalesce(green, 0)::BIGINT AS green, coalesce(blue, 0)::BIGINT AS blue FROM s LEFT JOIN p USING (event_id)""",
    "report_text": f"""
WITH {SCORED}, {CASE_LINES}, t AS (SELECT {TALLIES} FROM evaluated),
n AS (SELECT unnest([{COUNT_ROWS}]) AS c, total FROM t)
SELECT -4 + i AS position, x AS line FROM (SELECT unnest(['', repeat('=', 90), '  EVALUATION RESULTS', repeat('=', 90)]) AS x, unnest(range(0, 4)) AS i)
UNION ALL SELECT row_number::BIGINT, line FROM l
UNION ALL SELECT 1099511627776 + i, x FROM (SELECT unnest(['', repeat('=', 90), '  SUMMARY', repeat('=', 90)]) AS x, unnest(range(0, 4)) AS i)
UNION ALL SELECT 1099511627776 + c.i, '  ' || rpad(c.label, 20, ' ') || ' ' || c.n || '/' || total FROM n
UNION ALL SELECT 1099511627785, '  Success rate:        ' || printf('%.1f', success_rate) || '%' FROM t
UNION ALL SELECT 1099511627786, repeat('=', 90)""",
    "default_pair": f"""
WITH p AS (SELECT 37.988988::DOUBLE AS lat, 23.741867::DOUBLE AS lon, 37.988891::DOUBLE AS plat, 23.741949::DOUBLE AS plon),
r AS (SELECT *, degrees(atan2(sin(radians(lon) - radians(plon)) * cos(radians(lat)),
    cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon) - radians(plon)))) AS raw FROM p),
b AS (SELECT *, {norm('raw')} AS b FROM r), d AS (SELECT *, 26.5::DOUBLE AS d, {norm('b - 25.0::DOUBLE')} AS a FROM b)
SELECT round(b, 6) AS bearing, round(a, 6) AS left_angle, round({norm('b + 25.0::DOUBLE')}, 6) AS right_angle, round({_t[0]}, 7) AS lat, round({_t[1]}, 7) AS lon FROM d""",
    "retry_rules": """
WITH c AS (SELECT event_id, (400 + event_id % 200)::BIGINT AS code, (1 + event_id % 5)::BIGINT AS attempt FROM events)
SELECT *, code = 429 OR code >= 500 AS retried, CASE WHEN attempt = 1 THEN 0.0 ELSE 0.5 * 2 ** (attempt - 2) END::DOUBLE AS wait FROM c""",
    "settings_rows": """
SELECT * FROM (VALUES ('api_key', 'k1'), ('map_scale', '2'), ('map_zoom', '18'), ('map_size', '500'), ('road_color', '${NONE}'), ('skip_pixels', '40'), ('step_size', '0.5'),
  ('metres_per_pixel', '0.265'), ('angle_offset', '25.0'), ('connect_timeout_s', '10'), ('read_timeout_s', '10'), ('max_attempts', '3'), ('retry_delay_ms', '1000'),
  ('batch_delay_ms', '250')) AS v("field", "value")""",
}
