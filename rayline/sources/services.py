"""Live services: they only fill lookup tables, which the engine then joins.

A filler maps distinct keys to response bodies, partition by partition, with retries, backoff and a rate limit.
Write what it returns before it is joined: a plan that is run again would ask again.
"""

from __future__ import annotations

import logging
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import Settings

log = logging.getLogger("rayline")
#: Public endpoints of the three services.
MAP_URL = "https://maps.googleapis.com/maps/api/staticmap"
SNAP_URL = "https://roads.googleapis.com/v1/nearestRoads"
PLACE_URL = "https://maps.googleapis.com/maps/api/geocode/json"


def map_request(point_key: str, s: Settings, base: str = MAP_URL) -> str:
    """A raster around a point: everything black, no labels, roads in the settings' colour."""
    styles = ["feature:all|color:0x000000", "feature:all|element:labels|visibility:off", f"feature:road|element:geometry|color:{s.road_color}"]
    query = [("center", point_key), ("scale", s.map_scale), ("zoom", s.map_zoom), ("size", f"{s.map_size}x{s.map_size}"), ("format", "png"), *(("style", x) for x in styles), ("key", s.key)]
    return f"{base}?{urllib.parse.urlencode(query)}"


def snap_request(point_key: str, s: Settings, base: str = SNAP_URL) -> str:
    return f"{base}?{urllib.parse.urlencode([('points', point_key), ('key', s.key)])}"


def place_request(place_id: str, s: Settings, base: str = PLACE_URL) -> str:
    return f"{base}?{urllib.parse.urlencode([('place_id', place_id), ('key', s.key)])}"


def is_retryable(code: int) -> bool:
    return code == 429 or code >= 500


def delay_before(attempt: int, s: Settings) -> float:
    """Seconds to wait before an attempt (the second is the first to wait): twice as long each time."""
    return s.retry_delay_ms / 1000 * 2 ** (attempt - 2) if attempt > 1 else 0.0


def get(url: str, s: Settings, sleep: Callable[[float], None] = time.sleep, retry_all: bool = False) -> bytes:
    """GET with up to max_attempts tries and a delay that doubles.

    Refusals that will not change (4xx but 429) fail at once, unless `retry_all` asks for every failure to be tried
    again.
    """
    for attempt in range(1, s.max_attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=max(s.connect_timeout_s, s.read_timeout_s)) as response:
                return response.read()
        except urllib.error.HTTPError as e:
            wrong = e
            if attempt == s.max_attempts or not (retry_all or is_retryable(e.code)):
                raise
        except OSError as e:
            wrong = e
            if attempt == s.max_attempts:
                raise
        delay = delay_before(attempt + 1, s)
        log.warning("attempt %d of %d failed (%s); the next in %.1f s", attempt, s.max_attempts, wrong, delay)
        sleep(delay)
    raise AssertionError("unreachable")


def fill(keys: DataFrame, key: str, request: Callable[[str, Settings], str], s: Settings, workers: int = 4, binary: bool = False) -> DataFrame:
    """(key, body, error) for each distinct key, asked by at most `workers` tasks that pause between requests."""
    kind = "binary" if binary else "string"
    pause = s.batch_delay_ms / 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for value in b[key]:
                try:
                    body = get(request(value, s), s)
                    rows.append((value, body if binary else body.decode("utf-8", "replace"), None))
                except (OSError, ValueError) as e:
                    log.warning("%s %s: %s", key, value, e)
                    rows.append((value, None, str(e)))
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=[key, "body", "error"])

    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct().repartition(workers)
    return wanted.mapInPandas(run, f"{key} string, body {kind}, error string")
