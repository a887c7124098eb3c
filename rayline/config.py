"""Settings: a frozen record, read from properties text with environment placeholders."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cache

#: Property of each field.
KEYS = {
    "api_key": "google.maps.api.key",
    "map_scale": "staticmap.scale",
    "map_zoom": "staticmap.zoom",
    "map_size": "staticmap.size",
    "road_color": "staticmap.road.color",
    "skip_pixels": "image.skip.pixels",
    "step_size": "image.step.size",
    "metres_per_pixel": "image.scale",
    "angle_offset": "detection.angle.offset",
    "connect_timeout_s": "http.connect.timeout.seconds",
    "read_timeout_s": "http.read.timeout.seconds",
    "max_attempts": "api.retry.max.attempts",
    "retry_delay_ms": "api.retry.initial.delay.ms",
    "batch_delay_ms": "batch.delay.ms",
}


@dataclass(frozen=True)
class Settings:
    """Every field but the key has a default; the key is needed only by live services."""

    api_key: str = ""
    map_scale: int = 2
    map_zoom: int = 18
    map_size: int = 500
    road_color: str = "0x00ff00"
    skip_pixels: int = 50
    step_size: float = 1.0
    metres_per_pixel: float = 0.265
    angle_offset: float = 25.0
    connect_timeout_s: int = 10
    read_timeout_s: int = 10
    max_attempts: int = 3
    retry_delay_ms: int = 1000
    batch_delay_ms: int = 1000

    def __post_init__(self) -> None:
        if self.step_size <= 0:
            raise ValueError("image.step.size must be positive: a ray would never end")
        if self.max_attempts < 1:
            raise ValueError("api.retry.max.attempts must be 1 or more")

    @property
    def key(self) -> str:
        """The service key; an error if it is missing or its placeholder was not filled."""
        if not self.api_key.strip() or self.api_key.startswith("${"):
            raise ValueError(f"{KEYS['api_key']} is not set")
        return self.api_key


def parse_properties(text: str) -> dict[str, str]:
    """Key and value around the first `=` or `:` of each line; # and ! start comments."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            key, _, value = line.partition("=") if "=" in line else line.partition(":")
            out[key.strip()] = value.strip()
    return out


def fill_placeholders(values: Mapping[str, str], env: Mapping[str, str]) -> dict[str, str]:
    """Replace values that are `${NAME}` as a whole; names that are not set stay as they are."""
    name = lambda v: m[1] if (m := re.fullmatch(r"\$\{(.+)\}", v)) else None
    return {k: env.get(name(v), v) if name(v) else v for k, v in values.items()}


def load(path: str, env: Mapping[str, str] | None = None) -> Settings:
    """Settings from a properties file; FileNotFoundError if there is none, ValueError for a bad number."""
    with open(path, encoding="utf-8") as f:
        return settings_of(f.read(), os.environ if env is None else env)


def settings_of(text: str, env: Mapping[str, str]) -> Settings:
    """Settings from properties text; what it does not name has its default."""
    values = fill_placeholders(parse_properties(text), env)
    kinds = {f: type(getattr(Settings, f)) for f in KEYS}
    return Settings(**{f: kinds[f](values[k]) for f, k in KEYS.items() if k in values})


@cache
def shared(path: str) -> Settings:
    """One record per file and process."""
    return load(path)
