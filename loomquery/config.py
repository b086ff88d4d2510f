"""Settings from a mapping (the environment by default), with strict spellings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from loomquery.errors import EngineError


class ConfigError(EngineError):
    """A setting cannot be read."""


def boolean(name: str, text: str) -> bool:
    low = text.strip().lower()
    if low in ("1", "true", "yes", "on"):
        return True
    if low in ("0", "false", "no", "off"):
        return False
    raise ConfigError(f"{name}: {text!r} is no boolean")


@dataclass(frozen=True)
class Config:
    """LOOM_DATA: folder of Parquet tables; LOOM_JDBC_URL: a database instead; LOOM_TIMEOUT_S: seconds a query may take, 0 for no limit; LOOM_CACHE: folder of plan and relationship caches; LOOM_STRICT: min, max and median need numbers."""

    data: str | None = None
    jdbc_url: str | None = None
    timeout_s: float = 30.0
    cache: str | None = None
    strict: bool = False

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        try:
            timeout = float(env.get("LOOM_TIMEOUT_S", "30"))
        except ValueError as e:
            raise ConfigError(f"LOOM_TIMEOUT_S: {env['LOOM_TIMEOUT_S']!r} is no number") from e
        if timeout < 0:
            raise ConfigError("LOOM_TIMEOUT_S is below 0")
        data, url = env.get("LOOM_DATA") or None, env.get("LOOM_JDBC_URL") or None
        if data and url:
            raise ConfigError("LOOM_DATA and LOOM_JDBC_URL exclude one another")
        return cls(data, url, timeout, env.get("LOOM_CACHE") or None, boolean("LOOM_STRICT", env.get("LOOM_STRICT", "false")))
