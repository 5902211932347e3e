"""Settings of an ingest deployment: a TOML file, overridden by ``CONNECTOR__SECTION__KEY`` variables, then checked."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Settings:
    instance_id: int = 0
    total_instances: int = 1
    total_shards: int = 16
    symbols: list[str] = field(default_factory=list)
    max_streams_per_connection: int = 200
    flush_seconds: int = 1
    flush_rows: int = 10_000

    def check(self) -> Settings:
        """Raises ValueError on the first setting out of range."""
        if self.total_instances < 1 or not 0 <= self.instance_id < self.total_instances:
            raise ValueError("instance_id must lie below total_instances")
        if self.total_shards < 1 or self.total_shards & (self.total_shards - 1):
            raise ValueError("total_shards must be a power of two")
        if self.max_streams_per_connection < 1 or self.flush_seconds < 1 or self.flush_rows < 1:
            raise ValueError("limits must be at least 1")
        return self

    def owned_shards(self) -> list[int]:
        return [s for s in range(self.total_shards) if s % self.total_instances == self.instance_id]


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Settings from a file's ``[connector]`` table and the environment."""
    values = tomllib.loads(Path(path).read_text()).get("connector", {}) if path else {}
    for name, text in (os.environ if environment is None else environment).items():
        if name.upper().startswith("CONNECTOR__"):
            key = name[len("CONNECTOR__") :].lower().rsplit("__", 1)[-1]
            if key in Settings.__dataclass_fields__:
                values[key] = text
    kinds = {k: type(getattr(Settings(), k)) for k in Settings.__dataclass_fields__}
    typed = {k: ([x for x in v.split(",") if x] if isinstance(v, str) else list(v)) if kinds[k] is list else kinds[k](v) for k, v in values.items() if k in kinds}
    return Settings(**typed).check()
