"""Settings of an engine, from the environment or by hand, checked once."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

PREFIX = "QUARRYLIGHT_"


class BadSetting(ValueError):
    """A setting is missing or out of range."""


@dataclass(frozen=True)
class Settings:
    base: str
    dimension: int = 1024
    chunk_size: int = 4000
    overlap: int = 200
    ignore: tuple[str, ...] = field(default=())
    splitter: str = "ast"
    rerank: str = "rrf"
    sync_seconds: int = 60

    def __post_init__(self) -> None:
        checks = (
            (bool(self.base.strip()), "BASE is required"),
            (self.dimension > 0, "DIMENSION has to be positive"),
            (self.chunk_size > 0, "CHUNK_SIZE has to be positive"),
            (0 <= self.overlap < self.chunk_size, "OVERLAP has to be at least 0 and less than CHUNK_SIZE"),
            (self.splitter in ("ast", "text"), "SPLITTER is ast or text"),
            (self.rerank in ("rrf", "scorer"), "RERANK is rrf or scorer"),
            (self.sync_seconds >= 0, "SYNC_SECONDS has to be at least 0"),
        )
        for ok, what in checks:
            if not ok:
                raise BadSetting(PREFIX + what)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env

        def number(name: str, default: int) -> int:
            raw = env.get(PREFIX + name, "").strip()
            try:
                return int(raw) if raw else default
            except ValueError:
                raise BadSetting(f"{PREFIX}{name} is no whole number: {raw}") from None

        return cls(
            env.get(PREFIX + "BASE", ""),
            number("DIMENSION", 1024),
            number("CHUNK_SIZE", 4000),
            number("OVERLAP", 200),
            tuple(p.strip() for p in env.get(PREFIX + "IGNORE", "").split(",") if p.strip()),
            env.get(PREFIX + "SPLITTER", "") or "ast",
            env.get(PREFIX + "RERANK", "") or "rrf",
            number("SYNC_SECONDS", 60),
        )
