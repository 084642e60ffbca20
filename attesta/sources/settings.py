"""Settings of a run: loaded from JSON, validated, immutable."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

LEVELS = ("low", "medium", "high", "max")


def valid_think(value: Any) -> bool:
    """Unset, a boolean, or one of the levels."""
    return value is None or isinstance(value, bool) or value in LEVELS


@dataclass(frozen=True)
class Service:
    """Whether and how whoever runs a job manages the model server: not done here, but read, defaulted and passed on."""

    manage: bool = False
    command: str = ""
    startup_timeout_seconds: float = 0
    env: dict[str, str] = field(default_factory=dict)

    @property
    def launch(self) -> str:
        """The command; a managed server without one has the usual one."""
        return self.command or ("ollama" if self.manage else "")

    @property
    def startup_timeout(self) -> float:
        """Seconds to wait for a start, a minute where none are given."""
        return self.startup_timeout_seconds if self.startup_timeout_seconds > 0 else 60.0


@dataclass(frozen=True)
class Settings:
    host: str
    model: str
    chunk_tokens: int
    options: dict[str, Any]
    passes: int = 1
    think: bool | str | None = None
    keep_alive: str = ""
    base_dir: str = "."
    service: Service = field(default_factory=Service)
    extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        checks = {
            "host is empty": bool(self.host), "model is empty": bool(self.model), "think must be a boolean or low, medium, high, max": valid_think(self.think),
            "chunk_tokens must be positive": self.chunk_tokens > 0, "passes must be positive": self.passes > 0, "options are empty": bool(self.options), "options.num_ctx must be positive": self.num_ctx > 0,
        }
        for message, good in checks.items():
            if not good:
                raise ValueError(f"settings: {message}")

    @property
    def num_ctx(self) -> int:
        n = self.options.get("num_ctx") if self.options else None
        return int(n) if isinstance(n, (int, float)) and not isinstance(n, bool) else 0

    def resolve(self, path: str) -> str:
        """A path as it is if absolute, else under the settings' folder; an empty one stays empty."""
        return "" if not path else os.path.normpath(path if os.path.isabs(path) else os.path.join(self.base_dir, path))


def load(folder: str, name: str = "settings.json") -> Settings:
    path = os.path.join(folder, name)
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except FileNotFoundError:
        raise ValueError(f"settings: there is no {path}") from None
    except ValueError as e:
        raise ValueError(f"settings: {path} is no JSON: {e}") from None
    server, service = raw.get("server", {}), raw.get("service") or {}
    return Settings(
        host=server.get("host", ""), model=server.get("model", ""), chunk_tokens=raw.get("chunk_tokens", 0), options=raw.get("options", {}), passes=raw.get("passes", 1),
        think=server.get("think", raw.get("think")), keep_alive=server.get("keep_alive", ""), base_dir=folder, extra=raw,
        service=Service(bool(service.get("manage", False)), service.get("command", ""), service.get("startup_timeout_seconds", 0) or 0, service.get("env") or {}),
    )
