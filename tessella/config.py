"""Settings from a file, the environment and the call: later sources win, secrets never come from a file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

PREFIX = "TESSELLA_"
SECRET_WORDS = ("key", "secret", "password", "token_value", "credential")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    confidence_threshold: float = 0.70
    similarity_threshold: float = 0.8
    request_tokens: int = 32_000
    overlap_tokens: int = 1_000
    concurrency: int = 4
    transport_tries: int = 3
    invalid_tries: int = 2
    most_source_bytes: int = 250 * 1024 * 1024
    output: str = "out"

    def __post_init__(self):
        if not 0 <= self.confidence_threshold <= 1 or not 0 < self.similarity_threshold <= 1:
            raise ConfigError("thresholds lie between 0 and 1")
        if self.overlap_tokens < 0 or self.request_tokens <= 2 * self.overlap_tokens:
            raise ConfigError("the overlap must leave room in a request")
        if min(self.concurrency, self.transport_tries, self.invalid_tries, self.most_source_bytes) < 1:
            raise ConfigError("counts and sizes are positive")


_KINDS = {f.name: type(f.default) for f in fields(Config)}


def _typed(source: dict, where: str) -> dict:
    out = {}
    for name, value in source.items():
        if value is None:
            continue
        if name not in _KINDS:
            raise ConfigError(f"{where}: unknown setting {name}")
        kind = _KINDS[name]
        if isinstance(value, str) and kind is not str:
            try:
                value = kind(value)
            except ValueError:
                raise ConfigError(f"{where}: {name} is no {kind.__name__}") from None
        if isinstance(value, bool) or not isinstance(value, (kind, int) if kind is float else kind):
            raise ConfigError(f"{where}: {name} is no {kind.__name__}")
        out[name] = kind(value)
    return out


def resolve(path: str | None = None, environ: dict | None = None, **flags) -> Config:
    """File, then environment (TESSELLA_NAME), then flags; what a source leaves out or gives as None stays as it was."""
    told: dict = {}
    if path:
        with open(path, "rb") as file:
            content = tomllib.load(file)
        if content.pop("version", 1) != 1:
            raise ConfigError("unknown version")
        secret = [k for k in content if any(w in k.lower() for w in SECRET_WORDS)]
        if secret:
            raise ConfigError(f"secrets don't belong in a file: {', '.join(sorted(secret))}")
        told |= _typed(content, path)
    environ = os.environ if environ is None else environ
    told |= _typed({k[len(PREFIX) :].lower(): v for k, v in environ.items() if k.startswith(PREFIX)}, "environment")
    return replace(Config(), **(told | _typed(flags, "call")))
