"""Settings with defaults, read from the environment or an env file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Options:
    """Settings; each may be given by an environment variable of its name, in any case.

    Checked and otherwise without effect: ``max_signpost_tokens``, ``max_context_tokens``
    and ``render_js``; ``max_depth``, as crawls name their depth; the Bloom filter's size
    and rate, as URLs are deduplicated exactly.
    """

    # The names and their defaults, so that one environment works everywhere.

    llm_base_url: str = "http://127.0.0.1:8000/v1"
    llm_api_key: str = "sk-local"
    llm_model: str = "qwen2.5-3b-instruct"
    llm_temperature: float = 0.1
    llm_max_tokens: int = 2048
    llm_timeout: float = 120.0
    max_tokens_per_chunk: int = 6000
    max_signpost_tokens: int = 30
    max_context_tokens: int = 4096
    crawl_delay_ms: int = 500
    max_concurrent_requests: int = 5
    max_depth: int = 3
    render_js: bool = True
    user_agent: str = "Mozilla/5.0 (compatible; lexmill)"
    bloom_filter_size: int = 1_000_000
    bloom_filter_fp_rate: float = 0.01
    data_dir: str = "./data"
    api_host: str = "0.0.0.0"
    api_port: int = 8080
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        for name, (least, most) in RANGES.items():
            value = getattr(self, name)
            if not least <= value <= most:
                raise ValueError(f"{name} is {value}; it must be from {least} to {most}")
        if not 0.0 < self.bloom_filter_fp_rate < 1.0:
            raise ValueError("bloom_filter_fp_rate must be between 0 and 1")
        if self.log_level not in LEVELS:
            raise ValueError(f"log_level must be one of {', '.join(LEVELS)}")

    @property
    def raw_dir(self) -> Path:
        return Path(self.data_dir) / "raw"

    @property
    def markdown_dir(self) -> Path:
        return Path(self.data_dir) / "markdown"

    @property
    def index_dir(self) -> Path:
        return Path(self.data_dir) / "index"


# Accepted ranges and log levels.
RANGES = {
    "llm_temperature": (0.0, 2.0),
    "llm_max_tokens": (1, float("inf")),
    "llm_timeout": (1.0, float("inf")),
    "max_tokens_per_chunk": (100, float("inf")),
    "max_signpost_tokens": (10, float("inf")),
    "max_context_tokens": (512, float("inf")),
    "crawl_delay_ms": (0, float("inf")),
    "max_concurrent_requests": (1, 20),
    "max_depth": (1, 10),
    "bloom_filter_size": (1000, float("inf")),
    "api_port": (1, 65535),
}
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def load(env: Mapping[str, str] | None = None, env_file: str = ".env") -> Options:
    """Options from an env file and, before it, the environment; unknown names are ignored."""
    given: dict[str, str] = {}
    if os.path.exists(env_file):
        for line in Path(env_file).read_text(encoding="utf-8").splitlines():
            key, sep, value = line.partition("=")
            if sep and not key.lstrip().startswith("#"):
                given[key.strip().lower()] = value.strip().strip("'\"")
    given |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
    known = {}
    for f in fields(Options):
        if f.name in given:
            text, kind = given[f.name], type(f.default)
            known[f.name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
    return Options(**known)
