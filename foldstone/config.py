"""Settings (A19, E16): nested or dotted keys, ``${NAME}`` from the environment."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields

TRUE = ("1", "true", "yes", "on")
_ENV = re.compile(r"\$\{(\w+)\}")


@dataclass(frozen=True)
class Settings:
    """What an engine can be told; the values are the usual ones."""

    max_top_k: int = 50
    embedding_dimensions: int = 32
    rate_limit_per_second: int = 200
    kv_batch_max_records: int = 1000
    default_collection: str = "documents"
    ai_backend: str = "auto"
    node_id: str = "node-local"
    replication_factor: int = 1
    migration_delete_delay_ms: int = 300_000
    migration_batch_size: int = 100
    migration_max_retries: int = 5
    cluster_slot_count: int = 4096
    read_only_mode: bool = False
    enable_demo_data: bool = True
    cluster_nodes: str = "node-local@127.0.0.1:8080"
    model_path: str = ""
    tokenizer_path: str = ""
    ai_max_tokens: int = 256
    search_lists: int = 0
    search_probes: int = 0


def expand(text: str, environment: dict[str, str] | None = None) -> str:
    """``${NAME}`` replaced; names that are not set give nothing."""
    env = os.environ if environment is None else environment
    return _ENV.sub(lambda m: env.get(m[1], ""), text)


def parse_bool(text: str) -> bool:
    return text.strip().lower() in TRUE


def parse(text: str, environment: dict[str, str] | None = None) -> Settings:
    """Settings from lines ``key: value``, nested by indent or dotted; the last part of a
    key names the setting, unknown ones are passed over. A bad number is an error."""
    known = {f.name: type(f.default) for f in fields(Settings)}
    out, problems = {}, []
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).strip()
        key, colon, value = bare.partition(":")
        name = key.strip().rsplit(".", 1)[-1]
        if not colon or not value.strip() or name not in known:
            continue
        value = expand(value.strip().strip("\"'"), environment)
        try:
            out[name] = parse_bool(value) if known[name] is bool else known[name](value)
        except ValueError:
            problems.append(f"{name}: {value!r}")
    if problems:
        raise ValueError("bad settings: " + ", ".join(problems))
    return Settings(**out)


def load(path: str, environment: dict[str, str] | None = None) -> Settings:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), environment)
