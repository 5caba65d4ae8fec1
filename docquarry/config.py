"""The configuration file: JSON with defaults."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

from .sources.sinks import overlaps


@dataclass
class Config:
    data_dir: str = "data"
    language: str = "en"
    api_base: str = ""
    api_key: str = ""
    embedding_model: str = ""
    chat_model: str = ""


def load(path: str) -> Config:
    """The configuration; defaults for a missing file and missing keys, unknown keys are left out."""
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    return Config(**{k.name: given[k.name] for k in fields(Config) if k.name in given})


def save(config: Config, path: str, watched: list[str] = ()) -> None:
    """Write the configuration; a data directory that overlaps a watched one is an error."""
    for w in watched:
        if overlaps(config.data_dir, w):
            raise ValueError(f"{config.data_dir} overlaps {w}")
    fresh = f"{path}.new"
    with open(fresh, "w", encoding="utf-8") as f:
        json.dump(asdict(config), f, indent=1)
    os.replace(fresh, path)
