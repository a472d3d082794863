"""Settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    store_path: str = "data/store"
    index_path: str = "data/index"
    sample_path: str = "data/sample.jsonl"

    @classmethod
    def from_env(cls) -> Settings:
        read = os.environ.get
        return cls(read("STORE_PATH", cls.store_path), read("INDEX_PATH", cls.index_path), read("SAMPLE_PATH", cls.sample_path))
