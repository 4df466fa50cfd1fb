"""Settings of a run: from the session's configuration, else from the environment, else their defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Each field is read from ``spark.tessera.<field>``, else from the variable ``TESSERA_<FIELD>``."""

    platform: str = "xiaohongshu"
    top_n: int = 100
    video_slots: int = 20
    judge_url: str = ""
    judge_key: str = ""
    judge_model: str = ""
    https_proxy: str = ""
    cache_days: int = 7
    cache_side: int = 4096

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"spark.tessera.{f.name}", None) or os.environ.get(f"TESSERA_{f.name.upper()}")
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)
