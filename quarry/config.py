"""Configuration from the environment, and session settings."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from quarry.sources.store import check_project


@dataclass
class ProjectConfig:
    name: str
    root: str = "."

    def __post_init__(self) -> None:
        self.name = check_project(self.name)

    @classmethod
    def from_path(cls, path: str) -> ProjectConfig:
        name = re.sub(r"[^a-zA-Z0-9_-]", "_", os.path.basename(os.path.abspath(path)))[:100]
        return cls(name or "project", path)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> ProjectConfig:
        env = os.environ if env is None else env
        root = env.get("REPOSITORY_PATH", ".")
        return cls(env["PROJECT_NAME"], root) if env.get("PROJECT_NAME") else cls.from_path(root)


@dataclass
class EmbeddingConfig:
    provider: str = "hash"
    model: str | None = None
    dimensions: int = 16

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EmbeddingConfig:
        env = os.environ if env is None else env
        return cls(env.get("EMBEDDING_PROVIDER", "hash"), env.get("EMBEDDING_MODEL"), int(env.get("EMBEDDING_DIMENSIONS", "16")))


@dataclass
class Config:
    project: ProjectConfig
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    store: str = "index"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        return cls(ProjectConfig.from_env(env), EmbeddingConfig.from_env(env), env.get("STORE_PATH", "index"))


#: Adaptive execution splits skewed joins and coalesces small partitions; times are UTC.
SESSION = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}


def session(name: str = "quarry") -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SESSION).getOrCreate()
