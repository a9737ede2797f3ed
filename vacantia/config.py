"""Profile and source configuration, read once by the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession

from vacantia import fixed_values as V


@dataclass(frozen=True)
class Config:
    profile: dict
    sources: dict

    @property
    def default_keyword(self) -> str:
        return self.profile["candidat"]["poste_cible"]

    @property
    def forbidden_terms(self) -> list[str]:
        return self.profile.get("deal_breakers") or []

    @property
    def criteria(self) -> dict:
        return self.profile.get("criteres") or {}

    @property
    def max_results(self) -> int:
        params = self.sources["adzuna"].get("search_params") or {}
        return params.get("max_results_par_cible", V.DEFAULT_MAX_RESULTS)

    @property
    def apec(self) -> dict:
        return self.sources.get("apec") or {}

    @property
    def indeed(self) -> dict:
        return self.sources.get("indeed") or {}


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle)


def load_config(profile_path: str | None = None, sources_path: str | None = None) -> Config:
    """Read both files; PROFILE_PATH and SOURCES_PATH override the default places."""
    profile = profile_path or os.getenv("PROFILE_PATH", "config/profile.yaml")
    sources = sources_path or os.getenv("SOURCES_PATH", "config/sources.yaml")
    return Config(_load(profile), _load(sources))


def search_targets(spark: SparkSession, config: Config) -> DataFrame:
    """Search targets as rows; keywords stay as JSON text, being a string or a list."""
    import json

    rows = [
        (
            number,
            target["pays"],
            target["localisation"],
            json.dumps(target.get("mots_cles"), ensure_ascii=False),
        )
        for number, target in enumerate(config.sources["adzuna"].get("cibles") or [])
    ]
    return spark.createDataFrame(rows, "target_no bigint, pays string, localisation string, mots_cles string")
