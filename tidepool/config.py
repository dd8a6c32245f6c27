"""Settings of the message engine: one documented set of defaults; unknown names are an error."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class CleanseSettings:
    min_length: int = 1
    max_length: int = 128
    digit_noise: int = 5  # texts of so many digits and nothing else are noise


@dataclass(frozen=True)
class ClusterSettings:
    centroid_threshold: float = 0.4
    anchor_threshold: float = 0.6
    max_slots: int = 40
    merge_threshold: float = 0.92
    split_threshold: float = 0.50
    maintenance_interval: int = 300
    max_members: int = 50  # even: half from the head, half from the tail
    hot_count: int = 100
    hot_centroid_threshold: float = 0.75
    hot_anchor_threshold: float = 0.82
    hot_merge_threshold: float = 0.94
    hot_split_threshold: float = 0.45
    hot_ttl_seconds: float = 600.0
    keyword_weight: float = 0.7
    keyword_topk: int = 5
    embed_batch: int = 32


@dataclass(frozen=True)
class SimhashSettings:
    ngram: int = 3
    auto_distance: int = 2
    candidate_distance: int = 3
    min_length: int = 8


@dataclass(frozen=True)
class CacheSettings:
    ttl_seconds: float = 600.0
    trusted_count: int = 3


@dataclass(frozen=True)
class Settings:
    cleanse: CleanseSettings = CleanseSettings()
    cluster: ClusterSettings = ClusterSettings()
    simhash: SimhashSettings = SimhashSettings()
    cache: CacheSettings = CacheSettings()

    def with_values(self, values: dict[str, str]) -> Settings:
        """A copy with values by dotted name, as "cluster.max_slots"; each takes the type of its default."""
        out = self
        for name, value in values.items():
            part, _, field = name.partition(".")
            section = getattr(out, part, None)
            if section is None or field not in {f.name for f in fields(section)}:
                raise KeyError(f"no setting {name}")
            out = replace(out, **{part: replace(section, **{field: type(getattr(section, field))(value)})})
        return out

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        """Defaults with the values of a file of sections, as ``cluster: {max_slots: 40}``."""
        import yaml

        said = yaml.safe_load(text) or {}
        return cls().with_values({f"{part}.{name}": str(value) for part, values in said.items() for name, value in (values or {}).items()})

    @classmethod
    def from_session(cls, spark: SparkSession, prefix: str = "spark.tidepool.") -> Settings:
        """Defaults with what the session sets under spark.tidepool."""
        got = dict(spark.sparkContext.getConf().getAll())
        return cls().with_values({k.removeprefix(prefix): v for k, v in got.items() if k.startswith(prefix)})
