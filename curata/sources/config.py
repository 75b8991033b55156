"""The classification config: a YAML file with folders and categories."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "pos int, name string, compoundCategory array<string>, priority int, description string"


class ConfigError(ValueError):
    """The config can't be read or breaks a rule."""


@dataclass
class Config:
    work_directory: str
    output_directory: str | None
    rows: list[dict] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, r["name"], r["compoundCategory"], r["priority"], r["description"]) for i, r in enumerate(self.rows)], ROW)


def load_config(path: str) -> Config | None:
    """The config of a YAML file, checked; None if there is no such file."""
    import yaml

    if not os.path.isfile(path):
        return None
    try:
        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(str(e)) from e
    return check_config(raw)


def check_config(raw: dict) -> Config:
    work = raw.get("workDirectory")
    if not work or not str(work).strip():
        raise ConfigError("workDirectory is missing")
    if not os.path.isdir(work):
        raise ConfigError(f"workDirectory is no folder: {work}")
    rows = [{"name": r.get("name") or "", "compoundCategory": list(r.get("compoundCategory") or []), "priority": int(r.get("priority") or 0), "description": r.get("description") or ""} for r in raw.get("classifications") or []]
    if not rows:
        raise ConfigError("there are no classifications")
    for r in rows:
        if not r["name"].strip() or not r["description"].strip():
            raise ConfigError("a classification has no name or no description")
    return Config(str(work), raw.get("outputDirectory"), rows)


def base_categories(rows: DataFrame) -> DataFrame:
    """(pos, name, priority, description) of the rows that combine no others."""
    return rows.filter(F.size("compoundCategory") == 0).select("pos", "name", "priority", "description")


def compound_categories(rows: DataFrame) -> DataFrame:
    """(name, members, description, missing): members sorted and distinct; missing are those that no base category has."""
    compound = rows.filter(F.size("compoundCategory") > 0)
    members = compound.select("pos", "name", "description", F.explode("compoundCategory").alias("member"))
    base = base_categories(rows).select(F.col("name").alias("member"), F.lit(True).alias("known")).distinct()
    found = members.join(base, "member", "left")
    out = found.groupBy("pos", "name", "description").agg(F.array_sort(F.collect_set("member")).alias("members"), F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("member")))).alias("missing"))
    return out.select("name", "members", "description", "missing")


def resolve(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and compound categories; an unknown member is an error."""
    compound = compound_categories(rows)
    bad = compound.filter(F.size("missing") > 0).select("name", "missing").first()
    if bad:
        raise ConfigError(f"{bad['name']} has unknown members {bad['missing']}")
    return base_categories(rows), compound.drop("missing")


@dataclass(frozen=True)
class Settings:
    """Runtime settings with their defaults; values given as a mapping, such as Spark settings, override them."""

    url: str = "http://localhost:11434"
    vision_model: str = "vision"
    text_model: str = "text"
    connect_timeout: float = 30.0
    read_timeout: float = 60.0
    least_context: int = 4000
    most_context: int = 65536
    workers: int = 2
    threads: int = 2
    remove_original: bool = True
    remove_duplicates: bool = True

    @classmethod
    def of(cls, values: dict[str, str], prefix: str = "curata.") -> Settings:
        """From string values; names are those of the fields after the prefix. Unknown names are an error."""
        known = {f.name: type(f.default) for f in fields(cls)}
        given = {k.removeprefix(prefix): v for k, v in values.items() if k.startswith(prefix)}
        if unknown := sorted(set(given) - set(known)):
            raise ConfigError(f"unknown settings: {unknown}")
        return cls(**{k: (str(v).lower() == "true") if known[k] is bool else known[k](v) for k, v in given.items()})
