"""Settings of a deployment: a file's values, over which the environment's win."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(text: str) -> dict[str, str]:
    """Lines `NAME=value` or `name: value`; # begins a comment, quotes around a value go."""
    out = {}
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if not line or line.startswith("#"):
            continue
        at = min((i for i in (line.find("="), line.find(":")) if i > 0), default=-1)
        if at > 0:
            out[line[:at].strip().lower()] = line[at + 1 :].strip().strip("'\"")
    return out


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 400
    overlap: int = 60
    min_tokens: int = 40
    max_tokens: int = 220
    percentile: float = 0.8
    dense_top_k: int = 20
    bm25_top_k: int = 20
    rrf_k: int = 60
    final_top_k: int = 20
    fast_top_k: int = 5
    k1: float = 1.5
    b: float = 0.75
    max_papers: int = 15
    extra: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, text: str = "", environment: Mapping[str, str] | None = None, prefix: str = "DOCQUARRY_") -> Settings:
        """Values of a settings text, then those of the environment that begin with the prefix; what has no field of its
        own is kept as it is."""
        env = os.environ if environment is None else environment
        values = parsed(text) | {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}
        kinds = {f.name: type(f.default) for f in fields(cls) if f.name != "extra"}
        known = {k: kinds[k](v) for k, v in values.items() if k in kinds}
        return cls(**known, extra={k: v for k, v in values.items() if k not in kinds})


def effective(files: DataFrame, environments: DataFrame, prefix: str = "DOCQUARRY_") -> DataFrame:
    """(deployment, name, value): the settings of many deployments. files: (deployment, text), environments: (deployment,
    name, value). A deployment has all fields of Settings, each as its environment says, or else its file, or else by
    default; and what else either names."""
    line = F.trim(F.element_at(F.split("line", " #"), 1))
    cut = files.select("deployment", F.explode(F.split("text", r"\r?\n")).alias("line")).select("deployment", line.alias("line")).filter(~F.col("line").startswith("#"))
    pair = cut.select("deployment", F.regexp_extract("line", r"^([^=:]+)[=:](.*)$", 1).alias("n"), F.regexp_extract("line", r"^([^=:]+)[=:](.*)$", 2).alias("v")).filter("n <> ''")
    own = pair.select("deployment", F.lower(F.trim("n")).alias("name"), F.regexp_replace(F.trim("v"), "^['\"]+|['\"]+$", "").alias("value"), F.lit(1).alias("rank"))
    over = environments.filter(F.col("name").startswith(prefix)).select("deployment", F.lower(F.substr("name", F.lit(len(prefix) + 1))).alias("name"), "value", F.lit(2).alias("rank"))
    base = F.explode(F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(str(f.default)).alias("value")) for f in fields(Settings) if f.name != "extra")))
    default = files.select("deployment").distinct().select("deployment", base.alias("s")).select("deployment", "s.name", "s.value", F.lit(0).alias("rank"))
    rows = default.unionByName(own).unionByName(over)
    return rows.groupBy("deployment", "name").agg(F.max_by("value", "rank").alias("value"))
