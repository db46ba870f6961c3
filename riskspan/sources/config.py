"""Configuration and dimension files (YAML): small, read on the driver; dimensions become tables."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKET = "struct<peg_target:string,binance_symbol:string,binance_months:array<string>,llama_coin:string,llama_start:bigint,llama_span:bigint,stablecoin_id:string,absorbing_coin:string>"
INCIDENT = "struct<date:string,summary:string,loss_usd:double,source:string>"
#: The protocol dimension.
PROTOCOLS = f"name string, display string, tier string, algorithmic string, language string, repo string, ref string, license string, paths array<string>, mechanism string, family string, root string, market {MARKET}, incident {INCIDENT}"


def read_yaml(path: str) -> dict:
    """A YAML file's mapping; empty without the file or without content."""
    if not os.path.exists(path):
        return {}
    import yaml  # only where a file is read

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def lookup(settings: dict, dotted: str, default: Any = None) -> Any:
    """The value at a path such as "corpus.max_file_bytes"; the default where a step is missing."""
    at: Any = settings
    for step in dotted.split("."):
        if not isinstance(at, dict) or step not in at:
            return default
        at = at[step]
    return at


def dimension(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Mappings as a table of a fixed schema: missing fields are null, nested ones too; other fields are left out."""
    from pyspark.sql.types import ArrayType, StringType, StructType, _parse_datatype_string

    def shaped(value, kind):
        if value is None:
            return None
        if isinstance(kind, StructType):
            return tuple(shaped(value.get(f.name), f.dataType) for f in kind)
        if isinstance(kind, ArrayType):
            return [shaped(v, kind.elementType) for v in value]
        return str(value) if isinstance(kind, StringType) else {"double": float, "bigint": int, "long": int}.get(kind.typeName(), lambda v: v)(value)

    whole = _parse_datatype_string(schema)
    return spark.createDataFrame([shaped(r, whole) for r in rows], whole)


def protocols(spark: SparkSession, settings: dict) -> DataFrame:
    return dimension(spark, settings.get("protocols") or [], PROTOCOLS)


def chosen(protocols: DataFrame, tier: str | None = None, algorithmic: str | list[str] | None = None) -> DataFrame:
    """Protocols of a role (primary is an older name of study) and of the wanted mechanisms (null: none)."""
    if tier:
        protocols = protocols.where(F.col("tier") == ("study" if tier == "primary" else tier))
    if algorithmic:
        kinds = [algorithmic] if isinstance(algorithmic, str) else list(algorithmic)
        protocols = protocols.where(F.coalesce("algorithmic", F.lit("none")).isin(kinds))
    return protocols


def with_market(protocols: DataFrame, depeggable_only: bool = False) -> DataFrame:
    """Protocols that have a market series; with depeggable_only those whose peg is the dollar."""
    out = protocols.where(F.col("market").isNotNull())
    return out.where(F.lower("market.peg_target") == "usd") if depeggable_only else out


def market_of(protocols: DataFrame, name: str) -> DataFrame:
    """The market fields of one protocol, or no row."""
    return protocols.where((F.col("name") == name) & F.col("market").isNotNull()).select("name", "market.*")


def unavailable(requested: DataFrame, available: DataFrame, key: str = "name") -> DataFrame:
    """Requested names that are not available, once each."""
    return requested.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")


def or_default(value: Column, default: object) -> Column:
    """A field of a dimension, or the default of the reports."""
    return F.coalesce(value, F.lit(default))
