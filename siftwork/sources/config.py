"""Site and sector configuration."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from .. import vocab as V


def load(path: str | Path) -> dict:
    """A YAML file as a dict; an empty one is {}. A missing file or bad YAML raises."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no configuration at {path}")
    try:
        found = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ValueError(f"bad YAML in {path}: {e}") from e
    return found or {}


def site(name: str, folder: str | Path) -> dict:
    """A site's configuration; an empty one raises."""
    found = load(Path(folder) / "sites" / f"{name}.yaml")
    if not found:
        raise ValueError(f"the configuration of site {name} is empty")
    return found


def sectors(config: dict | None = None) -> dict[str, tuple[str, ...]]:
    """S3: keyword packs in file order; the default ones without a configuration."""
    if config is None:
        return dict(V.SECTORS)
    return {name: tuple((info or {}).get("keywords") or ()) for name, info in (config.get("sectors") or {}).items()}


def sector_table(spark: SparkSession, packs: dict[str, tuple[str, ...]]) -> DataFrame:
    """S3: keyword packs as a table (sector, sector_pos, kw_pos, keyword)."""
    rows = [(s, i, k, w) for i, (s, words) in enumerate(packs.items()) for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "sector string, sector_pos int, kw_pos int, keyword string")


def emitted(row) -> dict:
    """A discovered site as a configuration, with the fixed limits of a new site."""
    keys = ("name", "display_name", "base_url", "default_agency", "default_geography", "crawler_mode", "primegov_api_base", "allowed_domains", "seeds", "priority_patterns", "ignore_patterns", "neighborhoods")
    found = {k: row[k] for k in keys if k in row and row[k] not in (None, "", [])}
    return found | {"max_depth": 3, "max_pages": 200, "request_delay_seconds": 1.5}
