"""Whether a collection is fit for work: a few checks of its configuration and folders, and their counts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STAGING, Config
from .catalog import Catalog

LEVELS = ("ok", "warn", "fail")


def checks(spark: SparkSession, config: Config, root: str) -> DataFrame:
    """name, status (ok, warn, fail) and detail. Looks at the root and one folder a category; reads no document."""
    found = [("root", "ok" if os.access(root, os.R_OK | os.W_OK) else "fail", root)]
    for c in sorted(config.categories, key=lambda c: c.name):
        there = os.path.isdir(os.path.join(root, c.path))
        found.append((f"category {c.name}", "ok" if there else "warn", c.path if there else f"no folder {c.path}"))
    for name in ("manifests", STAGING):
        path = os.path.join(root, name)
        fit = os.access(path if os.path.exists(path) else root, os.W_OK)
        found.append((name, "ok" if fit else "fail", path))
    tags = [p.tag for p in config.people]
    found.append(("people", "ok" if len(set(tags)) == len(tags) else "fail", f"{len(tags)} people"))
    types = Catalog.of(config).names
    found.append(("types", "ok" if types else "warn", f"{len(types)} types"))
    return spark.createDataFrame(found, "name string, status string, detail string")


def counts(found: DataFrame) -> DataFrame:
    """One row: how many checks have each status; null and unknown ones count nowhere."""
    return found.agg(*[F.count_if(F.coalesce(F.col("status") == s, F.lit(False))).alias(s) for s in LEVELS])
