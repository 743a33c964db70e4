"""Whole scan of a set of projects: findings of every engine as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scan, taint
from ..rules import RULES, Rule


def scan_projects(files: DataFrame, rules: tuple[Rule, ...] = RULES, external: DataFrame | None = None) -> DataFrame:
    """U-07: internal, licence, external and flow findings. ``external`` has the finding columns of ``scan_files``."""
    scanned = scan.scanned_files(files)
    found = scan.scan_files(scanned, rules).unionByName(scan.missing_license(files, rules))
    if external is not None:
        # A rule hits a line once; scanners may report one several times, and what they say decides then.
        order = F.struct("path", "line", "rule_id", "evidence", "title", "severity", "mitigation", "engine")
        columns = found.columns
        found = scan.corroborate(
            found.withColumn("ord", order),
            external.select(*columns).withColumn("ord", order),
        ).drop("ord")
    # Hits and flows are two narrow passes over the texts; nothing is kept between them, and each is made once.
    return taint.with_flows(found, taint.flow_paths(scanned))
