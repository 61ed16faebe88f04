"""The baseline of accepted findings: entries are added, added in bulk and removed as set operations; files are replaced whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "finding_id string, cwe_id string, code_hash string, reason string, added_at string, file_path string"
BULK_SEVERITIES = ("Low", "Info")


def added(baseline: DataFrame, entries: DataFrame) -> DataFrame:
    """The baseline with the entries whose id it does not have; of repeated ids among them the least ``ord`` counts."""
    columns = [c.split()[0] for c in ENTRY.split(", ")]
    new = entries.join(baseline.select("finding_id").distinct(), "finding_id", "left_anti")
    new = new.groupBy("finding_id").agg(F.min_by(F.struct(*columns[1:]), "ord").alias("e")).select("finding_id", "e.*")
    return baseline.select(*columns).unionByName(new)


def bulk_entries(scan: DataFrame, reason: str, added_at: str) -> DataFrame:
    """Entries for the minor findings of the last scan: finding_id, cwe_id, file_path, severity, ord."""
    minor = scan.where(F.col("severity").isin(*BULK_SEVERITIES))
    return minor.select("finding_id", F.coalesce("cwe_id", F.lit("")).alias("cwe_id"), F.lit("").alias("code_hash"), F.lit(reason).alias("reason"), F.lit(added_at).alias("added_at"), "file_path", "ord")


def removed(baseline: DataFrame, finding_id: str) -> DataFrame:
    """The baseline without an id."""
    return baseline.where(F.col("finding_id") != finding_id)
