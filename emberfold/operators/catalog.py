"""The catalog of registered profiles as a table: what holds of each registration, without reading a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import ALIAS


def checked_entries(profiles: DataFrame) -> DataFrame:
    """``profile_id, alias_ok, default_alias, fingerprint_ok, day, entry`` of each row: whether the alias keeps the grammar (a null one doesn't), the alias
    that its source would get by itself, whether the fingerprint is 64 hexadecimal digits, the day of registration in UTC, and the entry as JSON.
    """
    whole = f"^(?:{ALIAS})\\z"
    stem = F.regexp_extract(F.coalesce("source_name", F.lit("")), r"^(.+?)(?:\.[^.]*)?$", 1)
    entry = F.struct("alias", "source_name", "fingerprint", "byte_len", "registered_unix_ms")
    return profiles.select(
        "profile_id",
        F.coalesce(F.col("alias").rlike(whole), F.lit(False)).alias("alias_ok"),
        F.when(stem.rlike(whole), stem).otherwise("default").alias("default_alias"),
        F.coalesce(F.col("fingerprint").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)).alias("fingerprint_ok"),
        F.date_format(F.timestamp_millis("registered_unix_ms"), "yyyy-MM-dd").alias("day"),
        F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"),
    )
