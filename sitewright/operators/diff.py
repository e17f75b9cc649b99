"""Incremental runs: what changed, what is stale, and whether deleting is safe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(current: DataFrame, stored: DataFrame, key: str, value: str = "content_hash") -> DataFrame:
    """key and status (new, changed, same, stale): one full outer join of two hash manifests."""
    a, b = current.select(key, F.col(value).alias("now")), stored.select(key, F.col(value).alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "stale").when(F.col("now") != F.col("was"), "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def changed(current: DataFrame, stored: DataFrame, key: str, value: str = "content_hash", force: bool = False) -> DataFrame:
    if force:
        return current
    known = stored.select(key, F.col(value).alias("was"))
    return current.join(known, key, "left").filter(F.col("was").isNull() | (F.col("was") != F.col(value))).drop("was")


def stale(stored: DataFrame, current: DataFrame, key: str, custom_records_given: bool = True) -> DataFrame:
    """Stored rows that the run no longer has. Custom rows are spared unless the run was given its custom records."""
    gone = stored.join(current.select(key), key, "left_anti")
    return gone if custom_records_given else gone.filter(~F.coalesce("custom", F.lit(False)))


@dataclass(frozen=True)
class Gate:
    eligible: bool
    reasons: tuple[str, ...]


def deletion_gate(n_stored: int, n_stale: int, n_source: int, warnings: tuple[str, ...] = (), max_ratio: float = 0.5, allow_empty: bool = False, accepted: bool = False) -> Gate:
    """No deletes after a warning, from an empty source, or of too large a share."""
    reasons = list(warnings)
    if n_source == 0 and not allow_empty:
        reasons.append("empty-source")
    if n_stored and n_stale / n_stored > max_ratio and not accepted:
        reasons.append("deletion-ratio")
    return Gate(not reasons, tuple(reasons))


def dedupe_first(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def collision_ordinals(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def select_stale_scopes(scopes: DataFrame, keep: list[str], protected: list[str], now_ms: int, older_than_ms: int | None, any_rule: bool = False) -> DataFrame:
    """Scopes to prune. A scope of unknown age is never old."""
    by_list = ~F.col("scope_name").isin(*keep) if keep else F.lit(True)
    rule = by_list
    if older_than_ms is not None:
        old = F.col("last_indexed_ms").isNotNull() & (now_ms - F.col("last_indexed_ms") > older_than_ms)
        rule = F.col("last_indexed_ms").isNotNull() & ((by_list | old) if any_rule else (by_list & old))
    return scopes.filter(rule & (~F.col("scope_name").isin(*protected) if protected else F.lit(True)))


def gate_report(statuses: DataFrame, by: str, max_ratio: float = 0.5) -> DataFrame:
    """For each kind of record: n_stored, n_stale, ratio and blocked, from classified keys (by, status)."""
    stored = F.count(F.when(F.col("status") != "new", 1))
    gone = F.count(F.when(F.col("status") == "stale", 1))
    ratio = F.when(stored == 0, F.lit(0.0)).otherwise(gone / stored)
    return statuses.groupBy(by).agg(stored.alias("n_stored"), gone.alias("n_stale"), F.round(ratio, 9).alias("ratio"), (ratio > max_ratio).alias("blocked"))


def remote_branches(listing: str, remotes: list[str]) -> set[str] | None:
    """Branch names in a listing of remote references; None where it cannot be trusted: no remotes, or no branches."""
    names = (line.strip().removeprefix("'").removesuffix("'") for line in listing.splitlines())
    found = set()
    for name in names:
        if "/" in name:
            remote = next((r for r in remotes if name.startswith(f"{r}/")), None)
            found.add(name.removeprefix(f"{remote}/") if remote else name)
    found -= {"HEAD", ""}
    return found if remotes and found else None
