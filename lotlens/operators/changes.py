"""Batches of changes applied to table snapshots.  Every function takes the old rows and the changes and returns the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def surrogate_key(*keys: str) -> Column:
    """An id that depends on the key alone, so that inserting twice gives the same id."""
    return F.md5(F.concat_ws("|", *keys))


def insert_only(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New keys are added, known keys stay as they are; a batch may repeat a key (the least row counts)."""
    w = Window.partitionBy(*keys).orderBy(*(c for c in new.columns if c not in keys))
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def _both(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in keys), F.lit(True).alias("_new"))
    return old.withColumn("_old", F.lit(True)).join(n, keys, "full_outer")


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values win where they are not null; a null never clobbers."""
    both = _both(old, new, keys)
    return both.select(*(F.col(c) if c in keys or c not in new.columns else F.coalesce(f"_n_{c}", c).alias(c) for c in old.columns))


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changed rows replace old ones, nulls included."""
    both = _both(old, new, keys)
    return both.select(*(F.col(c) if c in keys else F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in old.columns))


def update_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Known keys get the new values of ``columns``; unknown keys are ignored."""
    n = new.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_new"))
    both = old.join(n, keys, "left")
    return both.select(*(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns))


def delete_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def skip_processed(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return batch.join(done.select(key), key, "left_anti")


def append_plan(plan: DataFrame, new: DataFrame, owner: str = "owner", order: str = "sort_order") -> DataFrame:
    """New items follow the owner's last one, in the order of ``seq``."""
    top = plan.groupBy(owner).agg(F.max(order).alias("_top"))
    w = Window.partitionBy(owner).orderBy("seq")
    add = new.join(top, owner, "left").withColumn(order, F.coalesce(F.col("_top") + 1, F.lit(0)) + F.row_number().over(w) - 1)
    return plan.unionByName(add.select(*plan.columns))


def reorder_plan(plan: DataFrame, wanted: DataFrame, owner: str = "owner", item: str = "sale_id", order: str = "sort_order") -> DataFrame:
    """Items named in the wanted list (owner, array) get their place in it."""
    place = wanted.select(owner, F.posexplode("sale_ids").alias("_at", item))
    return plan.join(place, [owner, item], "left").withColumn(order, F.coalesce("_at", order)).select(*plan.columns)


def seed(existing: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Defaults that are not there yet are added."""
    return existing.unionByName(defaults.join(existing.select(*keys), keys, "left_anti"))


def stale(rows: DataFrame, column: str, current: str) -> DataFrame:
    """Rows made by another generator than the current one, or by none."""
    return rows.where(F.col(column).isNull() | (F.col(column) != current))


def with_default(rows: DataFrame, settings: DataFrame, key: str, column: str, default) -> DataFrame:
    """A setting of each row's key, the default where there is none."""
    return rows.join(settings.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def geocode(rows: DataFrame, gazetteer: DataFrame, zips: DataFrame) -> DataFrame:
    """Coordinates by full address, else by postal code, else the row goes.  Lookup keys are unique in their tables."""
    a = gazetteer.select("address_key", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    z = zips.select("zip", F.col("lat").alias("_lz"), F.col("lon").alias("_oz"))
    out = rows.join(a, "address_key", "left").join(z, "zip", "left")
    out = out.withColumns({"lat": F.coalesce("_la", "_lz"), "lon": F.coalesce("_lo", "_oz")}).where("lat IS NOT NULL AND lon IS NOT NULL")
    return out.drop("_la", "_lo", "_lz", "_oz")


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A new snapshot beside the old one; the caller moves its pointer when the write is done."""
    rows.write.mode("errorifexists").parquet(path)
