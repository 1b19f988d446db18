"""Unions, differences, samples, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(*series: DataFrame) -> DataFrame:
    """All rows of all series, each once; columns that one lacks are null. Order them where they are written."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.distinct()


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old whose key isn't in new, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert_add(old: DataFrame, new: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Amounts added up by key; keys of either side stay."""
    return old.select(*keys, amount).unionAll(new.select(*keys, amount)).groupBy(*keys).agg(F.sum(amount).alias(amount))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and those rows of new whose key it doesn't have (one for each key)."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def raise_to(df: DataFrame, column: str, least) -> DataFrame:
    return df.withColumn(column, F.greatest(column, least))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, by a hash of seed and key: the same rows at every run."""
    return df.orderBy(shuffled(key, seed), key).limit(n)


def shuffled(key: str, seed: int = 42) -> Column:
    """32 hexadecimal digits by which rows are in a random order, the same at every run."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def permuted(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in a random order, the same at every run."""
    return df.orderBy(shuffled(key, seed), key)


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both have, each once; nulls are equal here."""
    return a.intersect(b)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)
