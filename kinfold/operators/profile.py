"""Data profiles and consistent subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import portable_bucket


def profile_sources(records: DataFrame) -> DataFrame:
    """src, country, n, empty_name, empty_address, non_ascii, median_name, median_address."""
    share = lambda c: F.avg(c.cast("double"))
    return records.groupBy("src", "country").agg(
        F.count("*").alias("n"),
        share(F.col("business_name") == "").alias("empty_name"),
        share(F.col("business_address") == "").alias("empty_address"),
        share(F.col("business_name").rlike(r"[^\x00-\x7F]")).alias("non_ascii"),
        F.median(F.length("business_name")).alias("median_name"),
        F.median(F.length("business_address")).alias("median_address"),
    )


def country_summary(records: DataFrame) -> DataFrame:
    """src, countries: 'country:count' by falling count."""
    counts = records.groupBy("src", "country").count()
    item = F.struct((-F.col("count")).alias("m"), "country")
    return counts.groupBy("src").agg(F.array_sort(F.collect_list(item)).alias("l")).select("src", F.array_join(F.transform("l", lambda x: F.concat(x["country"], F.lit(":"), (-x["m"]).cast("string"))), " ").alias("countries"))


def match_histogram(entities: DataFrame) -> DataFrame:
    """n_true, entities."""
    return entities.groupBy("n_true").agg(F.count("*").alias("entities"))


def target_reuse(truth: DataFrame) -> DataFrame:
    """One row: targets, links, most entities that share a target."""
    uses = truth.groupBy("cand_id").agg(F.count_distinct("s1_id").alias("n"))
    return uses.agg(F.count("*").alias("targets"), F.sum("n").alias("links"), F.max("n").alias("most"))


def dev_subset(records: DataFrame, truth: DataFrame, percent: int = 10) -> DataFrame:
    """``percent`` of the reference records, all their matches, and ``percent`` of the other targets."""
    some = lambda c: portable_bucket(c, 100) < percent
    refs = records.where((F.col("src") == "S1") & some(F.col("entity_id")))
    matched = truth.join(refs.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi").select(F.col("cand_id").alias("entity_id")).distinct()
    owned = truth.select(F.col("cand_id").alias("entity_id")).distinct()
    others = records.where((F.col("src") != "S1") & some(F.col("entity_id"))).join(owned, "entity_id", "left_anti")
    return refs.unionByName(records.where(F.col("src") != "S1").join(matched, "entity_id", "left_semi")).unionByName(others)


def sample(df: DataFrame, id_col: str, fraction: float) -> DataFrame:
    """A share of the rows, the same in every run and any engine."""
    return df.where(portable_bucket(F.col(id_col), 1000) < int(fraction * 1000))


def split_of(c: Column, *shares: int) -> Column:
    """The split (0, 1, ...) of an id by its hash, with the given shares in per cent."""
    at, out, upto = portable_bucket(c, 100), F.lit(len(shares) - 1), sum(shares[:-1])
    for i in reversed(range(len(shares) - 1)):
        out = F.when(at < upto, i).otherwise(out)
        upto -= shares[i]
    return out
