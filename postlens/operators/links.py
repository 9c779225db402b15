"""Link operators: domain and TLD rankings, domain trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import patterns as P


def _ranked(df: DataFrame, key: str, top_n: int | None) -> DataFrame:
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), F.asc(key))
    return out.limit(top_n) if top_n else out


def exploded_domains(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode("domains").alias("domain"))


def domain_ranking(df: DataFrame, top_n: int | None = 20) -> DataFrame:
    return _ranked(exploded_domains(df), "domain", top_n)


def tld_distribution(df: DataFrame, top_n: int | None = 20) -> DataFrame:
    tld = F.regexp_extract(F.lower(F.col("domain")), P.TLD_PATTERN, 1)
    t = exploded_domains(df).select(F.nullif(tld, F.lit("")).alias("tld")).where(F.col("tld").isNotNull())
    return _ranked(t, "tld", top_n)


def top_keys_by_period(exploded: DataFrame, key: str, period: list[str], top_n: int) -> DataFrame:
    """Count per (period, key) for the top_n keys overall.

    The per-(period, key) aggregate is computed once; totals, the top-N list (at
    most top_n rows, so broadcasting it is safe) and the semi join all run on it.
    """
    per = exploded.groupBy(*period, key).agg(F.count(F.lit(1)).alias("occurrences"))
    top = (per.groupBy(key).agg(F.sum("occurrences").alias("total"))
           .orderBy(F.desc("total"), F.asc(key)).limit(top_n).select(key))
    return per.join(F.broadcast(top), key, "left_semi")


def domain_year_trend(df: DataFrame, top_n: int = 5) -> DataFrame:
    out = top_keys_by_period(exploded_domains(df, "year"), "domain", ["year"], top_n)
    return out.select("year", "domain", "occurrences").orderBy(
        F.asc("year"), F.desc("occurrences"), F.asc("domain"))


def domain_month_trend(df: DataFrame, domain: str | None = None) -> DataFrame:
    """Monthly counts of one domain (exact, case-sensitive); by default the most
    linked domain, chosen inside the plan from the same per-(year, month, domain)
    aggregate (one pass over the posts, no driver round trip)."""
    e = exploded_domains(df, "year", "month")
    if domain:
        per = (e.where(F.col("domain") == F.lit(domain))
               .groupBy("year", "month").agg(F.count(F.lit(1)).alias("occurrences")))
    else:
        per = top_keys_by_period(e, "domain", ["year", "month"], 1).drop("domain")
    return (per.withColumn("year_month", C.year_month_label(F.col("year"), F.col("month")))
            .select("year", "month", "occurrences", "year_month").orderBy("year", "month"))
