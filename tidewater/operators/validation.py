"""Checks of tables: required fields, keys, ranges, domains, dates, order and overall quality.

Each check is one aggregate over the table. Empty tables give rows with zero
counts and null shares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio


def _stacked(one_row: DataFrame, rows: list[tuple[str, list[tuple[str, Column]]]]) -> DataFrame:
    """One row of aggregates as several: each a name with the same named values."""
    structs = [F.struct(F.lit(name).alias("field"), *[c.alias(k) for k, c in values]) for name, values in rows]
    return one_row.select(F.inline(F.array(*structs)))


def required_field_check(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, nulls, share, level: a missing column or a null share above a tenth is CRITICAL, any null an ERROR."""
    have = [f for f in fields if f in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f).isNull()).alias(f"null_{f}") for f in have])
    rows = []
    for f in fields:
        nulls = F.col(f"null_{f}") if f in have else F.col("n")
        share = ratio(nulls, F.col("n"))
        level = F.lit("CRITICAL") if f not in have else F.when(share > 0.1, "CRITICAL").when(nulls > 0, "ERROR").otherwise("OK")
        rows.append((f, [("nulls", nulls), ("share", share), ("level", level)]))
    return _stacked(one, rows)


def duplicate_key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct keys, and rows beyond the first of each key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def range_check(df: DataFrame, ranges: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """field, below, above, lowest, highest for each field and its allowed range."""
    aggs, rows = [], []
    for f, (low, high) in ranges.items():
        aggs += [
            (F.count_if(F.col(f) < low) if low is not None else F.lit(0).cast("long")).alias(f"{f}_below"),
            (F.count_if(F.col(f) > high) if high is not None else F.lit(0).cast("long")).alias(f"{f}_above"),
            F.min(f).cast("double").alias(f"{f}_min"),
            F.max(f).cast("double").alias(f"{f}_max"),
        ]
        rows.append((f, [("below", F.col(f"{f}_below")), ("above", F.col(f"{f}_above")), ("lowest", F.col(f"{f}_min")), ("highest", F.col(f"{f}_max"))]))
    return _stacked(df.agg(*aggs), rows)


def domain_check(df: DataFrame, field: str, allowed: list[str], shown: int = 5) -> DataFrame:
    """Non-null values outside the allowed ones: rows, distinct values, and the first few in order."""
    bad = df.filter(F.col(field).isNotNull() & ~F.col(field).isin(allowed)).groupBy(field).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(W.orderBy(field))
    # the window runs over the first few distinct values only: the limit is taken before it
    few = bad.orderBy(field).limit(shown).withColumn("_i", first).agg(F.concat_ws(",", F.array_sort(F.collect_list(field))).alias("offenders"))
    return bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad"), F.count(F.lit(1)).alias("n_values")).crossJoin(F.broadcast(few))


def date_check(df: DataFrame, field: str, as_of: str, first: str = "1990-01-01") -> DataFrame:
    """Texts that are no timestamp, and timestamps after as_of or before the first plausible day."""
    ts = F.try_to_timestamp(F.col(field).cast("string"))
    return df.agg(
        F.count_if(F.col(field).isNotNull() & ts.isNull()).alias("unparseable"),
        F.count_if(ts > F.lit(as_of).cast("timestamp")).alias("future"),
        F.count_if(ts < F.lit(first).cast("timestamp")).alias("too_early"),
        F.count_if(F.col(field).isNull()).alias("missing"),
    )


def json_array_check(df: DataFrame, field: str) -> DataFrame:
    """Non-null texts that are no JSON array of strings."""
    parsed = F.from_json(F.col(field), "array<string>")
    return df.agg(F.count_if(F.col(field).isNotNull() & parsed.isNull()).alias("invalid"), F.count_if(parsed.isNotNull()).alias("valid"))


def temporal_consistency(df: DataFrame, user: str = "user_id", ts: str = "ts", arrival: str = "event_id") -> DataFrame:
    """Users with an event older than the one that arrived before it, and the number of such events."""
    before = F.lag(ts).over(W.partitionBy(user).orderBy(arrival))
    back = df.select(user, (F.col(ts) < before).alias("back")).groupBy(user).agg(F.count_if("back").alias("n"))
    return back.agg(F.count_if(F.col("n") > 0).alias("users_out_of_order"), F.coalesce(F.sum("n"), F.lit(0)).alias("events_out_of_order"), F.count(F.lit(1)).alias("users"))


def table_quality_score(df: DataFrame, bad: dict[str, Column], duplicate_keys: list[str]) -> DataFrame:
    """completeness, validity, consistency and their 0.3 / 0.4 / 0.3 mean.

    completeness is the share of non-null cells; validity loses the weight
    (3 critical, 2 error, 1 warning) of each check in `bad`, a name like
    "critical:age" with its condition, that fails, against a tenth of the rows;
    consistency is the share of rows without nulls and without a duplicate key.
    """
    weight = {"critical": 3, "error": 2, "warning": 1}
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])
    issues = reduce(lambda a, b: a + b, [F.count_if(c) * weight[name.split(":")[0]] for name, c in bad.items()], F.lit(0))
    one = df.agg(F.count(F.lit(1)).alias("n"), cells.alias("null_cells"), F.count_if(whole).alias("whole"), issues.alias("issues"))
    dup = duplicate_key_check(df, duplicate_keys).select("duplicates")
    row = one.crossJoin(F.broadcast(dup))
    complete = 1 - ratio(F.col("null_cells"), F.col("n") * len(df.columns))
    valid = F.greatest(F.lit(0.0), 1 - ratio(F.col("issues"), F.col("n") * 0.1))
    same = ratio(F.col("whole") - F.col("duplicates"), F.col("n"))
    return row.select("n", complete.alias("completeness"), valid.alias("validity"), same.alias("consistency"), (0.3 * complete + 0.4 * valid + 0.3 * same).alias("score"))


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, nulls, percent, advice (by the bands 80, 50, 20, 10 percent)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = []
    for c in columns:
        pct = ratio(F.col(c) * 100.0, F.col("n"))
        advice = F.when(pct > 80, "drop").when(pct > 50, "consider_drop").when(pct > 20, "model").when(pct > 10, "impute").otherwise("fill")
        rows.append((c, [("nulls", F.col(c)), ("percent", pct), ("advice", advice)]))
    return _stacked(one, rows)


def missing_patterns(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The most frequent combinations of null columns, with their rows."""
    pattern = F.concat_ws(",", *[F.when(F.col(c).isNull(), c) for c in columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(n)


def coverage_report(interactions: DataFrame, content: DataFrame, users: DataFrame) -> DataFrame:
    """User and content coverage, rating statistics, the mean of the shares, and a grade (A from 0.9, B 0.8, C 0.6, D 0.4)."""
    seen = interactions.agg(F.countDistinct("user_id").alias("active_users"), F.countDistinct("item_id").alias("active_items"), F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.avg("rating").alias("rating_mean"), F.stddev_samp("rating").alias("rating_std"), F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"))
    items = content.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.size("genres") > 0).alias("with_genres"))
    people = users.agg(F.count(F.lit(1)).alias("users"))
    row = seen.crossJoin(F.broadcast(items)).crossJoin(F.broadcast(people))
    parts = {"user_coverage": ratio(F.col("active_users"), F.col("users")), "content_coverage": ratio(F.col("active_items"), F.col("items")), "rating_completeness": ratio(F.col("rated"), F.col("n")), "genre_completeness": ratio(F.col("with_genres"), F.col("items"))}
    score = sum(parts.values(), F.lit(0.0)) / 4
    grade = F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.6, "C").when(score >= 0.4, "D").otherwise("F")
    return row.select(*[c.alias(k) for k, c in parts.items()], "rating_mean", "rating_std", "rating_min", "rating_max", score.alias("score"), grade.alias("grade"))
