"""Registered queries of factor models that learn in steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import kept
from ..operators import factors as A
from ..sources.views import interactions
from .registry import query


@query()
def minibatch_mf_update(spark, sf_dir):
    """Profiles after the events of three rounds of ten days each, with the reach of their factors."""
    rows = interactions(spark, sf_dir)
    days = F.datediff("ts", F.lit("2024-01-01"))
    rounds = kept(rows.withColumn("round", F.greatest(F.lit(0), F.least(F.lit(2), F.floor(days / 10)))), "rounds")
    kinds = dict(zip(rows.columns, [f.dataType for f in rows.schema], strict=True))
    users, items = (spark.createDataFrame([], A._profile(k, kinds[k])) for k in ("user_id", "item_id"))
    for r in range(3):
        changed = A.minibatch_step(users, items, rounds.filter(F.col("round") == r))
        users, items = (kept(old.join(new.select(k).hint("merge"), k, "left_anti").unionByName(new), k) for k, old, new in zip(("user_id", "item_id"), (users, items), changed, strict=True))
    reach = F.sqrt(A.dot("factors", "factors")).alias("reach")
    sides = [df.select(F.lit(k).alias("side"), F.col(f"{k}_id").cast("long").alias("id"), "n", F.least(F.lit(1.0), F.col("n") / 5).alias("confidence"), "bias", reach, "updated") for k, df in (("user", users), ("item", items))]
    return sides[0].unionByName(sides[1])


@query()
def bpr_pairwise(spark, sf_dir):
    """AUC of the ranking model and of popularity on the last week's events, each against a drawn item that the user never had."""
    rows = interactions(spark, sf_dir)
    new = F.col("ts") >= F.lit("2024-01-24").cast("timestamp")
    train = rows.filter(~new)
    users, items = A.bpr_train(train)
    ever = kept(rows.select("user_id", "item_id").dropna().distinct(), "ever")
    fresh = rows.filter(new).select("user_id", "item_id").distinct().join(train.select("user_id", "item_id").distinct().hint("merge"), ["user_id", "item_id"], "left_anti")
    triples = kept(A.negatives(ever, -1).join(fresh.hint("merge"), ["user_id", "item_id"], "left_semi"), "held")
    counts = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("c"))
    both = triples.join(counts.hint("merge"), "item_id").join(counts.select(F.col("item_id").alias("other"), F.col("c").alias("d")).hint("merge"), "other")
    out = [A.bpr_auc(users, items, triples).withColumn("model", F.lit("bpr")), A.pair_auc(both, F.col("c") - F.col("d")).withColumn("model", F.lit("popularity"))]
    return out[0].unionByName(out[1])
