"""Features and quality scores of content items and of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import as_of, clip, places, ratio, with_percentile

#: Fixed keyword lists of the sentiment and text features.
POSITIVE = ["good", "great", "excellent", "amazing", "love", "best", "wonderful", "fantastic", "perfect", "enjoy"]
NEGATIVE = ["bad", "terrible", "awful", "hate", "worst", "boring", "poor", "disappointing", "stupid", "trash"]


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))


def genre_features(content: DataFrame, top: int = 10) -> DataFrame:
    """content_id, genre_count, is_multi, diversity (share of all genres that the item has), has_top (a genre of the most frequent)."""
    each = content.select("content_id", F.explode(F.array_distinct("genres")).alias("genre"))
    counts = each.groupBy("genre").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "genre").limit(top).agg(F.collect_list("genre").alias("top"))
    both = content.crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("all")))).crossJoin(F.broadcast(best))
    own = F.array_distinct("genres")
    return both.select("content_id", F.size(own).alias("genre_count"), (F.size(own) > 1).alias("is_multi"), ratio(F.size(own), F.col("all")).alias("diversity"), F.coalesce(F.arrays_overlap(own, "top"), F.lit(False)).alias("has_top"))


def genre_matrix(content: DataFrame, genres: list[str]) -> DataFrame:
    """content_id and one 0/1 column a genre."""
    return content.select("content_id", *[F.coalesce(F.array_contains("genres", g), F.lit(False)).cast("int").alias(f"genre_{g}") for g in genres])


def age_features(items: DataFrame, year_now: int) -> DataFrame:
    """Adds age, is_recent (5 years at most), is_classic (20 at least), decade, era and duration_band."""
    age = F.lit(year_now) - F.col("year")
    era = F.when(F.col("year") <= 1970, "classic").when(F.col("year") <= 1990, "vintage").when(F.col("year") <= 2010, "modern").when(F.col("year").isNotNull(), "contemporary")
    band = F.when(F.col("duration") <= 10, "short").when(F.col("duration") <= 25, "medium").when(F.col("duration") <= 40, "long").when(F.col("duration").isNotNull(), "very_long")
    return items.withColumns({"age": age, "is_recent": age <= 5, "is_classic": age >= 20, "decade": (F.floor(F.col("year") / 10) * 10).cast("int"), "era": era, "duration_band": band})


def text_stats(texts: DataFrame) -> DataFrame:
    """Adds length, word_count, mean_word_length, positive and negative keywords of a column text."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    n = F.size(words)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return texts.withColumns({"length": F.length("text"), "word_count": F.when(F.col("text").isNotNull(), n), "mean_word_length": F.when(n > 0, letters / n), "positive": hits(F.col("text"), POSITIVE), "negative": hits(F.col("text"), NEGATIVE)})


def tfidf_top_terms(texts: DataFrame, n: int = 50, least: int = 2) -> DataFrame:
    """term, df, weight: the terms of most tf-idf weight over all texts; terms in fewer than `least` texts are left out.

    tf is the count in a text, idf ln((1 + N) / (1 + df)) + 1, and each text's
    weights are scaled to length 1.
    """
    terms = texts.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{2,}"), F.lit(0))).alias("term"))
    tf = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    idf = df.crossJoin(F.broadcast(total)).select("term", "df", (F.ln((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))
    own = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = own.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scaled = own.join(norm, "doc_id").groupBy("term").agg(F.first("df").alias("df"), F.sum(F.col("w") / F.col("norm")).alias("weight"))
    return scaled.orderBy(F.desc("weight"), "term").limit(n)


def creator_features(content: DataFrame) -> DataFrame:
    """content_id, works of its creator, prolific (more than 5), band (to 1, 5, 15, beyond)."""
    n = content.groupBy("creator").agg(F.count(F.lit(1)).alias("works"))
    both = content.select("content_id", "creator").join(n, "creator", "left")
    band = F.when(F.col("works") <= 1, "single").when(F.col("works") <= 5, "few").when(F.col("works") <= 15, "many").otherwise("prolific")
    return both.select("content_id", "works", (F.col("works") > 5).alias("prolific"), band.alias("band"))


def quality_tiers(items: DataFrame, score: str, popularity: str) -> DataFrame:
    """Adds tier (.3, .6, .8), above_mean, popularity_percentile, is_mainstream (over .7), is_niche (under .3).

    Percentiles come from the distinct values with their counts, which join back.
    """
    mean = items.agg(F.avg(score).alias("_mean"))
    out = with_percentile(items, popularity, "popularity_percentile").crossJoin(F.broadcast(mean))
    tier = F.when(F.col(score) < 0.3, "low").when(F.col(score) < 0.6, "medium").when(F.col(score) < 0.8, "high").when(F.col(score).isNotNull(), "excellent")
    return out.withColumns({"tier": tier, "above_mean": F.col(score) > F.col("_mean"), "is_mainstream": F.col("popularity_percentile") > 0.7, "is_niche": F.col("popularity_percentile") < 0.3}).drop("_mean")


def popularity_quality(interactions: DataFrame, days: int = 365, when: str | None = None) -> DataFrame:
    """item_id, n, recent, popularity: 0.6 of the percentile of all events and 0.4 of that of recent ones, scaled to 0..1."""
    own = as_of(interactions, when)
    n = own.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= F.col("as_of") - F.expr(f"interval {days} days")).alias("recent"))
    ranked = with_percentile(with_percentile(n, "n", "_all"), "recent", "_late")
    raw = ranked.withColumn("raw", 0.6 * F.col("_all") + 0.4 * F.col("_late"))
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), F.lit(0.5)).otherwise((F.col("raw") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return raw.crossJoin(F.broadcast(ends)).select("item_id", "n", "recent", scaled.alias("popularity"))


def user_rating_quality(interactions: DataFrame) -> DataFrame:
    """item_id, score: 0.6 of the mean rating over 5, 0.2 of ln(n + 1) / ln 100 (1 at most), 0.2 / (1 + deviation)."""
    a = interactions.groupBy("item_id").agg(F.avg("rating").alias("m"), F.count("rating").alias("n"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("sd"))
    score = 0.6 * F.col("m") / 5 + 0.2 * F.least(F.lit(1.0), F.ln(F.col("n") + 1.0) / F.ln(F.lit(100.0))) + 0.2 / (1 + F.col("sd"))
    return a.select("item_id", score.alias("score"))


def critical_acclaim(items: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Adds acclaim: the mean of the columns there are, each divided by its scale, between 0 and 1."""
    parts = F.filter(F.array(*[(F.col(c) / s).cast("double") for c, s in columns.items()]), lambda x: x.isNotNull())
    mean = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))
    return items.withColumn("acclaim", F.when(mean.isNotNull(), clip(mean, 0.0, 1.0)))


def freshness(items: DataFrame, year_now: int) -> DataFrame:
    """Adds freshness: exp(-age / 10), and 0.2 more for classics (20 years at least) of a score of 0.8, 1 at most."""
    age = F.lit(year_now) - F.col("year")
    classic = F.when((age >= 20) & (F.col("score") >= 0.8), 0.2).otherwise(0.0)
    return items.withColumn("freshness", F.least(F.lit(1.0), F.exp(-age / 10) + classic))


def content_text_quality(content: DataFrame) -> DataFrame:
    """content_id, text_quality: the mean of ln(length + 1) / ln 1000, title length over 100 and genres over 5, each 1 at most."""
    n = F.length("title")
    parts = [F.ln(n + 1.0) / F.ln(F.lit(1000.0)), n / 100, F.size("genres") / 5]
    return content.select("content_id", (sum((F.least(F.lit(1.0), p) for p in parts), F.lit(0.0)) / 3).alias("text_quality"))


def composite_quality(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds composite (weighted sum), quality_rank, tier by percentile (.25, .5, .75, .9), agreement 1 / (1 + deviation of the parts)."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    values = [F.coalesce(F.col(c), F.lit(0.0)) for c in weights]
    mean = sum(values, F.lit(0.0)) / len(values)
    deviation = F.sqrt(sum(((v - mean) * (v - mean) for v in values), F.lit(0.0)) / len(values))
    out = parts.withColumn("composite", F.round(total, 9)).withColumn("agreement", 1 / (1 + deviation))
    pct = (F.col("below") + (F.col("ties") + 1) / 2) / F.col("total")
    tier = F.when(pct <= 0.25, "poor").when(pct <= 0.5, "fair").when(pct <= 0.75, "good").when(pct <= 0.9, "very_good").otherwise("excellent")
    ranks = places(out, "composite").select(F.col("composite").alias("_at"), (F.col("total") - F.col("below") - F.col("ties") + 1).alias("quality_rank"), tier.alias("tier"))
    return out.join(ranks, F.col("composite") == F.col("_at"), "left").drop("_at")


def content_analytics(interactions: DataFrame, content: DataFrame, least: int = 5, threshold: float = 2.5) -> DataFrame:
    """content_type, items, rated_items, top_items: items with a mean rating of the threshold and `least` ratings."""
    a = interactions.groupBy("item_id").agg(F.avg("rating").alias("m"), F.count("rating").alias("n"))
    both = content.select("content_id", "content_type").join(a, F.col("content_id") == F.col("item_id"), "left")
    return both.groupBy("content_type").agg(F.count(F.lit(1)).alias("items"), F.count("item_id").alias("rated_items"), F.count_if((F.col("m") >= threshold) & (F.col("n") >= least)).alias("top_items"))


def embedding_text(content: DataFrame, least: int = 20, most: int = 8000) -> DataFrame:
    """content_id, text: title, type and genres as one text of at most `most` characters; shorter ones than `least` are left out."""
    text = F.concat_ws(". ", F.concat(F.lit("Title: "), F.col("title")), F.concat(F.lit("Type: "), F.col("content_type")), F.concat(F.lit("Genres: "), F.array_join("genres", ", ")))
    return content.select("content_id", F.substring(text, 1, most).alias("text")).filter(F.length("text") >= least)


def text_hash_embedding(texts: DataFrame, dims: int = 768, words: int = 192) -> DataFrame:
    """doc_id, bucket, weight: words of the text hashed to buckets with weight 1 / (position + 1), scaled to length 1, as sparse rows."""
    own = F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), 1, words)
    each = texts.select("doc_id", F.posexplode(own).alias("i", "w"))
    bucket = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % dims
    sums = each.select("doc_id", bucket.cast("int").alias("bucket"), (1 / (F.col("i") + 1)).alias("x")).groupBy("doc_id", "bucket").agg(F.sum("x").alias("x"))
    norm = sums.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return sums.join(norm, "doc_id").select("doc_id", "bucket", (F.col("x") / F.col("norm")).alias("weight"))


def embedding_quality(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id, quality: 1 less 0.5 for a wrong length, 0.3 for a norm near 0, 0.2 for a deviation under .01, 0.1 for a range under .1; 0 with a NaN."""
    v = F.col("embedding").cast("array<double>")
    n = F.size(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    deviation = F.sqrt(F.greatest(F.lit(0.0), square / n - (total / n) * (total / n)))
    score = 1 - F.when(n != dims, 0.5).otherwise(0.0) - F.when(F.sqrt(square) < 1e-6, 0.3).otherwise(0.0) - F.when(deviation < 0.01, 0.2).otherwise(0.0) - F.when(F.array_max(v) - F.array_min(v) < 0.1, 0.1).otherwise(0.0)
    bad = F.exists(v, lambda x: F.isnan(x) | x.isNull())
    return vectors.select("vec_id", F.when(bad | (n == 0), 0.0).otherwise(F.greatest(F.lit(0.0), score)).alias("quality"))


def annotation_join(content: DataFrame, notes: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """content with its notes by content_id, and defaults where there are none."""
    return content.join(notes, "content_id", "left").fillna(defaults)


def lexicon_sentiment(texts: DataFrame) -> DataFrame:
    """Adds positive, negative and sentiment: five labels by the keywords' balance."""
    p, n = hits(F.col("text"), POSITIVE), hits(F.col("text"), NEGATIVE)
    label = F.when(p - n >= 2, "very_positive").when(p > n, "positive").when(n - p >= 2, "very_negative").when(n > p, "negative").otherwise("neutral")
    return texts.withColumns({"positive": p, "negative": n, "sentiment": label})
