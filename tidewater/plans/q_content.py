"""Registered queries of content and text features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import content as C
from ..sources.views import CONTENT, INTERACTIONS, content, interactions, table
from .registry import query


def keywords(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{w}') AS INTEGER)" for w in words) + ")"


@query(f"""WITH {CONTENT}, g AS (SELECT content_id, unnest(list_distinct(genres)) AS genre FROM content), n AS (SELECT genre, count(*) AS n FROM g GROUP BY 1), t AS (SELECT genre FROM n ORDER BY n DESC, genre LIMIT 3)
SELECT content_id, CAST(len(list_distinct(genres)) AS INTEGER) AS genre_count, len(list_distinct(genres)) > 1 AS is_multi, round(len(list_distinct(genres)) / (SELECT count(*) FROM n), 6) AS diversity, list_has_any(genres, (SELECT list(genre) FROM t)) AS has_top FROM content""")
def genre_features(spark, sf_dir):
    return C.genre_features(content(spark, sf_dir), 3).withColumn("diversity", r6("diversity"))


#: Order years as publication years, with the items' sizes as durations.
DATED = "dated AS (SELECT o_orderkey AS id, year(o_orderdate) AS year, CAST(o_orderkey % 50 AS INTEGER) AS duration, round((o_orderkey % 11) / 10.0, 1)::DOUBLE AS score FROM orders)"


def dated(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), F.year("o_orderdate").alias("year"), (key % 50).cast("int").alias("duration"), F.round((key % 11) / 10, 1).alias("score"))


@query(f"""WITH {DATED} SELECT id, CAST(2000 - year AS INTEGER) AS age, 2000 - year <= 5 AS is_recent, 2000 - year >= 20 AS is_classic, CAST(floor(year / 10) * 10 AS INTEGER) AS decade,
CASE WHEN year <= 1970 THEN 'classic' WHEN year <= 1990 THEN 'vintage' WHEN year <= 2010 THEN 'modern' ELSE 'contemporary' END AS era,
CASE WHEN duration <= 10 THEN 'short' WHEN duration <= 25 THEN 'medium' WHEN duration <= 40 THEN 'long' ELSE 'very_long' END AS duration_band FROM dated""")
def content_age_features(spark, sf_dir):
    return C.age_features(dated(spark, sf_dir), 2000).select("id", "age", "is_recent", "is_classic", "decade", "era", "duration_band")


@query(f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents)
SELECT doc_id, CAST(length(text) AS INTEGER) AS length, CAST(len(words) AS INTEGER) AS word_count, round(list_sum(list_transform(words, lambda x: length(x))) / len(words), 6) AS mean_word_length, {keywords('text', C.POSITIVE)} AS positive, {keywords('text', C.NEGATIVE)} AS negative FROM w""")
def text_stats(spark, sf_dir):
    return C.text_stats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "length", "word_count", r6("mean_word_length").alias("mean_word_length"), "positive", "negative")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents), f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT doc_id, term, df, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM f JOIN d USING (term)),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT term, any_value(df) AS df, round(sum(w / norm), 6) AS weight FROM w JOIN n USING (doc_id) GROUP BY 1 ORDER BY sum(w / norm) DESC, term LIMIT 50""")
def tfidf_top_terms(spark, sf_dir):
    return C.tfidf_top_terms(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("weight", r6("weight"))


@query(f"""WITH {CONTENT} SELECT content_id, count(*) OVER c AS works, count(*) OVER c > 5 AS prolific, CASE WHEN count(*) OVER c <= 1 THEN 'single' WHEN count(*) OVER c <= 5 THEN 'few' WHEN count(*) OVER c <= 15 THEN 'many' ELSE 'prolific' END AS band FROM content WINDOW c AS (PARTITION BY creator)""")
def creator_features(spark, sf_dir):
    return C.creator_features(content(spark, sf_dir))


@query(f"""WITH {CONTENT}, r AS (SELECT content_id, popularity_score / 2000 AS score, (rank() OVER (ORDER BY popularity_score) + (count(*) OVER (PARTITION BY popularity_score) - 1) / 2) / count(*) OVER () AS pct, avg(popularity_score / 2000) OVER () AS m FROM content)
SELECT content_id, CASE WHEN score < 0.3 THEN 'low' WHEN score < 0.6 THEN 'medium' WHEN score < 0.8 THEN 'high' ELSE 'excellent' END AS tier, score > m AS above_mean, round(pct, 6) AS popularity_percentile, pct > 0.7 AS is_mainstream, pct < 0.3 AS is_niche FROM r""")
def quality_tier_features(spark, sf_dir):
    items = content(spark, sf_dir).withColumn("score", F.col("popularity_score") / 2000)
    return C.quality_tiers(items, "score", "popularity_score").select("content_id", "tier", "above_mean", r6("popularity_percentile").alias("popularity_percentile"), "is_mainstream", "is_niche")


@query(f"""WITH {INTERACTIONS}, a AS (SELECT item_id, count(*) AS n, count(*) FILTER (ts >= (SELECT max(ts) FROM interactions) - INTERVAL 7 DAY) AS recent FROM interactions GROUP BY 1),
p AS (SELECT *, 0.6 * (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () + 0.4 * (rank() OVER (ORDER BY recent) + (count(*) OVER (PARTITION BY recent) - 1) / 2) / count(*) OVER () AS raw FROM a)
SELECT item_id, n, recent, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS popularity FROM p""")
def popularity_quality(spark, sf_dir):
    return C.popularity_quality(interactions(spark, sf_dir), days=7).withColumn("popularity", r6("popularity"))


@query(f"""WITH {INTERACTIONS}, a AS (SELECT item_id, avg(rating) AS m, count(rating) AS n, coalesce(stddev_samp(rating), 0) AS sd FROM interactions GROUP BY 1)
SELECT item_id, round(0.6 * m / 5 + 0.2 * least(1.0, ln(n + 1) / ln(100)) + 0.2 / (1 + sd), 6) AS score FROM a""")
def user_rating_quality(spark, sf_dir):
    return C.user_rating_quality(interactions(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"""WITH {CONTENT}, p AS (SELECT content_id, least(1.0, (popularity_score / 2000 + CASE WHEN duration > 5 THEN duration / 50 ELSE popularity_score / 2000 END) / 2) AS a FROM content) SELECT content_id, round(a, 6) AS acclaim FROM p""")
def critical_acclaim(spark, sf_dir):
    items = content(spark, sf_dir).withColumn("critics", F.when(F.col("duration") > 5, F.col("duration")))
    return C.critical_acclaim(items, {"popularity_score": 2000.0, "critics": 50.0}).select("content_id", r6("acclaim").alias("acclaim"))


@query(f"WITH {DATED} SELECT id, round(least(1.0, exp(-(2010 - year) / 10.0) + CASE WHEN 2010 - year >= 20 AND score >= 0.8 THEN 0.2 ELSE 0 END), 6) AS freshness FROM dated")
def freshness_score(spark, sf_dir):
    return C.freshness(dated(spark, sf_dir), 2010).select("id", r6("freshness").alias("freshness"))


@query(f"WITH {CONTENT} SELECT content_id, round((least(1.0, ln(length(title) + 1) / ln(1000)) + least(1.0, length(title) / 100) + least(1.0, len(genres) / 5)) / 3, 6) AS text_quality FROM content")
def content_text_quality(spark, sf_dir):
    return C.content_text_quality(content(spark, sf_dir)).withColumn("text_quality", r6("text_quality"))


@query(f"""WITH {CONTENT}, p AS (SELECT content_id, popularity_score / 2000 AS a, duration / 50 AS b FROM content), c AS (SELECT content_id, round(coalesce(a, 0) * 0.6 + coalesce(b, 0) * 0.4, 9) AS composite, 1 / (1 + abs(a - b) / 2) AS agreement FROM p),
r AS (SELECT *, rank() OVER (ORDER BY composite DESC) AS quality_rank, (rank() OVER (ORDER BY composite) + (count(*) OVER (PARTITION BY composite) - 1) / 2) / count(*) OVER () AS pct FROM c)
SELECT content_id, round(composite, 6) AS composite, CAST(quality_rank AS INTEGER) AS quality_rank, CASE WHEN pct <= 0.25 THEN 'poor' WHEN pct <= 0.5 THEN 'fair' WHEN pct <= 0.75 THEN 'good' WHEN pct <= 0.9 THEN 'very_good' ELSE 'excellent' END AS tier, round(agreement, 6) AS agreement FROM r""")
def composite_quality_tier(spark, sf_dir):
    parts = content(spark, sf_dir).select("content_id", (F.col("popularity_score") / 2000).alias("a"), (F.col("duration") / 50).alias("b"))
    return C.composite_quality(parts, {"a": 0.6, "b": 0.4}).select("content_id", r6("composite").alias("composite"), "quality_rank", "tier", r6("agreement").alias("agreement"))


@query(f"""WITH {INTERACTIONS}, {CONTENT}, a AS (SELECT item_id, avg(rating) AS m, count(rating) AS n FROM interactions GROUP BY 1)
SELECT content_type, count(*) AS items, count(item_id) AS rated_items, count(*) FILTER (m >= 2.5 AND n >= 5) AS top_items FROM content LEFT JOIN a ON content_id = item_id GROUP BY 1""")
def content_analytics(spark, sf_dir):
    return C.content_analytics(interactions(spark, sf_dir), content(spark, sf_dir))


@query(f"""WITH {CONTENT}, t AS (SELECT content_id, substring('Title: ' || title || '. Type: ' || content_type || '. Genres: ' || array_to_string(genres, ', '), 1, 8000) AS text FROM content) SELECT * FROM t WHERE length(text) >= 20""")
def embedding_text(spark, sf_dir):
    return C.embedding_text(content(spark, sf_dir))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')[1:192] AS words FROM documents), e AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM w),
b AS (SELECT doc_id, CAST(CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % 768 AS INTEGER) AS bucket, sum(1 / (i + 1)) AS x FROM e GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM b GROUP BY 1)
SELECT doc_id, bucket, round(x / norm, 6) AS weight FROM b JOIN n USING (doc_id)""")
def text_hash_embedding(spark, sf_dir):
    return C.text_hash_embedding(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("weight", r6("weight"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, len(v) AS n, list_sum(v) AS t, list_sum(list_transform(v, lambda x: x * x)) AS q, list_max(v) - list_min(v) AS w FROM v)
SELECT vec_id, round(greatest(0.0, 1 - CASE WHEN n <> 64 THEN 0.5 ELSE 0 END - CASE WHEN sqrt(q) < 1e-6 THEN 0.3 ELSE 0 END - CASE WHEN sqrt(greatest(0, q / n - (t / n) * (t / n))) < 0.01 THEN 0.2 ELSE 0 END - CASE WHEN w < 0.1 THEN 0.1 ELSE 0 END), 6)::DOUBLE AS quality FROM s""")
def embedding_quality(spark, sf_dir):
    return C.embedding_quality(table(spark, sf_dir, "embeddings"), 64).withColumn("quality", r6("quality"))


@query(f"""WITH {CONTENT} SELECT content_id, coalesce(label, -1) AS label, embedding IS NOT NULL AS has_embedding FROM content LEFT JOIN embeddings ON vec_id = content_id""")
def annotation_join(spark, sf_dir):
    notes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("content_id"), "label", F.col("embedding").isNotNull().alias("has_embedding"))
    return C.annotation_join(content(spark, sf_dir).select("content_id"), notes, {"label": -1, "has_embedding": False})


@query(f"""WITH p AS (SELECT conv_id, turn, {keywords('text', C.POSITIVE)} AS p, {keywords('text', C.NEGATIVE)} AS n FROM conversations)
SELECT conv_id, turn, p AS positive, n AS negative, CASE WHEN p - n >= 2 THEN 'very_positive' WHEN p > n THEN 'positive' WHEN n - p >= 2 THEN 'very_negative' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM p""")
def lexicon_sentiment(spark, sf_dir):
    return C.lexicon_sentiment(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "positive", "negative", "sentiment")
