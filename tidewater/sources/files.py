"""Readers for rating files, sinks, and the event envelope.

Lines that do not parse are dropped where the format says so; types are given,
never inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Times keep their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
RATINGS = "user_id long, item_id long, rating double, ts long"
EVENT = "event_id string, event_type string, user_id string, ts timestamp, payload map<string,string>, source string, correlation_id string, retry_count int, deadline timestamp, metadata map<string,string>"


def csv_ratings(spark: SparkSession, path: str, schema: str = RATINGS, first: int | None = None) -> DataFrame:
    """Comma CSV with a header; `first` takes that many rows in the order of the schema's columns."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df if first is None else df.orderBy(*df.columns).limit(first)


def semicolon_latin1(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with ';', quoted, in latin-1; malformed lines go."""
    return spark.read.schema(schema).csv(path, header=True, sep=";", encoding="ISO-8859-1", mode="DROPMALFORMED")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, gzipped or not; lines that do not parse go."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def block_text(spark: SparkSession, path: str) -> DataFrame:
    """user_id, item_id, rating, date of 'item:' lines followed by 'user,rating,date' lines.

    Each file is one row, so the order of its lines is kept without a window;
    files of this format are split to a few hundred MB at most.
    """
    files = spark.read.text(path, wholetext=True)
    blocks = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^(\d+:\s*\n(?:(?!\d+:).*\n?)*)"), F.lit(1))).alias("block"))
    head = F.regexp_extract("block", r"^(\d+):", 1).cast("long")
    lines = blocks.select(head.alias("item_id"), F.explode(F.split("block", r"\n")).alias("line"))
    parts = F.split("line", ",")
    kept = lines.filter(F.size(parts) == 3).select("item_id", parts.alias("p"))
    return kept.select(F.col("p")[0].try_cast("long").alias("user_id"), "item_id", F.col("p")[1].try_cast("double").alias("rating"), F.col("p")[2].try_cast("date").alias("date"))


def per_item_text(spark: SparkSession, path: str) -> DataFrame:
    """The same columns of one file an item, its id in the file's name."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"(\d+)\.txt$", 1).try_cast("long").alias("item_id"), F.split("value", ",").alias("p"))
    return lines.filter(F.size("p") == 3).select(F.col("p")[0].try_cast("long").alias("user_id"), "item_id", F.col("p")[1].try_cast("double").alias("rating"), F.col("p")[2].try_cast("date").alias("date"))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns of the map renamed; others stay."""
    return df.withColumnsRenamed(names)


def coerced(df: DataFrame) -> DataFrame:
    """Columns cast by their names: times from epoch seconds or texts, ids and counts to long, ratings to double; bad values become null."""
    out = {}
    for f in df.schema:
        c, low = F.col(f.name), f.name.lower()
        if low in ("ts", "timestamp", "date") and f.dataType.typeName() != "timestamp":
            seconds = c.try_cast("bigint")
            out[f.name] = F.coalesce(F.timestamp_seconds(seconds), F.try_to_timestamp(c.cast("string")))
        elif low.endswith("_id") or low.endswith("_count"):
            out[f.name] = c.try_cast("bigint")
        elif "rating" in low or "score" in low:
            out[f.name] = c.try_cast("double")
    return df.withColumns(out) if out else df


def genre_array(column: str):
    """'A|B' as an array; null and '(no genres listed)' as an empty one."""
    none = F.array().cast("array<string>")
    return F.when(F.col(column).isNull() | (F.col(column) == "(no genres listed)"), none).otherwise(F.split(column, r"\|"))


def year_from_title(df: DataFrame, title: str = "title") -> DataFrame:
    """Adds publication_year from '(YYYY)' at the end of the title, and takes it off."""
    year = F.regexp_extract(title, r"\((\d{4})\)\s*$", 1).try_cast("int")
    return df.withColumn("publication_year", year).withColumn(title, F.trim(F.regexp_replace(title, r"\s*\(\d{4}\)\s*$", "")))


def unify(parts: dict[str, DataFrame]) -> DataFrame:
    """All interaction tables as one, with their dataset, a default type and parts of the time."""
    every = None
    for name, df in parts.items():
        own = df.withColumn("dataset", F.lit(name))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    if "interaction_type" not in every.columns:
        every = every.withColumn("interaction_type", F.lit(None).cast("string"))
    return every.withColumns({"interaction_type": F.coalesce("interaction_type", F.lit("rating")), "day_name": F.date_format("ts", "EEEE"), "is_weekend": F.weekday("ts") >= 5})


def feature_store(content: DataFrame, embeddings: DataFrame, interactions: DataFrame) -> DataFrame:
    """Content with whether it has an embedding, and its count of interactions, users and mean rating."""
    a = interactions.groupBy(F.col("item_id").alias("content_id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.avg("rating").alias("mean"))
    have = embeddings.select(F.col("vec_id").alias("content_id"), F.lit(True).alias("has_embedding"))
    return content.join(have, "content_id", "left").join(a, "content_id", "left").fillna({"has_embedding": False, "n": 0, "users": 0})


def save(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Write as Parquet, partitioned by the columns, replacing what is there."""
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(path)


def from_envelope(df: DataFrame, column: str = "value") -> DataFrame:
    """Event columns from JSON texts; `malformed` holds texts that are no event."""
    parsed = df.withColumn("_e", F.from_json(F.col(column).cast("string"), EVENT, TIMES))
    bad = F.col("_e").isNull() | F.col("_e.event_type").isNull()
    return parsed.select("_e.*", F.when(bad, F.col(column).cast("string")).alias("malformed"))


def to_envelope(df: DataFrame):
    """Events as one JSON text a row."""
    return df.select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct(*df.columns), TIMES).alias("value"))
