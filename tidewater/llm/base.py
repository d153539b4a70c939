"""What the operators share: shared-folder tables and byte-level word splitting."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by spark.checkpoint.dir.

    Only where a local session names none (tests) a temporary folder serves;
    on a cluster that would be lost with its machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = found.get() if found.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs one stage, and gives
    later joins true sizes instead of estimates.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, hot) of the values that more than a thousandth of the rows have, hence fewer than 1000 values; small tables have none below 100 rows."""
    counts = written(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    return written(counts.filter(F.col("_n") > max(100, total // 1000)).select(key, F.lit(True).alias("_hot")), "hot")


def hot_join(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to `one`, which has a row a key at most; rows of hot keys (see hot_keys) stay where they are and get theirs by a broadcast of fewer than 1000 rows."""
    marked = rows.join(F.broadcast(hot), key, "left")
    few = one.join(F.broadcast(hot.select(key)), key, "left_semi")
    near = marked.filter("_hot").drop("_hot").join(F.broadcast(few), key, how)
    return near.unionByName(marked.filter("_hot is null").drop("_hot").join(one.hint("merge"), key, how))


def sent(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of a value of bounded size whose classes travel with it; tasks take it out by `received`."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    return pickle.loads(shared.value)


def words_table() -> bytes:
    """Byte map of the word rule: A-Z lower-cased, other ASCII that is no letter or digit to a space.

    All bytes of a non-ASCII character are 0x80 or more and stay, so splitting
    the mapped bytes at spaces gives the words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
    """
    out = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            out[b] = b + 32 if 0x41 <= b <= 0x5A else b
    return bytes(out)


WORDS = words_table()


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters; none for null."""
    return (text or b"").translate(WORDS).split()


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder: such rows' labels are never learned from. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, modulus: int, remainder: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most per_class documents of each label, least hash of their id first, as (label, part, text bytes), and the labels' counts.

    Only rows that are not held out count. part is 0 or 1, a halving by hash.
    An id with several labels has the largest. The chosen ids are broadcast:
    they are 2 * per_class rows at most.
    """
    own = labels.filter(F.col(label).isNotNull() & ~held_out(id_col, modulus, remainder)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label")).filter("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    order = F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30))

    def first(label: int) -> DataFrame:
        # the share lets about twice per_class pass, so that many partitions do not each send per_class rows
        share = min(1 << 30, (1 << 31) * per_class // max(counts.get(label, 0), 1))
        return own.filter((F.col("label") == label) & (order < F.lit(share))).orderBy(order, "_id").limit(per_class)

    chosen = first(0).unionByName(first(1))
    chosen = written(chosen.withColumn("part", F.pmod(F.xxhash64(F.lit(6), "_id"), F.lit(2)).cast("int")), "sample")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "_id")
    # written, so that a caller that fits in one task reads the sample there and not the documents
    return written(rows.select("label", "part", "text"), "sampled"), counts
