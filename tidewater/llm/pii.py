"""Personal data by fixed formats and by bootstrapped contextual extraction, in native functions only.

Seeds are what the fixed formats find. The words around a seed make lexical
patterns: (its last two words before), and (last word before, shape of the
instance). Tokens that hold digits are instances: of four digits or more in
any pattern, of fewer where a pattern's seeds hold as few. A pattern's
confidence is the share of its instances that are known, an instance's score is
the noisy-or of its patterns, and the two are computed in turn over the whole
corpus. Instances that reach a high score support further patterns like seeds,
until a round adds no pattern and no instance and scores rise no more.
Instances that trusted patterns reach are reported as `found`. Tokens without a
digit are no instances.

A match's place is the running sum of the lengths of the pieces and matches
before it, so positions are code points. Expressions start at the start of a
run and are possessive, which gives the leftmost matches in linear time on long
texts; matches are rows, so that long texts with many matches need no long
arrays to be copied.

Null and empty texts have no spans; equal scores need no order; repeated rows
get equal results; an empty table gives an empty result; other columns are not
touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import hot_join, hot_keys, written

KINDS = ("email", "ip", "card", "phone", "found")
#: Fixed formats. A start inside a run could only match what the run's start would, so starts are the runs' (or the last match's end, \G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token between white space that holds a digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Characters before an instance that are looked at for its context.
NEAR = 64
#: What a scan gives for each text: matches of all kinds, each with the length of the piece between the last match of its kind and this, and that piece's end.
MATCHES = "array<struct<kind:int,gap:int,hit:string,before:string>>"
#: Seeds or found instances that must stand in a pattern; confidence of a trusted pattern; score of a found instance; digits of an instance in any pattern; rise of a score that asks for another round.
SUPPORT, TRUST, ENOUGH, DIGITS, RISE = 5, 0.6, 0.8, 4, 1e-3


def matches(text: Column, kind: int, pattern: str, may: Column) -> Column:
    """Array of (kind, gap, hit, before) of a pattern's matches; may is a quick test without which there are none."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.lit(kind).alias("kind"), F.length(p).alias("gap"), h.alias("hit"), F.right(p, F.lit(NEAR)).alias("before")))
    return F.when(may, rows).otherwise(F.array().cast(MATCHES))


def patterns(before: Column, value: Column) -> Column:
    """Lexical patterns of an instance: its last two words before it, and the last of them with the instance's shape."""
    low = F.lower(before)
    one = F.regexp_extract(low, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    two = F.regexp_extract(low, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    shape = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[A-Za-z]+", "a")
    own = F.array(F.when(two != "", F.concat(F.lit("two:"), two)), F.when(one != "", F.concat(F.lit("shape:"), one, F.lit(" "), shape)))
    return F.filter(own, lambda p: p.isNotNull())


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    every = F.transform(F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(every, F.lit(0), lambda a, x: a + x) % 10 == 0


def small(part: Column) -> Column:
    """Whether a string of digits is 255 at most, however many zeros it starts with."""
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return F.when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(F.lit(False))


def scan(text: Column) -> Column:
    """Matches of all kinds in a text; `found` are all tokens with a digit."""
    return F.concat(
        matches(text, 0, EMAIL, F.contains(text, F.lit("@"))),
        matches(text, 1, IP, text.rlike(r"[0-9]\.[0-9]")),
        matches(text, 2, CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
        matches(text, 3, PHONE, F.contains(text, F.lit("+"))),
        matches(text, 4, TOKEN, text.rlike("[0-9]")),
    )


def placed(found: DataFrame) -> DataFrame:
    """(row, start, kind, end, value, patterns) of the matches (row, pos, kind, gap, hit, before) that pass their kind's checks.

    Of kind 4 are the tokens without the punctuation around them that hold a
    digit and overlap nothing of the other kinds.
    """
    own = W.partitionBy("row", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.length("hit")).over(own), F.lit(0)) + F.col("gap")
    # one exchange serves both windows
    rows = found.repartition("row").withColumn("start", start.cast("int"))
    hit, kind = F.col("hit"), F.col("kind")
    good = F.when(kind == 1, F.forall(F.split(hit, r"\."), small))
    good = good.when(kind == 2, F.when(F.length(digits(hit)).between(12, 19), luhn(digits(hit))).otherwise(F.lit(False)))
    good = good.when(kind == 3, F.length(digits(hit)).between(9, 15)).otherwise(F.lit(True))
    lead = F.regexp_extract(hit, r"^[^A-Za-z0-9+@_\x{80}-\x{10FFFF}]*", 0)
    bare = F.regexp_replace(F.substr(hit, F.length(lead) + 1), r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+$", "")
    rows = rows.filter(good).withColumn("value", F.when(kind == 4, bare).otherwise(hit)).withColumn("start", F.col("start") + F.when(kind == 4, F.length(lead)).otherwise(0))
    rows = rows.withColumn("end", F.col("start") + F.length("value")).filter((kind < 4) | (F.length(digits(F.col("value"))) > 0))
    # running values in both orders; a frame that ends at the last row would be computed anew for each row
    order = W.partitionBy("row").orderBy("start", "kind", "pos").rowsBetween(W.unboundedPreceding, -1)
    back = W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    before = F.max(F.when(kind < 4, F.col("end"))).over(order)
    after = F.min(F.when(kind < 4, F.col("start"))).over(back)
    inside = (F.coalesce(before, F.lit(-1)) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end"))
    rows = rows.withColumn("inside", inside).filter((kind < 4) | ~F.col("inside"))
    return rows.select("row", "start", "kind", "end", "value", patterns(F.col("before"), F.col("value")).alias("patterns"))


def scored(edges: DataFrame) -> DataFrame:
    """(value) of the instances that trusted patterns reach, from (pattern, value, seed) edges with their count n."""
    held = F.length(digits(F.col("value")))
    fewest = edges.filter("seed").groupBy("pattern").agg(F.min(held).alias("fewest"))
    patterns_hot = hot_keys(edges, "pattern")
    edges = hot_join(edges, fewest, "pattern", patterns_hot, "left").filter(F.col("seed") | (held >= F.least(F.lit(DIGITS), F.coalesce("fewest", F.lit(DIGITS))))).drop("fewest")
    edges = written(edges, "edges")
    values_hot = hot_keys(edges, "value")
    known = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("seed"))
    state = None
    # scores never fall, so trusted patterns and found instances only grow and the rounds end
    while True:
        by_pattern = hot_join(edges.select("pattern", "value", "n"), known.select("value", "score"), "value", values_hot).groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("confidence"), F.count_if(F.col("score") >= ENOUGH).alias("support"))
        trusted = written(by_pattern.filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= TRUST)), "trusted")
        reached = hot_join(edges.select("pattern", "value"), trusted.select("pattern", "confidence"), "pattern", patterns_hot).groupBy("value").agg((1 - F.exp(F.sum(F.ln(1 - 0.99 * F.col("confidence"))))).alias("reach"))
        known = written(known.join(reached.hint("merge"), "value", "left").select("value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reach", F.lit(0.0))).alias("score"), "seed", F.col("score").alias("last")), "scores")
        risen = known.agg(F.count_if(F.col("score") >= ENOUGH).alias("found"), F.max(F.col("score") - F.col("last")).alias("rise")).first()
        new = (trusted.count(), risen.found)
        if new == state and (risen.rise or 0.0) <= RISE:
            break
        state = new
    return known.filter((F.col("score") >= ENOUGH) & ~F.col("seed")).select("value")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and spans, an array of (start, kind number in KINDS, end)."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # texts without a digit or an at sign hold neither formats nor instances
    found = F.when(F.col("text").rlike("[0-9@]"), scan(F.col("text"))).otherwise(F.array().cast(MATCHES))
    # written, so that a row keeps its number
    scanned = written(own.select("id", F.monotonically_increasing_id().alias("row"), found.alias("found")), "scan")
    every = scanned.filter(F.size("found") > 0).select("row", F.posexplode("found").alias("pos", "x")).select("row", "pos", "x.*")
    every = written(placed(every).withColumn("seed", F.col("kind") < 4), "spans")
    edges = every.select("value", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    known = written(scored(written(edges, "all_edges")), "found")
    new = hot_join(every.filter("not seed"), known, "value", hot_keys(every.filter("not seed"), "value"), "left_semi")
    columns = ["row", "start", "kind", "end"]
    spans = every.filter("seed").select(*columns).unionByName(new.select(*columns)).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return scanned.select("id", "row").join(written(spans, "by_row"), "row", "left").select("id", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("spans"))
