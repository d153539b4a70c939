"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_repair, decontaminate, hash_search, license_scan, lsh_forest, mixing, pii, prefix_trie, quality, secret_scan, toxicity, url_rules
from .base import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_text(spans, kinds: tuple[str, ...]):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op2_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity.train(docs, labels)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.col("start").alias("worst_start"), F.col("end").alias("worst_end"), "worst")


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


#: The fixed host-and-path rules of the query.
PATH_RULES = [
    url_rules.PathRule("com", "/", "allow"),
    url_rules.PathRule("example.com", "/en/", "block"),
    url_rules.PathRule("www.example.com", "/en/", "allow"),
    url_rules.PathRule("net", "/es/", "block"),
    url_rules.PathRule("net", "/fr/", "block"),
]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_rules.judge_urls(table(spark, sf_dir, "pages"), PATH_RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "pattern")


def op5_secret_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return out.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(base, secret_scan.KINDS), 256).alias("base_sha256"), span_text(F.col("spans"), secret_scan.KINDS).alias("spans"))


def op6_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.score(docs, quality.train(docs, labels)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference", "share")


def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return out.select(F.col("id").alias("doc_id"), count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"), F.sha2(span_text(base, pii.KINDS), 256).alias("base_sha256"), span_text(F.col("spans"), pii.KINDS).alias("spans"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_search.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.judged(decontaminate.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return chat_repair.report(chat_repair.damage(rows), rows.select("conv_id"), conv_col="conv")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).drop("ref_conv", "ref_pos")


def queries() -> dict:
    return {f.__name__: f for f in (op1_pareto_mix, op2_toxicity_mil, op3_lsh_forest, op4_url_rules, op5_secret_tokens, op6_zstd_quality, op7_pii_bootstrap, op8_multi_index_hashing, op9_license_index, op10_decontaminate, op11_auction_repair, op12_byte_bpe, op13_prefix_trie)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Near-duplicates by an exact join on shingles, and components by reachability.
OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(x) = 1 THEN x[1] ELSE x[i] || ' ' || x[i + 1] END AS s FROM w, LATERAL unnest(range(1, greatest(2, len(x)))) t(i) WHERE len(x) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id) LEFT JOIN m ON d.doc_id = m.a"""


def _rule_case(field: str) -> str:
    """The value of the longest rule that fits, as a CASE."""
    rules = sorted(PATH_RULES, key=lambda r: -len(r.name))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'" for r in rules)


def _op4() -> str:
    patterns = " ".join(f"WHEN regexp_matches(low, '{p.pattern}') THEN '{p.name}'" for p in url_rules.PATTERNS)
    return rf"""WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
v AS (SELECT page_id, host, path, {_rule_case("name")} END AS rule, {_rule_case("verdict")} END AS given, CASE {patterns} END AS pattern FROM h)
SELECT page_id, host, path, rule, CASE WHEN given IS NOT NULL THEN given WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM v"""


#: Contamination by a join of all windows of the items' lengths.
OP10 = rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'), []) AS x FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS y FROM benchmark),
i AS (SELECT DISTINCT item_id, least(13, len(y)) AS k, array_to_string(y[s:s + least(13, len(y)) - 1], ' ') AS win FROM b, LATERAL unnest(range(1, greatest(2, len(y) - 11))) t(s) WHERE len(y) > 0),
c AS (SELECT doc_id, s, k, array_to_string(x[s:s + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM i) q, LATERAL unnest(range(1, greatest(1, len(x) - k + 2))) t(s)),
h AS (SELECT doc_id, s, c.k, item_id FROM c JOIN i ON c.k = i.k AND c.win = i.win),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, LATERAL unnest(range(s, s + k)) t(p) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT doc_id, len(x) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(x) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters, bit by bit."""
    step = "lambda u, v: xor(u >> 1, 3988292384::UBIGINT * (u & 1::UBIGINT))"
    codes = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::UBIGINT[]), {step})), 4294967295::UBIGINT)"


def _op11() -> str:
    """Cheapest edits row by row: for each state the least (cost, letters, lines) so far."""

    def on(p: str, cost: str, letter: str, line: str = "") -> str:
        return f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {cost}, 'e': {p}.e || '{letter}', 't': {f"list_append({p}.t, {line})" if line else f"{p}.t"}}} END"

    def kept(p: str, initial: str) -> str:
        return f"CASE WHEN live AND a = '{initial}' THEN {on(p, 'cut', 'K', "role || ':' || text")} END"

    def changed(p: str, role: str) -> str:
        return f"CASE WHEN live THEN {on(p, '(1 + cut)', 'R', f"'{role}:' || text")} END"

    def closed(table: str) -> str:
        """Inserts after each state, two at most."""
        u = f"least(n2, {', '.join(on(p, '5', 'I', "'user:'") for p in ('n0', 'n1', 'n3'))})"
        return f"SELECT id, i, n0 AS p0, n1 AS p1, q2 AS p2, least(n3, {on('q2', '5', 'I', "'assistant:'")}) AS p3 FROM (SELECT *, {u} AS q2 FROM {table})"

    none = "NULL::STRUCT(c BIGINT, e VARCHAR, t VARCHAR[])"
    steps = ", ".join(
        f"least({', '.join(x)}) AS n{k}"
        for k, x in enumerate((
            [on("p0", "2", "D")],
            [on("p1", "2", "D"), kept("p0", "s")],
            [on("p2", "2", "D"), *(f(p, x) for p in ("p0", "p1", "p3") for f, x in ((kept, "u"), (changed, "user")))],
            [on("p3", "2", "D"), kept("p2", "a"), changed("p2", "assistant")],
        ))
    )
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS f FROM conversations),
d AS (SELECT coalesce(conv_id::VARCHAR, '') AS id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, LATERAL unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) x),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS i FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY i) > 1 AS again, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS a FROM o),
h AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(a) OVER (PARTITION BY id ORDER BY i) AS b FROM g),
w AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS live, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS cut FROM h),
ids AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS id FROM conversations),
r AS ({closed(f"(SELECT id, 0 AS i, {{'c': 0::BIGINT, 'e': '', 't': []::VARCHAR[]}} AS n0, {none} AS n1, {none} AS n2, {none} AS n3 FROM ids)")}
UNION ALL {closed(f"(SELECT r.id, w.i, {steps} FROM r JOIN w ON r.id = w.id AND w.i = r.i + 1)")}),
z AS (SELECT id, least(arg_max(p0, i), arg_max(p3, i)) AS z FROM (SELECT id, i, coalesce(p0, {{'c': 1::BIGINT << 40, 'e': '', 't': []::VARCHAR[]}}) AS p0, coalesce(p3, {{'c': 1::BIGINT << 40, 'e': '', 't': []::VARCHAR[]}}) AS p3 FROM r) GROUP BY id),
s AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(b IS NOT NULL AND b || a NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY id)
SELECT conv_id, {', '.join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, z.c AS cost, z.e AS audit, sha256(array_to_string(z.t, chr(10))) AS repaired_sha256
FROM ids JOIN z USING (id) LEFT JOIN s USING (id)"""


#: Rebuilt conversations as lists, and nodes as their distinct beginnings.
OP13 = f"""WITH t AS (SELECT conv_id, r AS role, x AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || x)) - 1 AS i FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, ({_crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = base AND i < h UNION ALL SELECT conv_id, 1, i, role, text FROM c JOIN t USING (conv_id) WHERE i >= h),
l AS (SELECT conv_id, coalesce(x, []) AS x FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY part, i) AS x FROM b GROUP BY 1) USING (conv_id)),
p AS (SELECT conv_id, d AS depth, x[:d] AS x, d = len(x) AS ends FROM l, LATERAL unnest(range(len(x) + 1)) u(d)),
n AS (SELECT depth, x, x[:depth - 1] AS above, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * length(x[depth].text) END AS saved FROM p GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, above AS x, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (depth, x)),
s AS (SELECT a.depth, a.x, count_if(b.n_children = 0) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens FROM m a JOIN m b ON b.depth >= a.depth AND b.x[:a.depth] = a.x GROUP BY 1, 2)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(coalesce(m.ids, '')) AS ends_sha256
FROM m JOIN s USING (depth, x) LEFT JOIN m q ON m.depth > 0 AND q.depth = m.depth - 1 AND q.x = m.above"""


def oracle_sql() -> dict[str, str]:
    """The others train on samples, draw by hash, or search approximately; tests hold them against plain Python."""
    return {"op3_lsh_forest": OP3, "op4_url_rules": _op4(), "op10_decontaminate": OP10, "op11_auction_repair": _op11(), "op13_prefix_trie": OP13}
