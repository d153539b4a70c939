"""Readers and sinks on small hand-written files."""

import gzip

from tidewater.sources import files


def test_csv_with_header(spark, tmp_path):
    (tmp_path / "r.csv").write_text("userId,movieId,rating,timestamp\n2,1,3.5,964982703\n1,7,4.0,964982704\n")
    out = files.csv_ratings(spark, str(tmp_path / "r.csv"), first=1).collect()
    assert [tuple(r) for r in out] == [(1, 7, 4.0, 964982704)]


def test_semicolon_latin1(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes('"ISBN";"Title";"Year"\n"1";"Caf\xe9";"2001"\n"2";"bad line"\n"3";"Ol\xe9";"1999"\n'.encode("latin-1"))
    out = files.semicolon_latin1(spark, str(tmp_path / "b.csv"), "isbn string, title string, year int").collect()
    assert {tuple(r) for r in out} == {("1", "Café", 2001), ("3", "Olé", 1999)}


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write('{"asin": "a", "overall": 5.0}\nnot json\n{"asin": "b", "overall": 1.0}\n')
    out = files.json_lines(spark, str(tmp_path / "r.json.gz"), "asin string, overall double").collect()
    assert {tuple(r) for r in out} == {("a", 5.0), ("b", 1.0)}


def test_block_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1:\n10,3,2005-09-06\n11,5,2005-05-13\n2:\nbroken\n10,4,2005-01-01\n")
    out = files.block_text(spark, str(tmp_path / "c.txt")).collect()
    assert {(r.user_id, r.item_id, r.rating, str(r.date)) for r in out} == {(10, 1, 3.0, "2005-09-06"), (11, 1, 5.0, "2005-05-13"), (10, 2, 4.0, "2005-01-01")}


def test_per_item_text(spark, tmp_path):
    (tmp_path / "mv_0000007.txt").write_text("7:\n10,3,2005-09-06\n")
    out = files.per_item_text(spark, str(tmp_path / "mv_0000007.txt")).collect()
    assert [(r.user_id, r.item_id, r.rating) for r in out] == [(10, 7, 3.0)]


def test_saved_table_reads_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    for _ in range(2):
        files.save(df, str(tmp_path / "t"), ["k"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("x", "k").collect()} == {(1, "a"), (2, "b")}


def test_envelope_keeps_malformed_texts(spark):
    df = spark.createDataFrame([('{"event_id": "1", "event_type": "view", "user_id": "u"}',), ("{oops",), (None,)], "value string")
    out = files.from_envelope(df).collect()
    assert [(r.event_type, r.malformed) for r in out] == [("view", None), (None, "{oops"), (None, None)]
