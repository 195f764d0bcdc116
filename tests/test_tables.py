"""Words in names, XML in splits, daily indexes as a source, tables that change together."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from finlark.operators.words import matches
from finlark.sources import commits, days, filings
from finlark.sources.xml import elements
from finlark.streaming import alerts, ingest


def test_words_in_names(spark):
    rnd = random.Random(2)
    made = lambda n: "".join(rnd.choice("abé ") for _ in range(n))
    names = [made(rnd.randrange(12)) for _ in range(300)] + ["", None, "ab", "ABBA"]
    words = [made(rnd.randrange(6)) for _ in range(200)] + ["", None, "nowhere at all", "BB"]
    got = {(r.w, r.n) for r in matches(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(n,) for n in names], "n string"), "n").collect()}
    assert got == {(w, n) for w in words for n in names if w is None or (n is not None and w in n)}


def test_many_rules_without_a_cartesian_product(spark):
    """100,000 rules with words of their own; each finds its name by a gram."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rules = spark.range(100_000).select(F.lit(1).alias("user_id"), F.col("id").alias("rule"), F.concat(F.lit("n"), F.col("id"), F.lit(";")).alias("word"), F.lit(0.0).alias("least"))
        events = spark.range(0, 100_000, 50).select(F.col("id").alias("filing_id"), F.concat(F.lit("name n"), F.col("id"), F.lit("; x")).alias("sector"), F.lit(1.0).alias("concern"))
        hits = alerts.matched(events, rules)
        plan = hits._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert hits.where("rule = filing_id").count() == hits.count() == 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_xml_is_read_in_splits(spark, tmp_path):
    """Elements over several lines, attributes, entities, a broken element, a root around all, more than one split."""
    good = [f'<entry lang="en">\n<title>t{i} &amp; é</title><link rel="x" href="u{i}"/>\n</entry>' for i in range(3000)]
    (tmp_path / "a.xml").write_text("<?xml version='1.0'?><feed>\n" + "\n".join(good) + "<entry><title>broken</entry>\n<entries>none</entries></feed>\n")
    (tmp_path / "b.xml").write_text("<feed></feed>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = elements(spark, str(tmp_path), "entry", "_lang string, title string, link struct<_href:string>")
        got = rows.collect()
        assert rows.rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.title, r.link._href, r._lang) for r in got if r.corrupt is None) == sorted((f"t{i} & é", f"u{i}", "en") for i in range(3000))
    assert [r.corrupt for r in got if r.corrupt is not None] == ["<entry><title>broken</entry>"]


def test_days_as_batch_and_stream(spark, tmp_path):
    """A week with a holiday, an empty day and a day of two files; the stream goes on after a restart and reads no day twice."""
    line = "320193|Apple|10-K|{}|edgar/data/320193/0000320193-25-00000{}.txt"
    for d in ("20250102", "20250103"):
        (tmp_path / f"{d}.idx").write_text(f"CIK|Name\n{line.format(d, 1)}\n" + line.format(d, 2))
    (tmp_path / "20250106.idx").write_text("")
    (tmp_path / "20250108.idx").mkdir()
    for k in (3, 4):
        (tmp_path / "20250108.idx" / f"part-{k}").write_text(line.format("20250108", k) + "\r\n")
    lines = days.catch_up(spark, str(tmp_path), "2025-01-01", "2025-01-08")
    assert lines.rdd.getNumPartitions() == 6
    assert sorted(str(r.day) for r in days.skipped(lines).collect()) == ["2025-01-01", "2025-01-07"]
    rows = filings.index_rows(lines, "day")
    assert sorted((str(r.day)[-2:], r.accession_number[-1]) for r in rows.collect()) == [("02", "1"), ("02", "2"), ("03", "1"), ("03", "2"), ("08", "3"), ("08", "4")]
    for last in ("2025-01-03", "2025-01-08"):
        stream = days.catch_up_stream(spark, str(tmp_path), "2025-01-01", last)
        ingest.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    told = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.day, r.found, r.value) for r in told.select("day", "found", F.coalesce("value", F.lit("")).alias("value")).collect()) == sorted((r.day, r.found, r.value or "") for r in lines.collect())
    assert told.select("batch").distinct().count() == 2 and told.agg(F.max("day")).first()[0] == date(2025, 1, 8)


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    told = lambda t: sorted(r.x for r in t.collect())
    held = commits.Tables(spark, str(tmp_path))
    assert held.versions() == [] and held.commit({"a": rows(1), "b": rows(10)}) == 1

    def broken(batch):
        raise ValueError("half-way")

    # The first table's files are written, the second one's fail.
    with pytest.raises(Exception, match="half-way"):
        held.commit({"a": rows(2), "b": rows(20).mapInArrow(broken, "x int")})
    assert told(held.read("a")) == [1] and told(held.read("b")) == [10] and held.versions() == [1]
    assert held.commit({"b": rows(20)}) == 2 and told(held.read("a")) == [1] and told(held.read("b")) == [20] and told(held.read("b", 1)) == [10]
    # Two writers from one version: the second one is told so, and changes nothing.
    other = commits.Tables(spark, str(tmp_path))
    assert other.commit({"a": rows(3)}, base=2) == 3
    with pytest.raises(commits.Conflict):
        held.commit({"a": rows(4), "b": rows(40)}, base=2)
    draft, final = held._path(f"{tmp_path}/draft"), held._path(held._manifest(3))
    held._fs.create(draft).close()
    assert held._renamed(draft, final) is False  # the rename itself refuses, not only the check before it
    assert told(held.read("a")) == [3] and told(held.read("b")) == [20]
    assert held.rollback(1) == 4 and told(held.read("a")) == [1] and told(held.read("b")) == [10]
    held.vacuum()
    assert held.versions() == [4] and told(held.read("a")) == [1] and len(list((tmp_path / "a").iterdir())) == 1
