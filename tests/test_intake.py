"""Sinks, rendering and small lookups that no query reaches, on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F
from siltstone.operators import concepts, intake, watch
from siltstone.sources import notes
from siltstone.streaming import events


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_frontmatter_reads_back(spark):
    fields = F.create_map(*[F.lit(x) for x in ("title", "A plain title", "colon", "a: b", "quote", 'say "x"', "number", "12", "truth", "true", "empty", "", "space", " y ")])
    text = one(spark, intake.markdown(fields, F.lit("  body\n")))
    assert text == '---\ntitle: A plain title\ncolon: "a: b"\nquote: "say \\"x\\""\nnumber: "12"\ntruth: "true"\nempty: ""\nspace: " y "\n---\n\nbody\n'


def test_safe_sink_clips_and_refuses(spark):
    fields = F.create_map(F.lit("title"), F.lit("t" * 300), F.lit("note"), F.lit("n" * 5000))
    out = one(spark, intake.safe_fields(fields))
    assert len(out["title"]) == 240 and len(out["note"]) == 4000 and out["title"].endswith("…")
    assert one(spark, intake.safe_body(F.lit("fine"), 10)) == "fine"
    for body in ("  ", "x" * 11):
        with pytest.raises(Exception, match="the body is"):
            one(spark, intake.safe_body(F.lit(body), 10))


def test_sidecar_parts_and_types(spark):
    kept, changed = intake.split_sidecar(F.create_map(F.lit("extracted_text"), F.lit("t"), F.lit("author"), F.lit("a")))
    assert one(spark, F.struct(kept.alias("k"), changed.alias("c"))).asDict() == {"k": {"author": "a"}, "c": {"extracted_text": "t"}}
    rows = spark.createDataFrame([("a/B.PDF", False), ("dir.csv", True), ("noext", False), (None, False)], "path string, d boolean")
    assert [r.t for r in rows.select(intake.source_type(F.col("path"), F.col("d")).alias("t")).collect()] == ["paper", "repo", "note", "note"]
    assert one(spark, intake.dataset_preview(F.lit("a\tbb\n1\t2"))) == "| a   | bb  |\n| --- | --- |\n| 1   | 2   |"
    assert one(spark, intake.dataset_preview(F.lit("plain\ntext"))) == "plain\ntext"
    assert one(spark, intake.dataset_preview(F.lit(None).cast("string"))) == ""
    assert one(spark, intake.source_url(F.lit(""), F.lit(None).cast("string"), F.lit("u"))) == "u"


def test_long_texts_are_sampled_at_three_places(spark):
    text = "a" * 50 + "b" * 50 + "c" * 50
    assert one(spark, concepts.sampled(F.lit(text), 30)) == "a" * 10 + "\n" + "b" * 10 + "\n" + "c" * 10
    assert one(spark, concepts.sampled(F.lit("short"), 30)) == "short"
    assert one(spark, concepts.entity_names(F.lit("Old Mill and OLD MILL near USA, EU; old"), F.lit("usa"))) == ["Old Mill"]


def test_labels_and_event_texts(spark):
    assert one(spark, watch.is_broad(F.lit("An Entire Corpus view"))) and not one(spark, watch.is_broad(F.lit("oil")))
    say = lambda c, path=None: one(spark, watch.event_summary(F.lit(c), F.lit(3.0), F.lit(" t "), F.lit(path)))
    assert say("ingest") == "Ingested 3 file(s) into the knowledge base." and say("doctor") is None
    assert say("deck") == "Prepared a deck authored pack for t." and say("watch-refresh", "p.md") == "Refreshed watch surveillance and wrote p.md."
    assert one(spark, watch.percent(F.lit(0.1234))) == "12.3%" and one(spark, watch.basis_points(F.lit(float("inf")))) == "n/a"


def test_readers(spark, tmp_path):
    assert notes.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert notes.json_or_empty(spark, str(tmp_path / "x.json"), "a int").count() == 2
    texts = ["short", "This is a readable page with quite enough letters in it.", "12345 67890 " * 10, "a b c d wordy " * 8]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.u for r in rows.orderBy("i").select(notes.is_unreadable(F.col("t")).alias("u")).collect()] == [True, False, True, True]


def test_first_seen_as_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = spark.createDataFrame([(at, "a"), (at, "b"), (at, "a")], "ts timestamp, content string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = events.first_seen(stream, "ts", "content").writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    assert sorted(r.content for r in spark.table("first_seen").collect()) == ["a", "b"]
