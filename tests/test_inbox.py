"""The ingest loop: what it records, and that nothing is recorded twice."""

import hashlib
import json

import pytest

from siltstone.streaming import inbox

SECRET = "AKIA" + "ABCDEFGHIJKLMNOP"
FILES = {
    "a/report.md": "---\ntitle: Quarterly supply paper\nreview_status: text_reviewed\n---\n# Heading one\n\nThe supply of copper grew.\n\nDemand did not.\n",
    "b/page.html": "<html><title>Page about freight rates</title><body><p>Freight rose.</p><script>x</script></body></html>",
    "b/copy.md": None,
    "c/keys.txt": f"plain line\nkey {SECRET} here\n",
    "c/data.csv": "name,value\nx,1\n",
    "notes/meeting-agenda_for-april.txt": "12\n",
    "shot.png": "not text",
    "empty.txt": " \n",
    "node_modules/x.md": "skipped",
}
FILES["b/copy.md"] = FILES["a/report.md"]


def put(folder, files):
    for name, text in files.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def run(spark, tmp_path, checkpoint="one", **more):
    query = inbox.ingest_stream(spark, str(tmp_path / "inbox"), str(tmp_path / "store"), str(tmp_path / f"checkpoint-{checkpoint}"), 4, **more)
    query.awaitTermination(240)
    assert query.exception() is None
    return {r.path: r for r in inbox.ledger(spark, str(tmp_path / "store")).collect()}


@pytest.fixture(scope="module")
def taken(spark, tmp_path_factory):
    tmp_path = tmp_path_factory.mktemp("inbox")
    put(tmp_path / "inbox", FILES)
    put(tmp_path / "inbox", {"shot.png.source.json": json.dumps({"title": "Screens of the yield curve", "extracted_text": "A chart of yields."})})
    return tmp_path, run(spark, tmp_path)


def test_records(spark, taken):
    tmp_path, found = taken
    assert set(found) == set(FILES) - {"node_modules/x.md"}
    one = found["a/report.md"]
    assert (one.title, one.source_type, one.folder, one.status, one.review_status) == ("Quarterly supply paper", "article", "web", "ingested", "text_reviewed")
    assert one.checksum == hashlib.sha256(FILES["a/report.md"].encode()).hexdigest() and one.id == "SRC-" + one.checksum[:12].upper()
    copy = found["b/copy.md"]
    assert {one.status, copy.status} == {"ingested", "duplicate"} and {one.duplicate_of, copy.duplicate_of} == {None, "a/report.md"}
    assert found["b/page.html"].title == "Page about freight rates" and found["b/page.html"].source_type == "web"
    bad = found["c/keys.txt"]
    assert (bad.status, bad.hits, bad.summary) == ("quarantined", "aws_access_key:1", None)
    assert found["notes/meeting-agenda_for-april.txt"].title == "Meeting Agenda For April" and found["notes/meeting-agenda_for-april.txt"].document_class == "meeting_notes"
    assert found["c/data.csv"].document_class == "dataset_snapshot"
    assert found["empty.txt"].status == "ingested" and found["empty.txt"].summary is None
    texts = {r.path: r.text for r in spark.read.parquet(str(tmp_path / "store" / "texts")).collect()}
    assert "c/keys.txt" not in texts and "b/copy.md" not in texts and "The supply of copper grew." in texts["a/report.md"]
    hits = spark.read.parquet(str(tmp_path / "store" / "hits")).collect()
    assert [(h.path, h.line, h.preview) for h in hits] == [("c/keys.txt", 2, "key AKIA...MNOP here")]


def test_running_again_adds_nothing(spark, taken):
    tmp_path, found = taken
    assert run(spark, tmp_path) == found
    assert run(spark, tmp_path, "another") == found
    assert inbox.ledger(spark, str(tmp_path / "store")).count() == len(found)


def test_a_batch_that_is_repeated_writes_the_same(spark, tmp_path):
    put(tmp_path / "inbox", FILES)
    place, store = str(tmp_path / "inbox"), str(tmp_path / "store")
    batch = spark.read.format("binaryFile").schema(inbox.FILES).option("recursiveFileLookup", True).load(place)
    rows = []
    for _ in range(2):
        inbox.take_in(batch, "q", 0, place, store)
        rows.append(sorted(map(str, inbox.ledger(spark, store).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == len(FILES) - 1


def test_later_copies_and_allowed_secrets(spark, taken):
    tmp_path, found = taken
    put(tmp_path / "inbox", {"late/report.md": FILES["a/report.md"], "late/keys2.txt": f"another {SECRET}\n"})
    late = run(spark, tmp_path, allow_sensitive=True)
    assert set(late) - set(found) == {"late/report.md", "late/keys2.txt"}
    assert late["late/report.md"].status == "duplicate" and late["late/report.md"].duplicate_of == "a/report.md"
    kept = late["late/keys2.txt"]
    assert (kept.status, kept.hits, kept.review_status) == ("ingested", "aws_access_key:1", "unreviewed")
