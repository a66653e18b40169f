"""Due and pending as a stream against the batch form, over restarts and disorder."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.operators.events import due
from siltstone.streaming import memory


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(dict(zip(("owner", "scope", "at", "action"), (o, s, a.isoformat() + "Z", k)))) + "\n" for o, s, a, k in rows))


def run(spark, folder, out, late="0 seconds"):
    """One start of the query from its checkpoint, until all files are read."""
    query = memory.due_stream(memory.read_log(spark, str(folder), 1), late).writeStream.outputMode("update")
    query = query.option("checkpointLocation", f"{out}-checkpoint").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()


def test_stream_equals_the_batch_form_after_restarts(spark, tmp_path):
    random.seed(2)
    start = datetime(2025, 12, 27, 6)
    log = [(o, s, start + timedelta(hours=random.randint(0, 24 * 12), minutes=i), random.choice(["packed", "captured", "used"])) for i in range(40) for o in ("a", "b", None) for s in ("daily", "weekly")]
    log.sort(key=lambda r: r[2])
    # some come out of order within what the watermark allows
    for i in range(0, len(log) - 9, 9):
        log[i], log[i + 8] = log[i + 8], log[i]
    folder, out = tmp_path / "log", str(tmp_path / "out")
    for k in range(3):
        put(folder, f"f{k}", log[k * 80 : (k + 1) * 80])
        run(spark, folder, out, "5 days")
    changes = spark.read.parquet(out).where("cause <> 'period over'")
    held = {(r.owner, r.scope): (r.exists, r.captured_key, r.pending_key) for r in memory.current(changes).collect()}
    whole = spark.createDataFrame(log, "owner string, scope string, at timestamp, action string")
    assert held == {(r.owner, r.scope): (r.exists, r.captured_key, r.pending_key) for r in memory.state_of(whole).collect()}
    # and what is due then follows from either
    as_of = F.lit("2026-01-08 09:00:00").cast("timestamp")
    show = lambda df: {(r.owner, r.scope, r.pending, r.due) for r in due(df, as_of).collect()}
    assert show(memory.current(changes).select("owner", "scope", "exists", "captured_key", "pending_key")) == show(memory.state_of(whole))


def test_first_use_captures_and_the_next_period_is_due_by_its_timer(spark, tmp_path):
    folder, out, at = tmp_path / "log", str(tmp_path / "out"), datetime(2026, 4, 7, 9, 15)
    put(folder, "a", [("me", s, at + timedelta(minutes=m), k) for s in ("daily", "weekly") for m, k in ((0, "used"), (1, "packed"), (2, "captured"))])
    run(spark, folder, out)
    rows = {r.scope: r for r in memory.current(spark.read.parquet(out)).collect()}
    assert all(not r.due and not r.pending and r.exists for r in rows.values())
    assert rows["daily"].key == "2026-04-07" and rows["weekly"].key == "2026-W15"
    # another owner's event a day later moves the watermark: the day is over, the week is not
    put(folder, "b", [("you", "daily", at + timedelta(days=1, hours=3), "used")])
    run(spark, folder, out)
    put(folder, "c", [("you", "daily", at + timedelta(days=1, hours=4), "packed")])
    run(spark, folder, out)
    rows = {(r.owner, r.scope): r for r in memory.current(spark.read.parquet(out)).collect()}
    assert rows["me", "daily"].due and rows["me", "daily"].key == "2026-04-08" and rows["me", "daily"].cause == "period over"
    assert not rows["me", "weekly"].due and rows["you", "daily"].pending
    assert spark.read.parquet(out).where("owner = 'me' AND cause = 'period over'").count() == 1


def test_periods():
    assert memory.period_key("weekly", datetime(2026, 1, 1)) == "2026-W01" and memory.period_key("weekly", datetime(2027, 1, 3)) == "2026-W53"
    assert memory.next_period("weekly", datetime(2026, 4, 6)) == datetime(2026, 4, 13) and memory.next_period("weekly", datetime(2026, 4, 12, 23)) == datetime(2026, 4, 13)
    assert memory.next_period("daily", datetime(2026, 4, 6, 5)) == datetime(2026, 4, 7)
