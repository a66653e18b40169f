"""Runs, output families and record updates, with writes that die half way."""

import hashlib
import itertools
import os

import pytest
from pyspark.sql import functions as F

from siltstone.sources import runs


def tables(spark, n):
    return {"input": spark.range(n), "output": spark.range(n).selectExpr("id * 2 AS twice")}


def test_latest_follows_whole_runs_only(spark, tmp_path):
    root = str(tmp_path)
    assert runs.latest_run(spark, root, "scenario") is None
    with pytest.raises(ValueError, match="no run"):
        runs.read_run(spark, root, "scenario", "output")
    runs.publish(tables(spark, 3), root, "scenario", "2026-01-01-a")
    runs.publish(tables(spark, 5), root, "scenario", "2026-01-02-b")
    assert runs.read_run(spark, root, "scenario", "output").count() == 5
    assert runs.read_run(spark, root, "scenario", "input", "2026-01-01-a").count() == 3
    assert runs.complete_runs(spark, root, "scenario") == ["2026-01-01-a", "2026-01-02-b"]


def test_a_killed_run_leaves_the_old_one_readable(spark, tmp_path):
    root = str(tmp_path)
    runs.publish(tables(spark, 3), root, "scenario", "a")
    broken = tables(spark, 4) | {"output": spark.range(4).select(F.raise_error(F.lit("killed")).alias("twice"))}
    with pytest.raises(Exception, match="killed"):
        runs.publish(broken, root, "scenario", "b")
    assert runs.latest_run(spark, root, "scenario") == "a" and runs.complete_runs(spark, root, "scenario") == ["a"]
    assert runs.read_run(spark, root, "scenario", "output").count() == 3
    runs.publish(tables(spark, 4), root, "scenario", "b")
    assert runs.read_run(spark, root, "scenario", "output").count() == 4
    # a run does not change once it is complete
    runs.publish(tables(spark, 9), root, "scenario", "b")
    assert runs.read_run(spark, root, "scenario", "output").count() == 4


def document(spark, n):
    return spark.createDataFrame([(f"ID-{n}", f"2026-01-0{n}", f"body {n}")], "id string, created_at string, body string")


def state(spark, root):
    row = runs.read_run(spark, root, "memo", "document").first()
    return runs.latest_run(spark, root, "memo"), tuple(row), runs.archived(spark, root, "memo")


@pytest.mark.parametrize("family", sorted(runs.FAMILIES))
def test_interrupted_commits_end_as_whole_ones(spark, tmp_path, monkeypatch, family):
    whole = str(tmp_path / "whole")
    for n in (1, 2, 3):
        runs.commit(document(spark, n), whole, "memo", family, f"v{n}")
    kept = family in ("canonical", "fixed")
    assert state(spark, whole) == ("v3", ("ID-1" if kept else "ID-3", "2026-01-01" if kept else "2026-01-03", "body 3"), [] if family == "fixed" else ["v1", "v2"])
    steps = [("_written", 0), ("_written", 1), ("_delete", 0)]
    for (step, at), n in itertools.product(steps, (1, 2, 3)):
        root = str(tmp_path / f"{step}{at}{n}")
        for k in (1, 2, 3):
            if k == n:
                calls, real = itertools.count(), getattr(runs, step)

                def dies(*args, calls=calls, real=real, at=at):
                    if next(calls) == at:
                        raise OSError("killed")
                    return real(*args)

                with monkeypatch.context() as patch:
                    patch.setattr(runs, step, dies)
                    try:
                        runs.commit(document(spark, k), root, "memo", family, f"v{k}")
                    except OSError:
                        if k > 1:
                            assert state(spark, root)[1][2] in (f"body {k - 1}", f"body {k}")
            runs.commit(document(spark, k), root, "memo", family, f"v{k}")
        assert state(spark, root) == state(spark, whole)


def digests(path):
    return {f: hashlib.sha256(open(os.path.join(path, f), "rb").read()).hexdigest() for f in os.listdir(path) if f.startswith(("part-", "0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "a", "b", "c", "d", "e", "f"))}


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_update_changes_only_the_files_that_hold_a_match(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    spark.range(100, numPartitions=10).select("id", F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("a.b")).write.format(kind).option("ignoreNullFields", False).save(path)
    schema = "id long, text string, `a.b` string"
    before = digests(path)
    n = runs.update_records(spark, path, F.col("id").isin(5, 7, 42), {"text": F.concat("text", F.lit("!")), "a.b": F.lit("x")}, kind, schema)
    after = digests(path)
    assert n == 3 and len(before.items() & after.items()) == 8
    rows = {r.id: (r.text, r["a.b"]) for r in spark.read.format(kind).schema(schema).load(path).collect()}
    assert rows == {i: (f"t{i}!", "x") if i in (5, 7, 42) else (f"t{i}", None) for i in range(100)}
    assert runs.update_records(spark, path, F.col("id") > 1000, {"text": F.lit("")}, kind, schema) == 0 and digests(path) == after


@pytest.mark.parametrize("dies_at", [0, 1, 2, 3])
def test_an_interrupted_update_is_finished_or_undone(spark, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "t")
    spark.range(40, numPartitions=4).select("id", F.lit(0).alias("n")).write.parquet(path)
    calls, real = itertools.count(), runs._moved

    def dies(*args):
        if next(calls) == dies_at:
            raise OSError("killed")
        return real(*args)

    monkeypatch.setattr(runs, "_moved", dies)
    died = False
    try:
        runs.update_records(spark, path, F.col("id") % 10 == 3, {"n": F.lit(1)})
    except OSError:
        died = True
    assert died
    monkeypatch.undo()
    runs.finish_updates(spark, path)
    rows = {r.id: r.n for r in spark.read.parquet(path).collect()}
    # before the journal is there nothing has changed; from then on all has
    assert rows == {i: int(i % 10 == 3 and dies_at > 0) for i in range(40)}
    assert not [f for f in os.listdir(path) if f.startswith(("_new-", "_swap-"))]
