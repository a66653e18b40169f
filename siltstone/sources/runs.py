"""Runs that never change behind a pointer to the latest, and updates of single records in a folder of files.

A run is a folder of tables, complete once its marker is there; the pointer is one small file that is swapped by a rename.
Readers follow the pointer, so they see the run before or the run after, never a half-written one. Every step may be
repeated: a run that is complete is only pointed at again, one that is not is written anew.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_complete"
POINTER = "_latest"


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(file system, path) of a name, wherever it is kept."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _place(spark, path)
    return files.exists(at)


def _names(spark: SparkSession, path: str) -> list[str]:
    files, at = _place(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _place(spark, path)
    files.delete(at, True)


def _moved(spark: SparkSession, old: str, new: str) -> None:
    """Rename in one step, over what the new name held."""
    jvm = spark._jvm
    over = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    files, at = _place(spark, old)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(at, jvm.org.apache.hadoop.fs.Path(new), over)


def _written(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    files, at = _place(spark, draft)
    out = files.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    _moved(spark, draft, path)


def _said(spark: SparkSession, path: str) -> str | None:
    files, at = _place(spark, path)
    if not files.exists(at):
        return None
    held = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def folder(root: str, family: str, run: str) -> str:
    return f"{root.rstrip('/')}/{family}/run={run}"


def publish(tables: dict[str, DataFrame], root: str, family: str, run: str) -> str:
    """Write the tables as the run, then make it the family's latest; the run's folder."""
    spark, at = next(iter(tables.values())).sparkSession, folder(root, family, run)
    if not _exists(spark, f"{at}/{MARKER}"):
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{at}/{name}")
        _written(spark, f"{at}/{MARKER}", "\n".join(sorted(tables)))
    _written(spark, f"{root.rstrip('/')}/{family}/{POINTER}", run)
    return at


def complete_runs(spark: SparkSession, root: str, family: str) -> list[str]:
    """Names of the runs that were written to the end, in order."""
    found = [n.removeprefix("run=") for n in _names(spark, f"{root.rstrip('/')}/{family}") if n.startswith("run=")]
    return [r for r in found if _exists(spark, f"{folder(root, family, r)}/{MARKER}")]


def latest_run(spark: SparkSession, root: str, family: str) -> str | None:
    return _said(spark, f"{root.rstrip('/')}/{family}/{POINTER}")


def read_run(spark: SparkSession, root: str, family: str, table: str, run: str | None = None) -> DataFrame:
    """A table of a run, of the latest one unless another is named."""
    run = run or latest_run(spark, root, family)
    if run is None:
        raise ValueError(f"no run of {family} is published")
    return spark.read.parquet(f"{folder(root, family, run)}/{table}")


#: Output families: whether older versions stay in the archive, and whether the first version's id and date are kept.
FAMILIES = {"timestamped": (True, False), "rolling": (True, False), "canonical": (True, True), "fixed": (False, True)}


def commit(document: DataFrame, root: str, name: str, family: str, version: str) -> str:
    """Write a document table (id, created_at, updated_at, …) as a version of a name by the rules of its family.

    `canonical` and `fixed` keep the id and the creation date of the version before, by key `id`'s first row; `fixed` also
    drops that version once the new one is pointed at. Repeating an interrupted commit ends in the same state.
    """
    archives, keeps = FAMILIES[family]
    spark, before = document.sparkSession, latest_run(document.sparkSession, root, name)
    if keeps and before is not None and before != version:
        old = read_run(spark, root, name, "document", before).agg(F.min_by("id", "created_at").alias("old_id"), F.min("created_at").alias("old_at"))
        kept = document.crossJoin(F.broadcast(old))  # one row
        document = kept.withColumns({"id": F.coalesce("old_id", "id"), "created_at": F.coalesce("old_at", "created_at")}).select(document.columns)
    at = publish({"document": document}, root, name, version)
    if not archives:
        for run in complete_runs(spark, root, name):
            if run != version:
                _delete(spark, folder(root, name, run))
    return at


def archived(spark: SparkSession, root: str, name: str) -> list[str]:
    """The versions of a name that are not its latest."""
    now = latest_run(spark, root, name)
    return [r for r in complete_runs(spark, root, name) if r != now]


def finish_updates(spark: SparkSession, path: str) -> None:
    """Carry out the swaps that a journal has promised, and drop what an update without a journal has left."""
    base = path.rstrip("/")
    for name in [n for n in _names(spark, base) if n.startswith("_swap-") and not n.endswith(".tmp")]:
        drafts = f"{base}/_new-{name.removeprefix('_swap-')}"
        for line in (_said(spark, f"{base}/{name}") or "").splitlines():
            old, new, final = line.split("\t")
            if new and _exists(spark, f"{drafts}/{new}"):
                _moved(spark, f"{drafts}/{new}", f"{base}/{final}")
            if old:
                _delete(spark, f"{base}/{old}")
        _delete(spark, f"{base}/{name}")
        _delete(spark, drafts)
    for name in [n for n in _names(spark, base) if n.startswith(("_new-", "_swap-"))]:
        _delete(spark, f"{base}/{name}")


def update_records(spark: SparkSession, path: str, condition: Column, changes: dict[str, Column], kind: str = "parquet", schema=None) -> int:
    """Change the records that meet a condition in a folder of files; the number of them. Other files keep their bytes.

    Only files that hold such a record are written anew, each by the task that its name is dealt to, under a hidden
    folder; a journal names old and new files, and from then on the update is carried out, by the next call if this one
    dies. Readers should not read while files are swapped. The list of touched files passes through the driver.
    """
    base = path.rstrip("/")
    finish_updates(spark, base)
    reader = spark.read.format(kind) if schema is None else spark.read.format(kind).schema(schema)
    rows = reader.load(base)
    columns, meets = rows.columns, F.coalesce(condition, F.lit(False))
    rows = rows.withColumn("held_in", F.element_at(F.split(F.expr("_metadata.file_path"), "/"), -1))
    touched = rows.where(meets).groupBy("held_in").agg(F.count("*").alias("n")).collect()
    if not touched:
        return 0
    mark = uuid.uuid4().hex
    files = [f"{base}/{r.held_in}" for r in touched]
    again = spark.read.format(kind).schema(rows.drop("held_in").schema).load(files).withColumn("held_in", F.element_at(F.split(F.expr("_metadata.file_path"), "/"), -1))
    new = [F.when(meets, changes[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in columns]
    again.select("held_in", *new).repartition("held_in").write.partitionBy("held_in").format(kind).save(f"{base}/_new-{mark}")
    lines = [f"{r.held_in}\t\t" for r in touched]
    for k, part in enumerate(n for n in _names(spark, f"{base}/_new-{mark}") if n.startswith("held_in=")):
        lines += [f"\t{part}/{n}\t{mark[:8]}-{k}-{n}" for n in _names(spark, f"{base}/_new-{mark}/{part}") if n.startswith("part-")]
    _written(spark, f"{base}/_swap-{mark}", "\n".join(sorted(lines)))
    finish_updates(spark, base)
    return sum(r.n for r in touched)
