"""Notes, documents and structured files as DataFrames."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import figure_refs, html_title, plain_html, plain_markdown, strip
from siltstone.sources.pdf import pdf_strings, pdf_text  # noqa: F401


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, length, modificationTime) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, raw): whole files as UTF-8 without their byte-order mark; path is relative to the root."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = root.rstrip("/") + "/"
    return read.select(F.expr("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("raw")).select(F.substring_index(F.col("file"), base, -1).alias("path"), "raw")


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object a line; blank lines are left out and a broken one raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON file, or no rows where the path does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def front_block(raw: Column) -> Column:
    return F.regexp_extract(raw, r"\A---[ \t]*\r?\n(?s:(.*?))\r?\n---[ \t]*(?:\r?\n|\z)", 1)


def body_of(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\A---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|\z)", "")


def unquoted(value: Column) -> Column:
    return F.regexp_replace(strip(value), r"""^(["'])(.*)\1$""", "$2")


def front_fields(raw: Column) -> Column:
    """A map of the scalar fields of a note's front block; the last of a repeated key holds."""
    lines = F.filter(F.split(front_block(raw), r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:\s*\S"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_-]+):", 1).alias("key"), unquoted(F.regexp_extract(x, r"^[A-Za-z0-9_-]+:\s*(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def front_list(raw: Column, key: str) -> Column:
    """A list field: `- item` lines, a [JSON, like, list], or values parted by commas or semicolons."""
    block = F.concat(F.lit("\n"), front_block(raw), F.lit("\n"))
    items = F.regexp_extract_all(F.regexp_extract(block, rf"\n{re.escape(key)}:[ \t]*\n((?:[ \t]*-[^\n]*\n)+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]*(.+?)[ \t]*$"), F.lit(1))
    inline = F.regexp_replace(F.regexp_extract(block, rf"\n{re.escape(key)}:[ \t]*(\S[^\n]*)\n", 1), r"^\[|\]\s*$", "")
    cut = F.filter(F.transform(F.split(inline, "[;,]"), unquoted), lambda x: x != "")
    return F.when(F.size(items) > 0, F.transform(items, unquoted)).otherwise(cut)


def notes(texts_: DataFrame) -> DataFrame:
    """(path, title, fields, tags, concepts, entities, body, raw) of Markdown notes."""
    raw = F.col("raw")
    out = texts_.select("path", front_fields(raw).alias("fields"), *[front_list(raw, k).alias(k) for k in ("tags", "concepts", "entities")], body_of(raw).alias("body"), "raw")
    stem = F.initcap(F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), "[-_]+", " "))
    title = F.coalesce(F.try_element_at("fields", F.lit("title")), F.nullif(strip(F.regexp_extract("body", r"(?m)^#\s+(.+)$", 1)), F.lit("")), stem)
    return out.withColumn("title", title)


def search_documents(notes_: DataFrame) -> DataFrame:
    """Notes as the columns that retrieval reads; templates, watch profiles and retired notes are left out."""
    field = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    kept = ~F.lower(field("status")).isin("inactive", "obsolete", "retired", "superseded") & ~F.col("path").rlike("^wiki/(_templates|watch-profiles)/")
    block = F.concat_ws(" ", "concepts", "entities", "tags", field("document_class"), field("kind"))
    return notes_.where(kept).select("path", "title", plain_markdown(F.col("body")).alias("content"), block.alias("metadata"), "raw", *[field(k).alias(k) for k in ("status", "review_status", "review_method", "document_class", "capture_source")])


def extracted(files_: DataFrame) -> DataFrame:
    """(path, title, text, figures, method) by the kind of file: HTML, Markdown, plain text, SVG, and PDF streams."""
    text = F.decode("content", "UTF-8")
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    route = F.when(kind.isin("html", "htm"), "html").when(kind.isin("md", "markdown"), "markdown").when(kind == "svg", "svg").when(kind == "pdf", "pdf").otherwise("text")
    base = files_.select("path", "content", route.alias("method"))
    no_figures = F.array().cast("array<struct<source:string,alt:string>>")
    svg = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)(<(?:text|tspan|title|desc)[^>]*>[^<]*)"), F.lit(1)), plain_html), " ")
    plain = base.where("method <> 'pdf'").select(
        "path",
        F.when(F.col("method") == "html", html_title(text)).alias("title"),
        F.when(F.col("method") == "html", plain_html(text)).when(F.col("method") == "markdown", plain_markdown(body_of(text))).when(F.col("method") == "svg", svg).otherwise(text).alias("text"),
        F.when(F.col("method").isin("html", "markdown"), figure_refs(text)).otherwise(no_figures).alias("figures"),
        "method",
    )
    pdf = pdf_text(base.where("method = 'pdf'")).select("path", F.lit(None).cast("string").alias("title"), "text", no_figures.alias("figures"), F.lit("pdf").alias("method"))
    return plain.unionByName(pdf)


def is_unreadable(text: Column) -> Column:
    """Text that came out of a page as noise: nearly empty, odd characters, letters spaced apart, or few letters."""
    n = F.length(strip(text))
    share = lambda p: F.regexp_count(text, F.lit(p)) / F.greatest(n, F.lit(1))
    return (n < 40) | (share(r"[^\x09\x0A\x0D\x20-\x7E -ɏ‐-•€™]") > 0.15) | (F.regexp_count(text, F.lit(r"(?:\b[A-Za-z]\s){4,}")) > 5) | (share("[A-Za-z]") < 0.3)


def archive_entries(files_: DataFrame) -> DataFrame:
    """(archive, path, size, head): the members of tar archives, with up to 1800 characters of key files."""
    key = re.compile(r"(^|/)(readme[^/]*|package\.json|pyproject\.toml|cargo\.toml|go\.mod|makefile)$", re.IGNORECASE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as tar:
                    for m in tar:
                        if m.isfile():
                            head = tar.extractfile(m).read(7200).decode("utf-8", "replace")[:1800] if key.search(m.name) else None
                            rows.append((path, m.name, m.size, head))
                yield pd.DataFrame(rows, columns=["archive", "path", "size", "head"])

    return files_.select("path", "content").mapInPandas(run, "archive string, path string, size long, head string")


def histogram(entries: DataFrame, group: str, value: Column, n: int = 12) -> DataFrame:
    """The n commonest values of each group, for folders and extensions of a repository."""
    from pyspark.sql import Window

    counts = entries.groupBy(group, value.alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "value"))).where(F.col("place") <= n)


def upsert_block(note: Column, block: Column, marker: str) -> Column:
    """The note with the text between two markers replaced, or with the block at its end."""
    start, end = f"<!-- {marker}:start -->", f"<!-- {marker}:end -->"
    made = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    head, tail = F.substring_index(note, start, 1), F.substring_index(note, end, -1)
    return F.when(note.contains(start) & note.contains(end), F.concat(head, made, tail)).otherwise(F.concat(F.regexp_replace(note, r"\s+$", ""), F.lit("\n\n"), made, F.lit("\n")))


def write_version(df: DataFrame, path: str, family: str) -> None:
    """Sinks by family: `append` keeps every row, `rolling` replaces the table, `timestamped` adds a version."""
    if family == "append":
        df.write.mode("append").json(path)
    elif family == "rolling":
        df.write.mode("overwrite").json(path)
    else:
        df.withColumn("version", F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")).write.partitionBy("version").mode("append").json(path)
