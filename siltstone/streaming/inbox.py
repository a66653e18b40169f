"""The ingest loop: files that arrive in a folder are hashed, extracted, scanned, titled, classed and recorded, each once.

A stream of files hands over batches; a batch writes its records, texts and findings into folders of its own, named by the
query and the batch, and reads the ledger without them. So a batch that is run again writes the same, and a new query over an
inbox that is known adds nothing: content is known by its hash and path. Equal content at another path is recorded as a
duplicate of the first one. Files of no bytes are passed over by Spark's reader. Files with sensitive lines are quarantined: recorded with a summary of masked hits, without text.

Batches are bounded by `files_a_batch`; of the ledger only rows that share a hash with the batch take part in its joins.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.text import concept_label, strip
from siltstone.operators import ingest, intake
from siltstone.sources import notes

SIDECAR = ".source.json"
SKIPPED = r"(^|/)(\.git|node_modules)/"
FILES = "path string, modificationTime timestamp, length long, content binary"
RECORD = (
    "id string, path string, checksum string, length long, modified timestamp, source_type string, folder string, title string, document_class string, status string,"
    " duplicate_of string, hits string, review_status string, summary string, method string, n_chars long"
)
TEXT = "id string, path string, text string"
HIT = "path string, line int, label string, preview string"


def humanised(path: Column) -> Column:
    """A title out of a file's name: without its extension, hyphens and underscores as spaces, words capitalised."""
    return F.initcap(strip(F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), "[-_]+", " ")))


def read_into(batch: DataFrame, inbox: str) -> DataFrame:
    """Each target with its extraction and what its sidecar in the same batch says: one row a file, paths below the inbox."""
    base = inbox.rstrip("/") + "/"
    files = batch.select(F.substring_index("path", base, -1).alias("path"), "content", "length", F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(SKIPPED))
    side = files.where(F.col("path").endswith(SIDECAR)).select(F.expr(f"substr(path, 1, length(path) - {len(SIDECAR)})").alias("path"), F.from_json(F.decode("content", "UTF-8"), "map<string,string>").alias("said"))
    front, changes = intake.split_sidecar(F.col("said"))
    side = side.select("path", front.alias("front"), *[F.try_element_at(changes, F.lit(k)).alias(k) for k in ("extracted_text", "extraction_status", "extraction_method")])
    targets = files.where(~F.col("path").endswith(SIDECAR))
    found = notes.extracted(targets.select("path", "content")).select("path", F.col("title").alias("page_title"), F.col("text").alias("extracted_text"), F.col("method").alias("extraction_method"), F.when(strip(F.col("text")) == "", "empty").otherwise("extracted").alias("extraction_status"))
    found = intake.with_sidecars(found, side.drop("front"))
    rows = targets.join(found, "path").join(side.select("path", "front"), "path", "left")
    raw = F.when(F.col("extraction_method") == "markdown", F.decode("content", "UTF-8"))
    own = F.coalesce(notes.front_fields(raw), F.create_map().cast("map<string,string>"))
    fields = F.map_concat(F.map_filter(own, lambda k, v: F.coalesce(F.try_element_at("front", k).isNull(), F.lit(True))), F.coalesce("front", F.create_map().cast("map<string,string>")))
    kind = intake.source_type(F.col("path"))
    return rows.select("path", "length", "modified", F.sha2("content", 256).alias("checksum"), kind.alias("source_type"), fields.alias("fields"), "page_title", F.coalesce("extracted_text", F.lit("")).alias("text"), F.col("extraction_method").alias("method"))


def titles(rows: DataFrame) -> DataFrame:
    """(path, title): the best of the frontmatter's, the first heading, the first line and the file's name."""
    field = lambda k: F.try_element_at("fields", F.lit(k))
    first = F.get(F.filter(F.split("text", r"\r?\n"), lambda x: strip(x) != ""), F.lit(0))
    values = {"frontmatter_title": F.coalesce(field("title"), F.nullif("page_title", F.lit(""))), "frontmatter_name": field("name"), "heading": F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1), F.lit("")), "first_line": first, "filename": humanised(F.col("path"))}
    candidates = rows.select("path", F.explode(F.array(*[F.struct(v.alias("value"), F.lit(k).alias("label")) for k, v in values.items()])).alias("c"), humanised(F.col("path")).alias("filename"))
    return ingest.best_titles(candidates.select("path", "c.value", "c.label", "filename").where("value is not null"), "path").select("path", "title")


def findings(rows: DataFrame) -> DataFrame:
    """Sensitive lines (path, line, label, preview), without what public web pages bring along."""
    hits = ingest.sensitive_hits(rows.select("path", "text"), "path", "text").join(rows.select("path", "source_type"), "path")
    return hits.where(~intake.suppressed(F.col("label"), F.col("source_type") == "web")).select("path", "line", "label", "preview")


def records(rows: DataFrame, hits: DataFrame, known: DataFrame, allow_sensitive: bool = False) -> DataFrame:
    """The ledger's rows for new files (as `read_into` gives them), given the ledger's rows of the same hashes."""
    told = rows.join(titles(rows), "path", "left").join(intake.hit_summary(hits.withColumnRenamed("path", "of"), "of"), F.col("path") == F.col("of"), "left").drop("of")
    title = F.coalesce("title", humanised(F.col("path")))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    kept = F.lit(allow_sensitive) | F.col("summary").isNull()
    out = told.select(
        F.concat(F.lit("SRC-"), F.upper(F.substring("checksum", 1, 12))).alias("id"), "path", "checksum", "length", "modified", "source_type", intake.raw_folder(F.col("source_type")).alias("folder"), title.alias("title"),
        ingest.document_class(F.col("source_type"), F.concat_ws(" ", title, "path", concept_label(F.substring("text", 1, 4000))), field("document_class")).alias("document_class"), kept.alias("kept"), F.col("summary").alias("hits"),
        F.when(F.col("summary").isNotNull(), "unreviewed").otherwise(intake.review_status(field("review_status"))).alias("review_status"), intake.summary(F.col("text")).alias("summary"), "method", F.length("text").cast("long").alias("n_chars"),
    )
    before = known.where("status = 'ingested'").groupBy("checksum").agg(F.min("path").alias("seen_at"))
    first = F.min(F.when(F.col("kept"), F.col("path"))).over(Window.partitionBy("checksum"))
    out = out.withColumn("first", first).join(before, "checksum", "left")
    origin = F.coalesce("seen_at", "first")
    status = F.when(~F.col("kept"), "quarantined").when(origin != F.col("path"), "duplicate").otherwise("ingested")
    out = out.withColumns({"status": status, "duplicate_of": F.when(F.col("kept") & (origin != F.col("path")), origin), "summary": F.when(F.col("kept"), F.col("summary"))})
    return out.select(*[f.split()[0] for f in RECORD.split(", ")])


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """All records so far; none where nothing was taken in."""
    return _kept(spark, store, "ledger", RECORD)


def _kept(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{table}")
    empty = spark.createDataFrame([], f"{schema}, query string, batch long")
    return spark.read.schema(empty.schema).parquet(f"{store}/{table}") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else empty


def take_in(batch: DataFrame, query: str, number: int, inbox: str, store: str, allow_sensitive: bool = False) -> None:
    """One batch of files; running it again changes nothing."""
    spark = batch.sparkSession
    held = read_into(batch, inbox).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        others = ledger(spark, store).where(~((F.col("query") == query) & (F.col("batch") == number)))
        known = others.join(held.select("checksum").distinct(), "checksum", "left_semi").select("checksum", "path", "status").persist()
        rows = held.join(known.select("checksum", "path"), ["checksum", "path"], "left_anti")
        hits = findings(rows).persist()
        made = records(rows, hits, known, allow_sensitive).persist()
        texts = made.where("status = 'ingested'").select("id", "path").join(rows.select("path", "text"), "path").select("id", "path", "text")
        # the ledger last: a text is there before its record is
        for table, frame in (("texts", texts), ("hits", hits), ("ledger", made)):
            frame.write.mode("overwrite").parquet(f"{store}/{table}/query={query}/batch={number}")
        for frame in (made, hits, known):
            frame.unpersist()
    finally:
        held.unpersist()


def ingest_stream(spark: SparkSession, inbox: str, store: str, checkpoint: str, files_a_batch: int = 1000, allow_sensitive: bool = False) -> StreamingQuery:
    """Start taking in the files of a folder, those that are there and, with another trigger, those to come."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(inbox)

    def each(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        take_in(batch, query, number, inbox, store, allow_sensitive)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
