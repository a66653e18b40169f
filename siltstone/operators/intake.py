"""Taking sources in: types and folders, repositories among folders, sidecars, summaries, previews, review states, secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import squeeze, strip, truncated

# Source types by extension, and folders of the raw archive by type.
TYPES = {
    "paper": ".pdf", "article": ".md .markdown", "web": ".html .htm", "note": ".txt .rtf", "dataset": ".csv .tsv .json .jsonl .xlsx .xls .parquet",
    "image": ".png .jpg .jpeg .webp .gif .svg .bmp", "repo": ".zip .tar .gz .tgz",
}
FOLDERS = {"paper": "pdfs", "article": "web", "web": "web", "image": "images", "repo": "repos", "dataset": "datasets", "note": "notes", "transcript": "transcripts"}
# Names that mark a repository, and extensions of code.
MARKERS = (
    ".git package.json pnpm-lock.yaml package-lock.json yarn.lock pyproject.toml requirements.txt setup.py cargo.toml go.mod pom.xml build.gradle"
    " build.gradle.kts composer.json gemfile mix.exs"
).split()
CODE = ".c .cpp .cs .go .h .hpp .java .js .jsx .kt .mjs .py .r .rb .rs .scala .sql .swift .ts .tsx".split()
# Keys of a sidecar that change the extraction; the others are frontmatter.
OVERRIDES = ("extracted_text", "extraction_status", "extraction_method", "extraction_notes", "figure_refs", "imported_frontmatter")
# Labels that public web pages trip over without a secret being there.
WEB_SUPPRESSED = ("keyword_secret_value", "bearer_token", "password_literal")


def source_type(path: Column, is_directory: Column | None = None) -> Column:
    """By extension; folders are repositories, and what is unknown is a note."""
    extension = F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))
    out = F.when(is_directory, "repo") if is_directory is not None else F.when(F.lit(False), "")
    for name, extensions in TYPES.items():
        out = out.when(extension.isin(extensions.split()), name)
    return out.otherwise("note")


def raw_folder(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair]), kind), F.lit("notes"))


def repositories(files: DataFrame, depth: int = 2) -> DataFrame:
    """(folder, n_files, n_code, has_readme, is_repo) from (folder, path below it): markers at the top, or code enough.

    A marker counts as two files of code; five, or two beside a readme, make a repository. Deeper files are not counted.
    """
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    rows = files.select("folder", (F.size(F.split("path", "/")) - 1).alias("level"), name.alias("name")).where(F.col("level") <= depth)
    marker, code = F.col("name").isin(*MARKERS), F.regexp_extract("name", r"(\.[^.]+)$", 1).isin(*CODE)
    out = rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.sum(F.when(marker, 2).when(code, 1).otherwise(0)).alias("n_code"), F.max(F.col("name").startswith("readme")).alias("has_readme"), F.max(marker & (F.col("level") == 0)).alias("marked"))
    return out.select("folder", "n_files", "n_code", "has_readme", (F.col("marked") | (F.col("n_code") >= 5) | (F.col("has_readme") & (F.col("n_code") >= 2))).alias("is_repo"))


def with_sidecars(rows: DataFrame, sidecars: DataFrame, key: str = "path") -> DataFrame:
    """Extractions (key, extracted_text, extraction_status, extraction_method) with what their sidecar says instead.

    A text in the sidecar replaces the extracted one and, unless the sidecar says otherwise, its status and method.
    """
    side = sidecars.select(key, *[F.col(c).alias(f"side_{c}") for c in ("extracted_text", "extraction_status", "extraction_method")])
    own = F.nullif(F.trim("side_extracted_text"), F.lit(""))
    kept = lambda c: F.nullif(F.col(f"side_{c}"), F.lit(""))
    joined = rows.join(side, key, "left")
    status = F.coalesce(kept("extraction_status"), F.when(own.isNotNull(), "extracted"), F.col("extraction_status"))
    method = F.coalesce(kept("extraction_method"), F.when(own.isNotNull(), "llm_vision_handoff"), F.col("extraction_method"))
    return joined.withColumns({"extraction_status": status, "extraction_method": method, "extracted_text": F.coalesce(own, F.col("extracted_text"))}).select(rows.columns)


def split_sidecar(sidecar: Column) -> tuple[Column, Column]:
    """A sidecar's map of strings as (frontmatter, changes to the extraction)."""
    changes = lambda k, v: k.isin(*OVERRIDES)
    return F.map_filter(sidecar, lambda k, v: ~changes(k, v)), F.map_filter(sidecar, changes)


def summary(text: Column, size: int = 420) -> Column:
    """The first two paragraphs in one line, cut to `size`; null where there is no text."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n\r?\n"), squeeze), lambda p: p != "")
    return F.nullif(truncated(F.array_join(F.slice(parts, 1, 2), " "), size), F.lit(""))


def dataset_preview(text: Column, rows: int = 6) -> Column:
    """The first rows of delimited text as a table with a rule under its header; other text as it begins."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: x != "")
    head = F.element_at(lines, 1)
    mark = F.when(F.contains(head, F.lit("\t")), "\t").when(F.contains(head, F.lit(",")), ",")
    cells = F.transform(F.slice(lines, 1, rows), lambda x: F.transform(F.split(x, mark), lambda c: F.trim(c)))
    longest = F.array_max(F.transform(cells, F.size))
    width = lambda i: F.greatest(F.lit(3), F.array_max(F.transform(cells, lambda r: F.length(F.coalesce(F.get(r, i), F.lit(""))))))
    widths = F.transform(F.sequence(F.lit(0), longest - 1), width)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x, i: F.rpad(x, F.get(widths, i), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w)), " | "), F.lit(" |"))
    table = F.array_join(F.transform(cells, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r))), "\n")
    plain = truncated(F.array_join(F.slice(lines, 1, 8), "\n"), 800)
    return F.when(F.size(lines) == 0, "").when(mark.isNull(), plain).otherwise(table)


def review_status(value: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(value)), F.lit("")), F.lit("unreviewed"))


def note_status(value: Column) -> Column:
    return F.when(review_status(value) == "unreviewed", "draft").otherwise("reviewed")


def source_url(*places: Column) -> Column:
    """The first of source_url, url, source and origin that says anything."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in places], F.lit(""))


def reviewed_defaults(status: Column, review: Column, document_class: Column, force: bool = False) -> tuple[Column, Column]:
    """(status, review status) of a note read page by page: defaults where it is not reviewed, or only draft or active."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    visual = clean(document_class).isin("chartpack_or_visual", "visual_capture")
    applies = F.lit(force) | clean(review).isin("", "unreviewed") | clean(status).isin("draft", "active")
    return F.when(applies, "reviewed").otherwise(status), F.when(applies, F.when(visual, "visual-and-text-reviewed").otherwise("text_reviewed")).otherwise(review)


def suppressed(label: Column, is_web_page: Column) -> Column:
    """Hits that a public web page brings with it."""
    return is_web_page & label.isin(*WEB_SUPPRESSED)


def merged_hits(*scans: DataFrame) -> DataFrame:
    """(source, label, line, preview) of several scans, each once."""
    out = scans[0]
    for scan in scans[1:]:
        out = out.unionByName(scan)
    return out.select("source", "label", "line", "preview").distinct()


def hit_summary(hits: DataFrame, key: str) -> DataFrame:
    """(key, summary): `label:count` in the labels' order; there are as many labels as patterns."""
    counts = hits.groupBy(key, "label").agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "label", F.col("n").cast("string"))))
    return counts.groupBy(key).agg(F.array_join(parts, ", ").alias("summary"))


def rolled_over(files: DataFrame) -> DataFrame:
    """(slug, path, action) from (path, slug, stamp, is_canonical): the newest of a slug becomes canonical unless one is."""
    has = files.groupBy("slug").agg(F.max("is_canonical").alias("has"))
    newest = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("stamp"), F.desc("path")))
    ranked = files.where("not is_canonical").withColumn("place", newest).join(has, "slug")
    return ranked.select("slug", "path", F.when((F.col("place") == 1) & ~F.col("has"), "canonical").otherwise("archive").alias("action"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key of both tables."""
    rows = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fresh"), F.desc(order)))
    return rows.withColumn("place", place).where("place = 1").drop("place", "fresh")


def exported(files: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Files under an included prefix and no excluded one, without regard to case."""
    under = lambda prefixes: F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.lower("path").startswith(F.lower(p))) if prefixes else F.lit(False)
    return files.where(under(include) & ~under(exclude))


def safe_fields(fields: Column, scalar: int = 4000, title: int = 240) -> Column:
    """Frontmatter as a map of strings, each value clipped, and the title more so."""
    return F.transform_values(fields, lambda k, v: F.when(k == "title", truncated(v, title)).otherwise(truncated(v, scalar)))


def safe_body(body: Column, most: int) -> Column:
    """The body, or an error where it is empty or over `most` characters."""
    size = F.length(F.coalesce(body, F.lit("")))
    return F.when(strip(F.coalesce(body, F.lit(""))) == "", F.raise_error(F.lit("the body is empty"))).when(size > most, F.raise_error(F.concat(F.lit("the body is too long: "), size))).otherwise(body)


def frontmatter(fields: Column) -> Column:
    """A map of strings as frontmatter that reads back as it was: plain where nothing could be taken otherwise, else quoted."""
    odd = lambda v: ~v.rlike(r"^[A-Za-z0-9_./:@ -]+$") | v.contains(": ") | (v != strip(v)) | v.rlike(r"^(?:true|false|null|~|-?\d+(?:\.\d+)?)$")
    quoted = lambda v: F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), F.when(odd(F.coalesce(e["value"], F.lit(""))), quoted(F.coalesce(e["value"], F.lit("")))).otherwise(e["value"])))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def markdown(fields: Column, body: Column) -> Column:
    return F.concat(frontmatter(fields), F.lit("\n"), strip(F.coalesce(body, F.lit(""))), F.lit("\n"))
