"""Incremental secret scanning over a content-addressed ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned once per rule version: pairs
already in the ledger are left out by an anti-join before any text moves, copies share one scan, and findings join back
to every path by the blob's address. Only addresses and findings take part in those joins; text moves once, to bring
each unseen blob to its scan, and not even then where the unseen set is small enough for Spark to broadcast.

Defined results. Null text: an empty text, without findings. Null path: scanned like any other. Repeated rows: one scan,
and the findings on each row. Empty tables: empty results. Very long texts are scanned whole. Input columns beside the
key and the text are not read by `ledger_scan`; `redact` keeps them all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, pieces

#: Kinds in the order that breaks ties between spans with one start; the first three are the base rules.
KINDS = ("assign", "access", "hex", "pem", "jwt", "forge")
RULE_VERSION = "2"

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
_FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")

LEDGER = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Three runs joined by dots, the first two opened by eyJ, with 8 characters each beside that; in one pass."""
    for m in _DOTTED.finditer(text):
        runs = m[0].split(".")
        ends = [m.start()]
        for run in runs:
            ends.append(ends[-1] + len(run) + 1)
        i = 0
        while i + 2 < len(runs):
            at = runs[i].find("eyJ")
            if 0 <= at <= len(runs[i]) - 11 and runs[i + 1].startswith("eyJ") and len(runs[i + 1]) >= 11 and len(runs[i + 2]) >= 8:
                yield ends[i] + at, ends[i + 3] - 1
                i += 3
            else:
                i += 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, sorted. Matches under a rule's least length are dropped."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for kind, anchor, rule in ((3, "-----BEGIN ", _PEM), (5, "gh", _FORGE)):
        if anchor in text:
            out += [(m.start(), kind, m.end()) for m in rule.finditer(text)]
    if "eyJ" in text:
        out += [(start, 4, end) for start, end in web_tokens(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def finding(text: str) -> tuple[int, int, int, str, str]:
    spans = find(text)
    base = [s for s in spans if s[1] < 3]
    counts = [sum(s[1] == k for s in base) for k in range(3)]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def addressed(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(path, blob, text): each version with its content address."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{path}`").alias("path"), F.unhex(F.sha2(whole, 256)).alias("blob"), whole.alias("text"))


def scan_unseen(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: one per blob and the current rule version, for the pairs that `ledger` lacks."""
    versions = addressed(docs, path, text)
    unseen = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob")
        unseen = unseen.join(seen, "blob", "left_anti")
    chosen = unseen.select(F.col("blob").alias("of"), F.col("path").alias("at"))
    texts = versions.join(chosen, (F.col("blob") == F.col("of")) & F.col("path").eqNullSafe(F.col("at"))).select("blob", "text")
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = [(RULE_VERSION, *finding(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return texts.mapInArrow(run, LEDGER).dropDuplicates(["blob"])


def ledger_scan(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger rows to append). Paths whose blob the ledger knows take its findings."""
    fresh = checkpointed(scan_unseen(docs, path, text, ledger))
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select(*fresh.columns))
    paths = addressed(docs, path, text).select("path", "blob")
    found = paths.join(known.drop("rule_version"), "blob", "left")
    return found.select(F.col("path").alias(path), "n_assign", "n_access", "n_hex", "base_sha256", "spans"), fresh


#: Holds for every text that a rule can match; texts without it pass `redact` untouched and unmoved.
_POSSIBLE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|-----BEGIN |eyJ|gh[pousr]_"""
MARK = "[REDACTED]"


def cut_out(text: str, spans: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by the mark."""
    parts, at = [], 0
    for start, end in [tuple(map(int, s.split(":")[1:])) for s in spans.split(",")]:
        if start >= at:
            parts += [text[at:start], MARK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """All rows and columns of `docs` with the findings cut out of the text; `n_chars`, where it is a column, follows.

    Null text stays null. Columns may have any names. Repeated rows: each is cut. Empty table: empty result.
    """
    body = lambda c: F.coalesce(c, F.lit(""))
    possible = body(F.col(f"`{text}`")).rlike(_POSSIBLE)
    risky = docs.where(possible)
    _, fresh = ledger_scan(risky, path, text, ledger)
    known = fresh if ledger is None else fresh.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select(*fresh.columns))
    hits = known.where("spans <> ''").select("blob", "spans")
    rows = risky.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("whole"))
    joined = rows.join(hits, F.unhex(F.sha2(body(F.col("whole")), 256)) == F.col("blob"), "left").select("row", "whole", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "whole"):
            texts = [cut_out(t, s) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "whole"])

    done = joined.mapInArrow(run, joined.select("row", "whole").schema)
    size = F.when(F.col("whole").isNotNull(), F.length("whole"))
    new = {text: F.col("whole")} | ({"n_chars": size.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return docs.where(~possible).unionByName(done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]))
