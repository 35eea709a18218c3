"""Markdown notes as tables: listing, loading, stable scans, reading parts."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.lazy import pandas_udf


def place(folder: str) -> str:
    """A folder's name, the same however it is written: a local one with links followed, any other without its last slash."""
    local = folder.removeprefix("file://")
    return folder.rstrip("/") if "://" in local else os.path.realpath(local)


def note_files(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """``source, raw, size, modified`` of the ``*.md`` files right in a folder, by name.

    With ``source`` only the file of that name is listed and opened.

    The suffix is matched as written; subfolders aren't entered. Spark's readers
    leave out files without bytes, so those are listed by the file system. Links
    that lead out of the folder are left out.
    """
    wanted = "*.md" if source is None else re.sub(r"([\\*?\[\]{}^,])", r"\\\1", source)
    files = spark.read.format("binaryFile").option("pathGlobFilter", wanted).option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.where(~name.isin(_strangers(spark, folder)))
    read = files.select(name.alias("source"), F.col("content").alias("raw"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if source is not None:
        read = read.where(F.lit(source.endswith(".md")) & (F.col("source") == source))
    empty = spark.createDataFrame([r for r in _empty_files(spark, folder) if source in (None, r[0])], "source string, raw binary, size long, modified long")
    return read.unionByName(empty.withColumn("modified", F.timestamp_millis("modified")))


def _listed(spark: SparkSession, folder: str):
    """The folder's file system, and its notes by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    named = ((f.getPath().getName(), f) for f in system.listStatus(path) if f.isFile())
    return system, [(name, f) for name, f in named if name.endswith(".md")]


def _empty_files(spark: SparkSession, folder: str) -> list[tuple]:
    away = set(_strangers(spark, folder))
    return [(name, b"", 0, f.getModificationTime()) for name, f in _listed(spark, folder)[1] if f.getLen() == 0 and name not in away]


def _strangers(spark: SparkSession, folder: str) -> list[str]:
    """Names of links on a local disk that lead out of the folder; other stores have none."""
    system, found = _listed(spark, folder)
    if system.getScheme() != "file":
        return []
    real = lambda path: spark._jvm.java.io.File(path.toUri().getPath()).getCanonicalPath()
    root = real(system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(folder)))
    return [name for name, f in found if not real(f.getPath()).startswith(f"{root}/")]


@pandas_udf("struct<title:string, content:string>")
def parsed_note(source: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """Title and body: the first ``# `` line is the title and leaves the body, else the file's stem.

    Bytes must be UTF-8; a broken file fails the read rather than losing text.
    """
    rows = []
    for name, data in zip(source, raw, strict=True):
        lines = bytes(data).decode("utf-8").splitlines()
        at = next((i for i, x in enumerate(lines) if x.startswith("# ")), None)
        title = name.removesuffix(".md") if at is None else lines.pop(at)[2:].strip()
        rows.append((title, "\n".join(lines).strip()))
    return pd.DataFrame(rows, columns=["title", "content"])


def load_notes(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """``source, title, content`` of every note, or of the one named; each action reads the files anew."""
    own = note_files(spark, folder, source).select("source", parsed_note("source", "raw").alias("n"))
    return own.select("source", "n.title", "n.content")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    return note_files(spark, folder).select("source", "size", "modified")


def stable_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of a scan during which no file changed; else it raises.

    The notes are kept in memory or on disk, so later actions see that scan.
    """
    before = inventory(spark, folder).collect()
    notes = load_notes(spark, folder).persist()
    notes.count()
    if sorted(before) != sorted(inventory(spark, folder).collect()):
        notes.unpersist()
        raise RuntimeError("notes changed during the scan")
    return notes


class ReadError(ValueError):
    """No such document, or a range or section that isn't in it. ``code`` says which."""

    def __init__(self, code: str, text: str):
        super().__init__(text)
        self.code = code


def read_part(notes: DataFrame, source: str | None = None, doc_id: str | None = None, start: int | None = None, end: int | None = None, sections: DataFrame | None = None, section_id: str | None = None) -> dict:
    """One note whole, a range of its characters, or one section.

    ``notes``: ``source, doc_id, title, content``; ``sections``: chunks with
    ``source, section_id, section_start, section_end, heading_path``.
    """
    if source is None and doc_id is None:
        raise ReadError("bad_request", "a source or a document id is needed")
    if section_id is not None and (start is not None or end is not None):
        raise ReadError("bad_request", "give a section or a range, not both")
    rows = notes
    for column, value in (("source", source), ("doc_id", doc_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    found = rows.select("source", "title", "content").limit(2).collect()
    if len(found) != 1:
        raise ReadError("not_found", "no such document")
    note, path = found[0], []
    if section_id is not None:
        own = sections.where((F.col("source") == note["source"]) & (F.col("section_id") == section_id)).select("section_start", "section_end", "heading_path").limit(1).collect()
        if not own:
            raise ReadError("unknown_section", "no such section")
        start, end, path = own[0]["section_start"], own[0]["section_end"], own[0]["heading_path"]
    size = len(note["content"])
    start, end = 0 if start is None else start, size if end is None else end
    if not 0 <= start <= end <= size:
        raise ReadError("bad_range", f"the range must lie in 0..{size}")
    return {"source": note["source"], "title": note["title"], "content": note["content"][start:end], "start_char": start, "end_char": end, "section_id": section_id, "heading_path": list(path)}


def note_of(title, text):
    """Title (lines joined) and body (stripped) of a document from elsewhere, under an opaque name."""
    name = F.concat(F.sha2(F.concat_ws("\n", title, text), 256), F.lit(".md"))
    return name.alias("source"), F.trim(F.regexp_replace(title, r"\s*[\r\n]+\s*", " ")).alias("title"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("content")
