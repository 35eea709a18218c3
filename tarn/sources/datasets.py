"""Datasets: strict JSONL, Parquet and TSV imports, saving with checksums, frozen copies."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.functions.lazy import pandas_udf
from tarn.sources.files import Files


def _pairs(items):
    found = dict(items)
    if len(found) != len(items):
        raise ValueError("a key occurs twice")
    return found


def _constant(name):
    raise ValueError(f"{name} is not JSON")


@pandas_udf("struct<json:string, error:string>")
def strict_json(lines: pd.Series) -> pd.DataFrame:
    """Canonical JSON of each line, or what is wrong with it (repeated keys and NaN included)."""
    rows = []
    for line in lines:
        try:
            value = json.loads(line, object_pairs_hook=_pairs, parse_constant=_constant)
            if not isinstance(value, dict):
                raise ValueError("not an object")
            rows.append((json.dumps(value, ensure_ascii=False, sort_keys=True), None))
        except ValueError as error:
            rows.append((None, str(error)))
    return pd.DataFrame(rows, columns=["json", "error"])


def _line_number(spark: SparkSession, path: str, file: str, value: str) -> int:
    """Number of the first line of a file that reads so; the file is scanned once more, for the error's sake."""
    whole = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_path") == file)
    lines = whole.select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "line"))
    return lines.where(F.col("line") == value).agg(F.min("n")).first()[0] + 1


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; blank lines are skipped, any broken one raises with its file, number and text."""
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = read.where(F.trim("value") != "").select("value", "file", strict_json("value").alias("p"))
    bad = lines.where("p.error IS NOT NULL").select("value", "file", "p.error").limit(1).collect()
    if bad:
        number = _line_number(spark, path, bad[0]["file"], bad[0]["value"])
        raise ValueError(f"{bad[0]['file']}:{number}: {bad[0]['error']}: {bad[0]['value'][:200]}")
    return lines.select(F.from_json("p.json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST", quote="")


def read_parquet(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """A Parquet table with its identifiers as text."""
    return spark.read.parquet(path).withColumns({c: F.col(c).cast("string") for c in ids})


def unzip(archive: str, target: str, sha256: str | None = None) -> list[str]:
    """Unpacks an archive whose checksum holds; members that would leave the folder raise."""
    import zipfile

    if sha256 is not None and checksum(Path(archive)) != sha256:
        raise ValueError("the archive's checksum differs")
    root = Path(target).resolve()
    with zipfile.ZipFile(archive) as packed:
        for name in packed.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"member outside the folder: {name}")
        packed.extractall(root)
        return sorted(packed.namelist())


def checksum(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as file:
        while block := file.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def checksums(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of each Parquet file below a folder, taken where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").rpartition(":")[2].lstrip("/") + "/"
    name = F.substring_index(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), root, -1)
    return {r["name"]: r["sha"] for r in files.select(name.alias("name"), F.sha2("content", 256).alias("sha")).collect()}


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes tables to a new folder of any store, with a manifest of each file's checksum.

    Labels live in tables of their own beside the corpus. A folder that exists
    is never written over.
    """
    spark = next(iter(tables.values())).sparkSession
    files = Files(spark, folder)
    if files.exists(""):
        raise FileExistsError(folder)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(files.path(name))
    manifest = {"tables": sorted(tables), "files": checksums(spark, folder)}
    files.create("manifest.json", json.dumps(manifest, indent=1, sort_keys=True).encode())


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a saved dataset; a file that was changed, lost or added raises."""
    manifest = json.loads(Files(spark, folder).read("manifest.json"))
    try:
        found = checksums(spark, folder)
    except Exception as error:  # a store may find out by itself that a file was changed
        raise ValueError("a file can't be read as it was written") from error
    if found != manifest["files"]:
        raise ValueError("files differ from the manifest")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["tables"]}


def import_dataset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str) -> DataFrame:
    """Saves an external collection under text identifiers; returns the problems that kept it from being saved.

    ``corpus``: ``doc_id, title, text``; ``queries``: ``query_id, text``; ``qrels``:
    ``query_id, doc_id, grade``. ``problem, key``: identifiers that occur twice, judgments
    of what isn't there, grades that aren't whole numbers from 0 on.
    """
    text = lambda df, *ids: df.withColumns({c: F.col(c).cast("string") for c in ids})
    corpus, queries, qrels = text(corpus, "doc_id"), text(queries, "query_id"), text(qrels, "query_id", "doc_id")
    row = lambda df, p, key: df.select(F.lit(p).alias("problem"), F.col(key).alias("key"))
    problems = (
        row(corpus.groupBy("doc_id").count().where("count > 1"), "document_twice", "doc_id")
        .unionByName(row(queries.groupBy("query_id").count().where("count > 1"), "query_twice", "query_id"))
        .unionByName(row(qrels.join(queries, "query_id", "left_anti"), "unknown_query", "query_id"))
        .unionByName(row(qrels.join(corpus, "doc_id", "left_anti"), "unknown_document", "doc_id"))
        .unionByName(row(qrels.where("grade IS NULL OR grade < 0 OR grade <> floor(grade)"), "bad_grade", "query_id"))
    ).distinct()
    if not problems.limit(1).count():
        save({"corpus": corpus, "queries": queries, "qrels": qrels}, folder)
    return problems


def paired_questions(rows: DataFrame) -> DataFrame:
    """``question_id, hops, answerable, unanswerable``: pairs of variants of one multi-hop question.

    ``rows``: ``id`` (``<n>hop…__<question>``), ``answerable``. A question without
    exactly one variant of each kind is left out.
    """
    own = rows.select(F.col("id"), "answerable", F.regexp_extract("id", r"^(\d)hop", 1).cast("int").alias("hops"), F.substring_index("id", "__", -1).alias("question_id"))
    kinds = own.groupBy("question_id", "hops").agg(
        F.count_if("answerable").alias("_a"), F.count_if(~F.col("answerable")).alias("_u"),
        F.max(F.when(F.col("answerable"), F.col("id"))).alias("answerable"), F.max(F.when(~F.col("answerable"), F.col("id"))).alias("unanswerable"),
    )
    return kinds.where("_a = 1 AND _u = 1").drop("_a", "_u")


def frozen(queries: DataFrame, splits: DataFrame, id_col: str = "query_id") -> DataFrame:
    """The queries with nothing but ``split`` rewritten; every query needs one."""
    columns = queries.columns
    out = queries.drop("split").join(splits.select(id_col, "split"), id_col, "left")
    if out.where("split IS NULL").limit(1).count():
        raise ValueError("a query has no split")
    return out.select(*columns) if "split" in columns else out


def write_report(df: DataFrame, path: str, kind: str) -> None:
    """A small report as JSON, JSONL or Markdown, in a new file of any store that appears whole."""
    folder, _, name = path.rpartition("/")
    put_report(Files(df.sparkSession, folder or "."), name, df.columns, [r.asDict(recursive=True) for r in df.collect()], kind)


def put_report(files: Files, name: str, columns: list[str], rows: list[dict], kind: str) -> None:
    if kind == "jsonl":
        text = "".join(json.dumps(r, ensure_ascii=False, sort_keys=True, default=str) + "\n" for r in rows)
    elif kind == "json":
        text = json.dumps(rows, ensure_ascii=False, indent=1, sort_keys=True, default=str)
    elif kind == "markdown":
        text = markdown(columns, [[r[c] for c in columns] for r in rows])
    else:
        raise ValueError(f"unknown kind: {kind}")
    if files.exists(name):
        raise FileExistsError(files.path(name))
    files.replace(name, text.encode("utf-8"))


def markdown(columns: list[str], rows: list[list]) -> str:
    """A table; undefined values are shown as such, pipes escaped."""
    cell = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def provenance(spark: SparkSession) -> dict:
    """Versions that results depend on."""
    import platform

    import numpy
    import pyarrow

    return {"python": platform.python_version(), "machine": platform.machine(), "spark": spark.version, "pyarrow": pyarrow.__version__, "numpy": numpy.__version__, "pandas": pd.__version__, "time_zone": spark.conf.get("spark.sql.session.timeZone")}


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The table if its columns and types are those agreed on; else it raises."""
    have = {(f.name, f.dataType.simpleString()) for f in df.schema.fields}
    want = {(f.name, f.dataType.simpleString()) for f in schema.fields}
    if have != want:
        raise ValueError(f"columns differ: {sorted(have ^ want)}")
    return df
