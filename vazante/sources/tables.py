"""Readers: articles from CSV, pair lists, tables with required columns, runs and their registry."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import category_name, valid_date
from ..schemas import RAW_ARTICLES, RAW_COLUMNS, require_columns

#: Spellings of a missing value in CSV files.
MISSING = ("", "#N/A", "#NA", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "<NA>")


def read_articles_csv(spark: SparkSession, path: str) -> DataFrame:
    """Articles of a CSV file with header, quoted fields and line breaks inside quotes.

    ``day`` is null where the date is not a real ``yyyy-MM-dd``; ``category`` is folded. No row is dropped.
    A missing column is an error that names it.
    """
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    head = spark.read.options(**options).csv(path)
    require_columns(head, RAW_COLUMNS)
    order = [c for c in head.columns if c in RAW_COLUMNS]
    raw = head.select(*(F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in order))
    return raw.select(*(RAW_ARTICLES.names)).withColumn("day", valid_date(F.col("date"))).withColumn("category", category_name(F.col("category")))


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    pairs = spark.read.options(header=True).csv(path)
    return require_columns(pairs, ("id_a", "id_b")).select(F.col("id_a").cast("long"), F.col("id_b").cast("long"))


def read_table(spark: SparkSession, path: str, columns: Iterable[str] = ()) -> DataFrame:
    """A Parquet table that has at least ``columns``, pruned to them if any are named."""
    columns = list(columns)
    df = require_columns(spark.read.parquet(path), columns)
    return df.select(*columns) if columns else df


def file_digest(path: str | Path) -> str:
    """SHA-256 of a file, read in blocks."""
    with open(path, "rb") as data:
        return hashlib.file_digest(data, "sha256").hexdigest()


def table_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of the files of a table, hashed on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def check_digest(path: str | Path, register: str | Path) -> bool:
    """Trust on first use: note the digest if none is registered, else say whether it is the same."""
    register, digest = Path(register), file_digest(path)
    if not register.exists():
        register.write_text(digest + "\n", encoding="utf-8")
        return True
    return register.read_text(encoding="utf-8").split()[0] == digest


def find_runs(root: str | Path) -> list[Path]:
    """Run folders in order of name; those that begin with ``_`` and a missing root give none."""
    root = Path(root)
    return sorted(p for p in root.iterdir() if p.is_dir() and not p.name.startswith("_")) if root.is_dir() else []


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_run(spark: SparkSession, folder: str | Path) -> tuple[dict, DataFrame] | None:
    """Metadata and results of a run, or None if one is missing."""
    folder = Path(folder)
    if not (folder / "metadata.json").exists() or not (folder / "results.parquet").exists():
        return None
    return read_json(folder / "metadata.json"), spark.read.parquet(str(folder / "results.parquet"))


def read_best(folder: str | Path, fold: int = 0) -> dict:
    """Hyper-parameters that a primary run chose for a fold; an error if it has none."""
    path = Path(folder) / "hp.json"
    if not path.exists():
        raise FileNotFoundError(f"{path}: run the primary scenario first")
    return read_json(path)[str(fold)]


def read_pairs_if_there(spark: SparkSession, path: str | Path | None) -> DataFrame | None:
    """The near-duplicate pairs of a CSV file, or None if there is no such file."""
    return read_pairs_csv(spark, str(path)) if path and Path(path).exists() else None


def unzip(path: str | Path, folder: str | Path) -> list[Path]:
    """Extract an archive of data files; members that would land outside ``folder`` are an error."""
    folder = Path(folder).resolve()
    with zipfile.ZipFile(path) as archive:
        for name in archive.namelist():
            if not (folder / name).resolve().is_relative_to(folder):
                raise ValueError(f"{name} lies outside the folder")
        archive.extractall(folder)
        return [folder / n for n in archive.namelist() if not n.endswith("/")]


def read_prompt(path: str | Path) -> str:
    return Path(path).read_text(encoding="utf-8")
