"""Writers: tables, predictions with a column a class, run folders, metadata and reports."""

from __future__ import annotations

import csv
import json
import logging
import platform
import re
import subprocess
from datetime import datetime, timezone
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with header, replacing what is there."""
    df.coalesce(1).write.mode("overwrite").options(header=True, encoding="UTF-8").csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def score_columns(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """The map ``scores`` as one column ``score_<class>`` a class."""
    others = [c for c in predictions.columns if c != "scores"]
    return predictions.select(*others, *(F.try_element_at("scores", F.lit(c)).alias(f"score_{c}") for c in classes))


def write_predictions(predictions: DataFrame, classes: list[str], path: str) -> None:
    score_columns(predictions, classes).write.mode("errorifexists").parquet(path)


def write_json(path: str | Path, data: object) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def write_rows_csv(rows: list[dict], path: str | Path) -> None:
    """A few rows held by the driver as one CSV file; nested values as JSON, accents kept."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    names = list(dict.fromkeys(k for r in rows for k in r))
    with path.open("w", encoding="utf-8", newline="") as out:
        writer = csv.DictWriter(out, names)
        writer.writeheader()
        for row in rows:
            writer.writerow({k: json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else v for k, v in row.items()})


BLOCKS = ("statistical", "semantic", "change_points", "embeddings")
SCOPES = ("global", "mercado", "nao_mercado")
GRANULARITIES = ("mensal", "bisemanal", "diario")


def drift_folder(root: str | Path, block: str, scope: str, granularity: str | None = None, when: datetime | None = None) -> Path:
    """The folder of a drift run: ``embeddings/<scope>`` is one folder that is used again, all other blocks get a new
    one a run. Unknown blocks, scopes and granularities, and a missing granularity, are errors."""
    if block not in BLOCKS:
        raise ValueError(f"unknown block: {block}; known: {BLOCKS}")
    if block == "embeddings":
        path = Path(root) / block / scope
        path.mkdir(parents=True, exist_ok=True)
        return path
    granularity = granularity or ("diario" if block == "change_points" else None)
    if scope not in SCOPES or granularity not in GRANULARITIES:
        raise ValueError(f"scope one of {SCOPES} and granularity one of {GRANULARITIES} are needed")
    return run_folder(Path(root) / block, granularity, scope, when=when)


def run_folder(root: str | Path, *parts: str, when: datetime | None = None) -> Path:
    """A new folder ``<time>-<parts>`` below ``root``; a number is added rather than reuse one."""
    slug = "-".join(re.sub(r"[^a-z0-9_]+", "-", p.lower()).strip("-") for p in parts)
    name = f"{(when or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%SZ')}-{slug}"
    path, k = Path(root) / name, 2
    while path.exists():
        path, k = Path(root) / f"{name}-v{k}", k + 1
    path.mkdir(parents=True)
    return path


def metadata(seed: int, hashes: dict[str, str] | None = None, started: datetime | None = None, **extra: object) -> dict:
    """Where a result comes from: commit, versions, seed, input hashes, duration."""

    def known(name: str) -> str | None:
        try:
            return version(name)
        except PackageNotFoundError:
            return None

    done = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, cwd=Path(__file__).parent)
    now = datetime.now(timezone.utc)
    return {
        "git_commit": done.stdout.strip() or None, "seed": seed, "hashes": hashes or {}, "python": platform.python_version(),
        "versoes": {p: known(p) for p in ("pyspark", "pandas", "numpy", "pyarrow")}, "criado_em": now.isoformat(),
        "duracao_s": (now - started).total_seconds() if started else None, "extras": extra,
    }


def markdown(rows: list[dict], group_by: tuple[str, ...] = ("escopo", "granularidade")) -> str:
    """Rows as one table a group, numbers with three decimals; no rows give a placeholder."""
    if not rows:
        return "_(nenhum dado)_\n"
    out = []
    for key in sorted({tuple(r[g] for g in group_by) for r in rows}):
        members = [r for r in rows if tuple(r[g] for g in group_by) == key]
        columns = [c for c in members[0] if c not in group_by]
        out += ["### " + " / ".join(map(str, key)), "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        out += ["| " + " | ".join(f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |" for r in members]
        out.append("")
    return "\n".join(out) + "\n"


def run_logger(folder: str | Path, name: str = "vazante") -> logging.Logger:
    """A logger to the folder's ``run.log`` and the screen, in place of earlier handlers."""
    log = logging.getLogger(name)
    for handler in list(log.handlers):
        log.removeHandler(handler)
        handler.close()
    for handler in (logging.FileHandler(Path(folder) / "run.log", encoding="utf-8"), logging.StreamHandler()):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.INFO)
    return log


def window_summary(windowed: DataFrame) -> DataFrame:
    """Rows, first and last day of each window or fold."""
    keys = [c for c in ("janela_idx", "rotulo", "fold", "papel") if c in windowed.columns]
    return windowed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("day").alias("primeiro"), F.max("day").alias("ultimo"))
