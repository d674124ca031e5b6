"""Small JSON documents on the driver: results, manifests, logs of runs. Rows stay in Spark; only reports of checked size come here."""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded_rows


def json_safe(value):
    """A value as plain JSON types; a number that is not finite raises, as JSON has none."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if hasattr(value, "asDict"):
        return json_safe(value.asDict(recursive=True))
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{value} cannot be written as JSON")
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_document(path: str | Path, value) -> None:
    """Indented JSON, non-ASCII kept; whole or not at all: written beside and renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(json_safe(value), indent=2, ensure_ascii=False)
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    os.replace(name, path)


def read_document(path: str | Path):
    """A JSON document, or None where there is none or it cannot be read."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def cached_result(path: str | Path, request: dict, compute: Callable[[], dict]) -> dict:
    """The result stored for exactly this request, else computed and stored; any difference in the request computes anew."""
    stored, request = read_document(path), json_safe(request)
    if isinstance(stored, dict) and stored.get("request") == request and "result" in stored:
        return stored["result"]
    result = json_safe(compute())
    write_document(path, {"request": request, "result": result})
    return result


#: The fields of a trainer's log entries.
RUN_LOG = "step long, `rewards/accuracies` double, `rewards/margins` double, train_runtime double"


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, step, accuracy, margin, runtime): entries of the trainers' logs <run>/log_history.json below a folder."""
    raw = spark.read.schema(RUN_LOG).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "log_history.json").json(path)
    run = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return raw.select(run.alias("run"), "step", F.col("`rewards/accuracies`").alias("accuracy"), F.col("`rewards/margins`").alias("margin"), F.col("train_runtime").alias("runtime"))


def run_curves(log: DataFrame) -> DataFrame:
    """(run, steps, accuracies, margins, minutes): curves in step order, by entries that have a value; a run's log is its bounded history."""
    points = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("step", c))))
    g = log.groupBy("run").agg(points("accuracy").alias("a"), points("margin").alias("m"), (F.max("runtime") / 60).alias("minutes"))
    return g.select("run", F.col("a.step").alias("steps"), F.col("a.accuracy").alias("accuracies"), F.col("m.margin").alias("margins"), "minutes")


def percent(x: float | None, digits: int = 1) -> str:
    return "–" if x is None else f"{100 * x:.{digits}f}%"


def markdown_table(df: DataFrame, formats: dict[str, Callable] | None = None, limit: int = 10_000) -> str:
    """A report as a Markdown table (its size checked); None becomes a dash, bars and line breaks are escaped."""
    formats = formats or {}
    cell = lambda c, v: formats[c](v) if c in formats else "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    clean = lambda t: t.replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(clean(cell(c, r[c])) for c in df.columns) + " |" for r in bounded_rows(df, limit, "rows of a report")]
    return "\n".join(lines) + "\n"


def write_results(folder: str | Path, parts: dict[str, DataFrame], limit: int = 10_000) -> None:
    """results.json and results.md of several small reports."""
    write_document(Path(folder) / "results.json", {k: [r.asDict(recursive=True) for r in bounded_rows(df, limit, k)] for k, df in parts.items()})
    (Path(folder) / "results.md").write_text("\n".join(f"## {k}\n\n{markdown_table(df, limit=limit)}" for k, df in parts.items()), encoding="utf-8")
