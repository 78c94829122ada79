"""Sinks: query logs, exports, reports; and the session's settings from a file."""

from __future__ import annotations

import json
import re
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query_log(answers: DataFrame, path: str, low_path: str, confidence: str = "confidence", least: float = 0.6) -> None:
    """Appends all answers as JSON lines to `path`, those of little confidence to `low_path` also."""
    answers.write.mode("append").json(path)
    answers.where(F.col(confidence) < least).write.mode("append").json(low_path)


def export_csv(rows: DataFrame, path: str, order: str) -> None:
    """Rows in falling order with a header line; sorted by range, so files in name order are the whole order."""
    rows.orderBy(F.desc(order)).write.mode("overwrite").option("header", True).csv(path)


def report_html(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A table of the first `most` rows, which are meant to be few and aggregated; says how many there are if it leaves some out."""
    cell = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    found = rows.limit(most + 1).collect()
    body = "".join("<tr>" + "".join(f"<td>{cell(x)}</td>" for x in r) + "</tr>" for r in found[:most])
    more = f"<p>{most} of {rows.count()} rows</p>" if len(found) > most else ""
    return f"<h1>{cell(title)}</h1><table><tr>" + "".join(f"<th>{cell(c)}</th>" for c in rows.columns) + f"</tr>{body}</table>{more}"


def report_json(rows: DataFrame, summary: dict, path: str) -> None:
    """A report: the summary with the rows (one per question, few) under `queries`, as one JSON file that is put in place whole."""
    whole = summary | {"queries": [json.loads(x) for x in rows.toJSON().collect()]}
    put(path, json.dumps(whole, indent=2, ensure_ascii=False))


def put(path: str, text: str) -> None:
    """Writes a text so that readers see the old or the new file, never a part."""
    there = Path(path)
    there.parent.mkdir(parents=True, exist_ok=True)
    new = there.with_name(f".{there.name}.{uuid.uuid4().hex}")
    new.write_text(text, "utf-8")
    new.replace(there)


class ConfigError(ValueError):
    """Settings that can't be used."""


def config(path: str) -> dict:
    """Settings out of a JSON file, which must name `index_roots`."""
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(found, dict) or not found.get("index_roots"):
        raise ConfigError(f"{path}: index_roots is missing")
    return found


_loaded: dict[str, tuple[float, object]] = {}


def loaded(path: str, default: object) -> object:
    """A JSON file's content, read again when the file changed: taxonomies, synonyms, conventions, registries. A file that is
    missing or broken gives `default`. Lines of // comments are allowed, as in fixtures of questions."""
    file = Path(path)
    try:
        at = file.stat().st_mtime
        if _loaded.get(path, (None,))[0] != at:
            _loaded[path] = (at, json.loads(re.sub(r"(?m)(^|\s)//[^\n]*", r"\1", file.read_text("utf-8"))))
        return _loaded[path][1]
    except (OSError, ValueError):
        return default


def directories(path: str, roots: list[str]) -> list[dict]:
    """The registry of folders; without one it is made of the roots."""
    seeded = [{"id": str(k), "path": r, "enabled": True, "status": "active"} for k, r in enumerate(roots)]
    return loaded(path, seeded)


def fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The questions of a fixture file as rows; a list of plain questions gives rows that expect no path."""
    found = loaded(path, [])
    rows = [x if isinstance(x, dict) else {"query": str(x), "expected_paths": []} for x in found] if isinstance(found, list) else []
    return spark.createDataFrame(rows, schema)


def snapshot(config_path: str, history: str) -> str:
    """Keeps a copy of the settings and returns its version; later versions sort after earlier ones."""
    version = f"v_{datetime.now():%Y%m%d_%H%M%S_%f}_{uuid.uuid4().hex[:6]}"
    if Path(config_path).exists():
        put(f"{history}/{version}.json", Path(config_path).read_text("utf-8"))
    return version


def versions(history: str) -> list[dict]:
    """The kept settings, the newest first."""
    return [{"version": f.stem, "bytes": f.stat().st_size} for f in sorted(Path(history).glob("v_*.json"), reverse=True)] if Path(history).is_dir() else []


def rolled_back(config_path: str, history: str, version: str) -> None:
    """Puts a kept version in place, after keeping what it replaces."""
    text = Path(history, f"{version}.json").read_text("utf-8")
    snapshot(config_path, history)
    put(config_path, text)
