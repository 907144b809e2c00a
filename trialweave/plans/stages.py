"""The ordered stages of a run, their selection, fingerprints and resumption; and the plug-in registry."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

#: Stages in the order in which they run.
STAGES = ("prepare", "concepts", "link", "index", "ingest", "expand", "match", "eval")

_PLUGINS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable:
    def keep(make: Callable) -> Callable:
        _PLUGINS[kind, name] = make
        return make

    return keep


def resolve(kind: str, name: str) -> Callable:
    if (kind, name) not in _PLUGINS:
        raise KeyError(f"no {kind} named {name!r}; there are {registered(kind)}")
    return _PLUGINS[kind, name]


def registered(kind: str) -> list[str]:
    return sorted(n for k, n in _PLUGINS if k == kind)


def select(only: list | None = None, skip: tuple = (), first: str | None = None, last: str | None = None) -> list[str]:
    """Chosen stages in order; ``only`` overrides the rest."""
    named = [*(only or ()), *skip, *(x for x in (first, last) if x)]
    if unknown := sorted(set(named) - set(STAGES)):
        raise ValueError(f"unknown stages {unknown}")
    if only:
        return [s for s in STAGES if s in only]
    a, b = STAGES.index(first) if first else 0, STAGES.index(last) if last else len(STAGES) - 1
    if a > b:
        raise ValueError(f"{first} runs after {last}")
    return [s for s in STAGES[a : b + 1] if s not in skip]


def digest(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def folder_fingerprint(folder: str) -> str:
    """Digest of names, sizes and times of a folder's files."""
    rows = sorted((str(p.relative_to(folder)), p.stat().st_size, p.stat().st_mtime_ns) for p in Path(folder).rglob("*") if p.is_file())
    return digest(rows)


class Journal:
    """Fingerprints of finished stages, in one JSON file."""

    def __init__(self, path: str):
        self.path = path
        self.done: dict[str, str] = json.loads(Path(path).read_text()) if os.path.exists(path) else {}

    def current(self, stage: str, fingerprint: str) -> bool:
        return self.done.get(stage) == fingerprint

    def finish(self, stage: str, fingerprint: str) -> None:
        from ..sources.sinks import atomic_write

        self.done[stage] = fingerprint
        atomic_write(self.path, json.dumps(self.done, sort_keys=True))


def run(steps: dict[str, Callable[[], Any]], chosen: list[str], journal: Journal, fingerprints: dict[str, str], forced: tuple = (), finally_: Callable = lambda: None) -> list[str]:
    """Runs chosen stages whose fingerprint changed or that are forced; the names of those that ran."""
    ran = []
    try:
        for stage in chosen:
            mark = fingerprints.get(stage, "")
            if stage in forced or not mark or not journal.current(stage, mark):
                steps[stage]()
                ran.append(stage)
                if mark:
                    journal.finish(stage, mark)
    finally:
        finally_()
    return ran


def pending(wanted: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """What has no valid result yet."""
    return wanted.join(finished.select(key).distinct(), key, "left_anti")


def stale(wanted: DataFrame, prepared: DataFrame, key: str, source_time: str = "source_time", done_time: str = "done_time") -> DataFrame:
    """What has no result, or one older than its source."""
    newest = prepared.groupBy(key).agg({done_time: "max"}).toDF(key, "_done")
    rows = wanted.join(newest, key, "left")
    return rows.filter(rows["_done"].isNull() | (rows["_done"] < rows[source_time])).drop("_done")
