"""``spark.read.format("registry")`` and ``readStream``: the paged registry as a Spark data source.

A study is one row with its raw JSON; parse it with :func:`parsed`. The page token is the stream's offset, so a
restarted stream goes on where it stopped. Options: ``url`` (the API's address) or ``path`` (a JSON-lines file whose
lines are page bodies, for replays and tests), ``query``, ``statuses`` (bar-separated), ``pageSize``, ``limit``.
"""

from __future__ import annotations

import json
import sys
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader

from .registry import STUDY_SCHEMA, pages

SCHEMA = "nct_id string, study string"


def _http(url: str) -> Callable[[dict], tuple[int, dict]]:
    def fetch(params: dict) -> tuple[int, dict]:
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=30) as r:  # noqa: S310
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, {}
        except OSError:
            return 503, {}

    return fetch


def _replay(path: str) -> Callable[[dict], tuple[int, dict]]:
    with open(path, encoding="utf-8") as f:
        bodies = [json.loads(line) for line in f if line.strip()]
    tokens = {None: 0, **{b["nextPageToken"]: i + 1 for i, b in enumerate(bodies) if b.get("nextPageToken")}}

    def fetch(params: dict) -> tuple[int, dict]:
        at = tokens.get(params.get("pageToken"), len(bodies))
        return (200, bodies[at]) if at < len(bodies) else (200, {"studies": []})

    return fetch


def _fetch(options: dict) -> Callable[[dict], tuple[int, dict]]:
    return _replay(options["path"]) if "path" in options else _http(options["url"])


def _rows(studies: Iterator[dict]) -> Iterator[tuple]:
    for study in studies:
        yield study.get("protocolSection", {}).get("identificationModule", {}).get("nctId"), json.dumps(study, ensure_ascii=False)


def _list(options: dict) -> list[str] | None:
    return options["statuses"].split("|") if options.get("statuses") else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        limit = int(o["limit"]) if o.get("limit") else None
        yield from _rows(pages(_fetch(o), o.get("query", ""), _list(o), int(o.get("pageSize") or o.get("pagesize") or 100), limit, *([lambda s: None] if "path" in o else [])))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"token": "", "done": False}

    def _page(self, token: str) -> dict:
        o = self.options
        params = {"query.term": o.get("query", ""), "pageSize": int(o.get("pageSize") or o.get("pagesize") or 100)}
        if token:
            params["pageToken"] = token
        code, body = _fetch(o)(params)
        if code != 200:
            raise OSError(f"registry answered {code}")
        return body

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["done"]:
            return iter([]), start
        body = self._page(start["token"])
        following = body.get("nextPageToken") or ""
        return iter(list(_rows(iter(body.get("studies", []))))), {"token": following or start["token"], "done": not following}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        token, done = start["token"], start["done"]
        while not done and (token != end["token"] or end["done"]):
            body = self._page(token)
            yield from _rows(iter(body.get("studies", [])))
            token, done = body.get("nextPageToken") or token, not body.get("nextPageToken")


class RegistrySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Registers the source by value, as the process that plans a stream sees no shipped files."""
    package = sys.modules[__name__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        spark.dataSource.register(RegistrySource)
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def parsed(rows: DataFrame) -> DataFrame:
    """Rows of the source as studies, for :func:`.registry.normalize_studies`."""
    return rows.select(F.from_json("study", STUDY_SCHEMA).alias("s")).select("s.*")
