"""Plugins: functions of one source (in Arrow batches) and of a whole project (a table function with host callbacks).

A plugin is described by a manifest of known fields only.  A source plugin gets a text and gives a JSON object; what it raises
becomes its row's `error`, so one bad source does not end a scan.  A project plugin may call back the query tools that its
manifest names, a bounded number of times.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST_MOST, OUTPUT_MOST, QUERIES_MOST, SECONDS_MOST = 64 << 10, 16 << 20, 512, 300
#: Rows of a page that a callback gives.
ROWS_MOST = 500
#: The query tools that a project plugin may call back.
CALLBACKS = ("get_all_classes", "get_methods_of_class", "get_method_source", "search_code", "find_string_references", "get_call_graph")
_FIELDS = {"id": str, "name": str, "version": str, "protocol": int, "capability": str, "tools": list}


class PluginError(ValueError):
    pass


@dataclass(frozen=True)
class Manifest:
    id: str
    name: str
    version: str
    protocol: int
    capability: str
    tools: tuple[str, ...] = ()

    @classmethod
    def load(cls, text: str) -> Manifest:
        """Of JSON text; unknown, missing and mistyped fields are errors."""
        if len(text.encode()) > MANIFEST_MOST:
            raise PluginError("the manifest is too large")
        try:
            raw = json.loads(text)
        except ValueError as error:
            raise PluginError(f"the manifest is no JSON: {error}") from error
        if not isinstance(raw, dict) or set(raw) - set(_FIELDS):
            raise PluginError(f"unknown fields {sorted(set(raw) - set(_FIELDS))}" if isinstance(raw, dict) else "the manifest is no object")
        for name, kind in _FIELDS.items():
            if name != "tools" and not isinstance(raw.get(name), kind):
                raise PluginError(f"{name} is missing or no {kind.__name__}")
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]{0,63}", raw["id"]):
            raise PluginError("id")
        expected = {1: "source.analyze", 2: "project.analyze"}.get(raw["protocol"])
        if raw["capability"] != expected:
            raise PluginError(f"protocol {raw['protocol']} has capability {expected}")
        tools = raw.get("tools", [])
        if unknown := set(tools) - set(CALLBACKS):
            raise PluginError(f"tools {sorted(unknown)} cannot be called")
        return cls(raw["id"], raw["name"], raw["version"], raw["protocol"], raw["capability"], tuple(tools))


def analyze_sources(sources: DataFrame, key: str, text: str, plugin: Callable[[str], dict]) -> DataFrame:
    """(key, result JSON, error) of every source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results, errors = [], []
            for value in batch.column(1).to_pylist():
                try:
                    out = json.dumps(plugin(value or ""), sort_keys=True)
                    if len(out) > OUTPUT_MOST:
                        raise PluginError("the result is too large")
                    results.append(out)
                    errors.append(None)
                except Exception as error:  # whatever a plugin raises belongs to its row
                    results.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(results, pa.string()), pa.array(errors, pa.string())], [key, "result", "error"])

    return sources.select(key, text).mapInArrow(run, f"`{key}` {sources.schema[key].dataType.simpleString()}, result string, error string")


def source_statistics(text: str) -> dict:
    """The sample plugin: lines and characters of a source."""
    return {"lines": len(text.splitlines()), "characters": len(text)}


class Host:
    """What a project plugin may ask: the tools of its manifest, counted and timed."""

    def __init__(self, project, manifest: Manifest):
        self._project, self._manifest = project, manifest
        self._left, self._until = QUERIES_MOST, time.monotonic() + SECONDS_MOST

    def page(self, tool: str, offset: int = 0, **arguments) -> tuple[list[dict], int]:
        """(rows, total): at most ROWS_MOST rows from `offset` in the order of all columns, and how many there are."""
        if tool not in self._manifest.tools:
            raise PluginError(f"{tool} is not allowed")
        if self._left == 0 or time.monotonic() > self._until:
            raise PluginError("the plugin's queries or time are used up")
        self._left -= 1
        found = getattr(self._project, tool)(**arguments)
        order = [F.to_json(F.struct(*found.columns))]
        rows = found.orderBy(*order).offset(offset).limit(ROWS_MOST).collect()
        return [r.asDict(recursive=True) for r in rows], found.count()

    def query(self, tool: str, **arguments) -> list[dict]:
        """All rows, page by page; each page is one of the plugin's queries, and running out of them is an error, never a cut."""
        rows, total = self.page(tool, 0, **arguments)
        while len(rows) < total:
            more, total = self.page(tool, len(rows), **arguments)
            if not more:
                break
            rows += more
        return rows


def analyze_project(project, manifest: Manifest, plugin: Callable[[Host], list[dict]], schema: str) -> DataFrame:
    """The rows that a project plugin gives."""
    if manifest.protocol != 2:
        raise PluginError("not a project plugin")
    return project.spark.createDataFrame(plugin(Host(project, manifest)), schema)


def webview_inventory(host: Host) -> list[dict]:
    """A project plugin: call sites of five web view methods, by method."""
    # The methods that the inventory counts.
    names = ("loadUrl", "loadData", "loadDataWithBaseURL", "addJavascriptInterface", "evaluateJavascript")
    rows = []
    for name in names:
        for hit in host.query("search_code", query=f"android.webkit.WebView.{name}("):
            rows.append({"method_id": hit["method_id"], "call": name, "line": hit["line"]})
    return rows
