"""Timed runs, their reports, a registry of workloads, and spark-submit command lines."""

from __future__ import annotations

import base64
import dataclasses
import importlib
import json
import os
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Report:
    name: str
    config: dict = field(default_factory=dict)
    startup_s: float = 0.0
    measured_s: float = 0.0
    end_to_end_s: float = 0.0
    rows: int = 0
    peak_rss_mb: float | None = None
    metrics: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Report:
        return cls(**json.loads(text))

    def write(self, folder: str) -> None:
        os.makedirs(folder, exist_ok=True)
        for name, value in (("config.json", self.config), ("summary.json", asdict(self))):
            with open(os.path.join(folder, name), "w") as f:
                json.dump(value, f, indent=1, sort_keys=True)


class Sampler:
    """The largest resident memory of this process and its children; best effort."""

    def __init__(self, every: float = 0.5):
        self.every, self.peak_mb, self._stop = every, None, threading.Event()

    def __enter__(self) -> Sampler:
        try:
            import psutil
        except ImportError:
            return self
        own = psutil.Process()

        def look() -> None:
            while not self._stop.wait(self.every):
                try:
                    now = sum(p.memory_info().rss for p in (own, *own.children(recursive=True))) / 1e6
                    self.peak_mb = max(self.peak_mb or 0, now)
                except psutil.Error:
                    pass

        threading.Thread(target=look, daemon=True).start()
        return self

    def __exit__(self, *_: Any) -> None:
        self._stop.set()


def run_benchmark(name: str, make: Callable[[], DataFrame], config: dict | None = None, folder: str | None = None) -> Report:
    """Builds and runs a query without keeping its rows."""
    began = time.time()
    with Sampler() as sampler:
        df = make()
        ready = time.time()
        rows = df.count()
        df.write.format("noop").mode("overwrite").save()
        done = time.time()
    report = Report(name, config or {}, ready - began, done - ready, done - began, rows, sampler.peak_mb)
    if folder:
        report.write(folder)
    return report


def benchmark_config(value: Any) -> dict:
    """A dataclass as plain JSON values."""
    if not dataclasses.is_dataclass(value):
        raise TypeError("a config is a dataclass")
    return json.loads(json.dumps(asdict(value), default=str))


_registry: dict[str, str] = {
    "document-topology": "strataflow.workloads.topology:DocumentTopology",
    "video-caption": "strataflow.workloads.topology:VideoCaption",
    "video-multimodal": "strataflow.workloads.topology:VideoMultimodal",
    "page-assembly": "strataflow.workloads.documents:PageAssembly",
    "clip-captions": "strataflow.workloads.captions:ClipCaptions",
    "detect-segment": "strataflow.workloads.models:DetectSegment",
    "two-models": "strataflow.workloads.models:TwoModels",
}


def register(name: str, target: str) -> None:
    if name in _registry and _registry[name] != target:
        raise ValueError(f"{name} is taken")
    _registry[name] = target


def available() -> list[str]:
    return sorted(_registry)


def load(name: str) -> Any:
    """The workload's class, imported only now."""
    if name not in _registry:
        raise ValueError(f"unknown workload: {name}; there are {', '.join(available())}")
    mod, _, attr = _registry[name].partition(":")
    return getattr(importlib.import_module(mod), attr)


def submit_command(script: str, config: dict, py_files: list[str] | None = None, conf: dict[str, str] | None = None, master: str | None = None) -> list[str]:
    """A spark-submit command line; the script gets the config as base64 JSON."""
    out = ["spark-submit", *(["--master", master] if master else [])]
    for k, v in sorted((conf or {}).items()):
        out += ["--conf", f"{k}={v}"]
    if py_files:
        out += ["--py-files", ",".join(py_files)]
    return [*out, script, base64.b64encode(json.dumps(config, sort_keys=True).encode()).decode()]


def submitted_config(argument: str) -> dict:
    return json.loads(base64.b64decode(argument))
