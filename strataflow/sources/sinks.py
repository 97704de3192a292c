"""Sinks that may be run again: every document has a folder, and its marker is the last file to appear.

A folder on a path that all executors share; files are written under temporary names and renamed."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "_SUCCESS"


def _put(path: str, data: bytes) -> None:
    temp = f"{path}.{uuid.uuid4().hex}.incomplete"
    with open(temp, "wb") as f:
        f.write(data)
    os.replace(temp, path)


def write_documents(rows: DataFrame, folder: str) -> DataFrame:
    """rows: stem, markdown, layout (JSON text), pages.  Returns stem, md_path, chars, pages, status; written ones are skipped.

    markdown null: the status is render_failed and only the marker is written."""
    root = folder.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = os.path.join(root, r["stem"])
                marker, md = os.path.join(own, MARKER), os.path.join(own, f"{r['stem']}.md")
                if os.path.exists(marker):
                    with open(marker) as f:
                        done = json.load(f)
                else:
                    os.makedirs(own, exist_ok=True)
                    done = {"stem": r["stem"], "status": "completed" if r["markdown"] is not None else "render_failed", "pages": r["pages"] or 0, "chars": len(r["markdown"] or "")}
                    if r["markdown"] is not None:
                        _put(md, r["markdown"].encode())
                        _put(os.path.join(own, f"{r['stem']}.json"), (r["layout"] or "{}").encode())
                    _put(marker, json.dumps(done).encode())
                out.append((r["stem"], md if done["status"] == "completed" else None, done["chars"], done["pages"], done["status"]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["stem", "md_path", "chars", "pages", "status"])

    return rows.select("stem", "markdown", "layout", F.col("pages").cast("long").alias("pages")).mapInArrow(run, "stem string, md_path string, chars long, pages long, status string")


def committed(rows: DataFrame, folder: str) -> DataFrame:
    """Markers of the rows' documents: stem, status, pages, chars.  Spark's listings hide such names, so each is looked up."""
    root = folder.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stem in batch.column(0).to_pylist():
                marker = os.path.join(root, stem, MARKER)
                if os.path.exists(marker):
                    with open(marker) as f:
                        m = json.load(f)
                    out.append((stem, m["status"], m["pages"], m["chars"]))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["stem", "status", "pages", "chars"])

    return rows.select("stem").distinct().mapInArrow(run, "stem string, status string, pages long, chars long")


def write_json(rows: DataFrame, folder: str) -> None:
    """One JSON object per row, by Spark's committer."""
    rows.write.mode("overwrite").json(folder)


def write_sidecars(rows: DataFrame, folder: str) -> DataFrame:
    """rows: stem, image (bytes), meta (JSON text).  <stem>.overlay.jpg and <stem>.json of each; returns stem and path."""
    root = folder.removeprefix("file://")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                _put(f"{root}/{r['stem']}.overlay.jpg", r["image"] or b"")
                _put(f"{root}/{r['stem']}.json", (r["meta"] or "{}").encode())
                out.append(r["stem"])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([f"{root}/{s}.overlay.jpg" for s in out], pa.string())], names=["stem", "path"])

    return rows.select("stem", "image", "meta").mapInArrow(run, "stem string, path string")
