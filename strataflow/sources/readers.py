"""Discovery of files, prompts and manifests.  Everything goes through Spark's readers, so any file system will do."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workloads.documents import stem

#: fixed values
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """(path, stem) of files below path, whatever the case of their suffix, sorted; an error for none or for equal stems."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    found = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).withColumn("stem", stem(F.col("path")))
    found = found.orderBy("path").limit(limit) if limit else found.orderBy("path")
    if found.isEmpty():
        raise ValueError(f"no {'/'.join(suffixes)} file below {path}")
    if twice := found.groupBy("stem").count().where("count > 1").select("stem").first():
        raise ValueError(f"several files are called {twice[0]}")
    return found


def pdfs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return files(spark, path, ("pdf",), limit)


def images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return files(spark, path, IMAGES, limit)


def prompts_text(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines without their outer white space; blank ones go."""
    x = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("prompt")).where("prompt <> ''")
    x = x.limit(limit) if limit else x
    if x.isEmpty():
        raise ValueError(f"no prompt in {path}")
    return x


def prompts_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines of {"prompt": ...} or of a bare string; the error for any other names its line."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    line = F.trim("line")
    bare = F.when(line.startswith('"'), F.get_json_object(F.concat(F.lit('{"prompt":'), line, F.lit("}")), "$.prompt"))
    got = F.coalesce(bare, F.when(line.startswith("{"), F.get_json_object(line, "$.prompt")))
    x = x.where(line != "").select("n", F.coalesce(got, F.raise_error(F.concat(F.lit("no prompt in line "), (F.col("n") + 1).cast("string"))).cast("string")).alias("prompt"))
    x = x.orderBy("n").limit(limit) if limit else x.orderBy("n")
    return x.select("prompt")


def clips(spark: SparkSession, path: str, times: int = 1) -> DataFrame:
    """(id, source_id, clips) of a manifest {"sources": [{"source_id", "clips": [...]}]}, clips by clip_index."""
    from ..workloads.captions import replicated

    x = spark.read.option("multiLine", "true").json(path).select(F.explode("sources").alias("s")).select("s.*")
    by_index: Callable[[Column], Column] = lambda c: F.array_sort(c, lambda a, b: F.when(a["clip_index"] < b["clip_index"], -1).when(a["clip_index"] > b["clip_index"], 1).otherwise(0))
    sound = F.when(F.size("clips") > 0, by_index(F.col("clips")))
    return replicated(x.select(F.col("source_id").alias("id"), "source_id", sound.alias("clips")), times)


def read_binary(rows: DataFrame, col: str, read: Callable[[str], bytes], attempts: int = 3, wait: float = 0.5) -> DataFrame:
    """Adds `content`: read(path), tried `attempts` times with doubled waits; null where every one failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(batch.schema.get_field_index(col)).to_pylist():
                got = None
                for k in range(attempts):
                    try:
                        got = read(path)
                        break
                    except Exception:
                        if k + 1 < attempts:
                            time.sleep(wait * 2**k)
                out.append(got)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "content"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{ddl}, content binary")
