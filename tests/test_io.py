import json

import pytest
from pyspark.sql import functions as F

from strataflow import harness
from strataflow.operators.relational import uncommitted
from strataflow.sources import readers, sinks
from strataflow.streaming.adapter import run_stream
from strataflow.workloads import captions, documents, models, topology


def test_discovery(spark, tmp_path):
    for n in ("b.pdf", "sub/a.PDF", "c.txt", "d.jpeg"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    assert [r.stem for r in readers.pdfs(spark, str(tmp_path)).collect()] == ["b", "a"]
    assert readers.pdfs(spark, str(tmp_path), 1).count() == 1 and readers.images(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        readers.files(spark, str(tmp_path), ("gif",))
    (tmp_path / "sub/b.pdf").write_bytes(b"y")
    with pytest.raises(ValueError):
        readers.pdfs(spark, str(tmp_path))


def test_prompts(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" one \n\n two\n")
    assert [r.prompt for r in readers.prompts_text(spark, str(tmp_path / "p.txt")).collect()] == ["one", "two"]
    (tmp_path / "p.jsonl").write_text('{"prompt": "a"}\n"b"\n')
    assert [r.prompt for r in readers.prompts_jsonl(spark, str(tmp_path / "p.jsonl")).collect()] == ["a", "b"]
    (tmp_path / "q.jsonl").write_text('"b"\n{"x": 1}\n')
    with pytest.raises(Exception, match="line 2"):
        readers.prompts_jsonl(spark, str(tmp_path / "q.jsonl")).collect()


def test_manifest_and_retry(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"sources": [{"source_id": "s", "clips": [{"clip_index": 1, "path": "b"}, {"clip_index": 0, "path": "a"}]}]}))
    rows = readers.clips(spark, str(tmp_path / "m.json"), 2).orderBy("id").collect()
    assert [r.id for r in rows] == ["s__sample_000", "s__sample_001"] and [c.path for c in rows[0].clips] == ["a", "b"]

    def read(path):
        if path == "bad":
            raise OSError
        return path.encode()

    df = spark.createDataFrame([("ok",), ("bad",)], "path string")
    assert [r.content for r in readers.read_binary(df, "path", read, wait=0.0).collect()] == [bytearray(b"ok"), None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "# hi", "{}", 2), ("b", None, None, 0)], "stem string, markdown string, layout string, pages int")
    first = {r.stem: r.status for r in sinks.write_documents(df, str(tmp_path)).collect()}
    assert first == {"a": "completed", "b": "render_failed"}
    again = sinks.write_documents(df.withColumn("markdown", F.lit("other")), str(tmp_path)).collect()
    assert {r.stem: r.chars for r in again} == {"a": 4, "b": 0} and (tmp_path / "a/a.md").read_text() == "# hi"
    done = sinks.committed(df, str(tmp_path))
    assert uncommitted(df, done, "stem").count() == 0 and not list(tmp_path.rglob("*.incomplete"))
    side = sinks.write_sidecars(spark.createDataFrame([("i", b"x", "{}")], "stem string, image binary, meta string"), str(tmp_path / "o"))
    assert side.count() == 1 and (tmp_path / "o/i.overlay.jpg").read_bytes() == b"x"


def test_workloads(spark):
    out = topology.DocumentTopology().run(["doc-0", "doc-1"], [[2, 0, 2], [2, 2, 2]], spark=spark).outputs
    assert out == (["doc-0", "doc-1"], ["0,1||0,1", "0,1|0,1|0,1"], [3, 3])
    x = spark.createDataFrame([("A man, a dog", "a dog runs", "")], "a string, b string, c string")
    r = x.select(captions.f1(F.col("a"), F.col("b")), captions.score(F.col("c")), captions.f1(F.col("a"), F.col("c"))).first()
    assert r[0] == pytest.approx(2 * 2 / 6) and r[1] == float("-inf") and r[2] == 0
    clips = [[(0, "x", ["a", "a b c", "b", "c"])]]
    schema = "a string, b array<struct<clip_index:int,reference:string,candidates:array<string>>>"
    chosen, source = captions.ClipCaptions().run(["s"], clips, spark=spark, schema=schema).outputs
    assert chosen[0]["chosen"] == 1 and source[0]["clips"] == 1
    assert documents.recommend(8, 100, "conservative")["render"] == 4
    with pytest.raises(ValueError):
        models.with_options({}, {"x": {}})
    with pytest.raises(Exception, match="no file name"):
        spark.createDataFrame([("a/.x",)], "p string").select(documents.stem(F.col("p"))).collect()


def test_harness(spark, tmp_path):
    r = harness.run_benchmark("range", lambda: spark.range(10), {"n": 10}, str(tmp_path))
    assert r.rows == 10 and harness.Report.from_json(r.to_json()) == r and (tmp_path / "summary.json").exists()
    assert harness.load("two-models").__name__ == "TwoModels"
    with pytest.raises(ValueError):
        harness.load("none")
    command = harness.submit_command("job.py", {"a": 1})
    assert harness.submitted_config(command[-1]) == {"a": 1}


def test_stream(spark, tmp_path):
    spark.range(6).selectExpr("cast(id as string) as name", "cast(id % 3 as int) as n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, n int").parquet(str(tmp_path / "in"))
    q = run_stream(topology.VideoCaption(), stream, ["name", "n"], ["name"], lambda plan, n: plan.output().write.mode("overwrite").parquet(str(tmp_path / f"out-{n}")), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out-*")).count() == 6
