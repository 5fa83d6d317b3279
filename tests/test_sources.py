"""Round trips of the formats, and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.sources import formats
from palaver.streaming import pipeline


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x",\n "n": 1}')
    assert formats.read_documents(spark, str(tmp_path / "*.json"), "id string, n int").collect() == [("x", 1)]
    (tmp_path / "b.json").write_text("{broken")
    with pytest.raises(Exception):  # noqa: B017
        formats.read_documents(spark, str(tmp_path / "*.json"), "id string, n int").collect()
    assert formats.read_or_empty(spark, str(tmp_path / "none/*.json"), "id string").count() == 0


def test_recognition_lines(spark, tmp_path):
    final = {"result": {"final": {"alternatives": [{"text": "да", "words": []}]}, "channelTag": "1"}}
    blank = {"result": {"final": {"alternatives": [{"text": " ", "words": []}]}}}
    (tmp_path / "r.ndjson").write_text("\n".join([json.dumps(final), "", "{bad", json.dumps(blank), json.dumps({"result": {"partial": {}}})]))
    assert [(r.tag, r.text) for r in formats.read_recognition(spark, str(tmp_path / "r.ndjson")).collect()] == [("1", "да")]


def test_rttm_round_trip(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER rec 1 0.500 2.250 <NA> <NA> S1 <NA> <NA>\nLEXEME x\nSPEAKER rec 1 x y z\n")
    got = formats.read_rttm(spark, str(tmp_path / "a.rttm")).collect()
    assert [(r.speaker, r.start, r.stop) for r in got] == [("S1", 0.5, 2.75)]


def test_wav(spark, tmp_path):
    x = np.sin(np.arange(8000) / 9)
    data = formats.encode_wav(x, 8000)
    assert formats.wav_header(data) == (1, 8000, 16)
    assert np.abs(formats.decode_wav(data) - x).max() < 1e-3
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(b"junk")
    files = formats.read_binary(spark, str(tmp_path))
    parts = sorted(formats.split_wav(files, 5044).collect(), key=lambda r: r.part)
    assert [round(r.offset_s, 4) for r in parts] == [0.0, 0.3125, 0.625, 0.9375]
    assert np.abs(np.concatenate([formats.decode_wav(bytes(r.content)) for r in parts]) - x).max() < 1e-3
    assert formats.listing(spark, str(tmp_path)).count() == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "1", "ref": "a b c"}\n\n{"id": "2", "ref": "a"}\n')
    m = formats.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r.id for r in formats.long_enough(m, 2, 5).collect()] == ["1"]


def test_stream_dedup_and_timeouts(spark, tmp_path):
    rows = [("a", "start", "2024-01-01 00:00:00"), ("a", "done", "2024-01-01 00:10:00"), ("b", "start", "2024-01-01 00:00:00"), ("a", "start", "2024-01-01 00:00:00")]
    src = tmp_path / "in"
    for i, part in enumerate([rows, [("c", "start", "2024-01-02 00:00:00")], [("c", "start", "2024-01-02 00:00:01")]]):
        spark.createDataFrame(part, "id string, stage string, at string").select("id", "stage", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(str(src / f"p={i}"))
    schema = "id string, stage string, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{src}/*")
    out = pipeline.run_once(pipeline.deduplicated(stream, ["id", "stage"], "at", "36500 days"))
    assert {(r.id, r.stage) for r in out.collect()} == {("a", "start"), ("a", "done"), ("b", "start"), ("c", "start")}
    timed = pipeline.with_timeouts(stream.withWatermark("at", "0 seconds"), "id", "at", "stage", "done", 3_600_000)
    got = {(r.key, r.status) for r in pipeline.run_once(timed).collect()}
    assert ("a", "done") in got and ("b", "timeout") in got and not any(k == "a" and s == "timeout" for k, s in got)


def test_stale_and_routed(spark):
    res = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "id string, generation string")
    req = spark.createDataFrame([("x", "1", 1), ("x", "2", 2)], "id string, generation string, requestedAt int")
    assert {(r.id, r.generation, r.stale) for r in pipeline.current_results(res, req).collect()} == {("x", "1", True), ("x", "2", False), ("y", "1", True)}
    good, bad = pipeline.routed(spark.createDataFrame([(1,), (None,), (3,)], "v int"), "v > 2")
    assert good.count() == 1 and bad.count() == 2
    todo = pipeline.in_chunks(res, ["id", "generation"], res.limit(1))
    assert todo.count() == 2
