"""The streaming data source over recorded lines."""

import json
import os

from conftest import rows
from pyspark.sql import functions as F

from wayfeed.sources import recording


def line(k):
    return json.dumps({"topic": f"/t/{k}", "payload": f"p{k}", "received_at": "2026-01-01T00:00:00Z"})


def put(folder, name, lines, end="\n", at=None):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + end)
    if at is not None:
        os.utime(path, (at, at))


def writer(stream, out, mark):
    return stream.withColumn("at", F.col("line")).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(mark))


def batches_of(spark, stream, mark):
    """Rows of each batch, as they come."""
    seen = []
    step = lambda df, k: seen.append([(r.file, r.line, r.payload) for r in df.orderBy("file", "line").collect()])
    recording.run_to_end(stream.writeStream.foreachBatch(step).option("checkpointLocation", str(mark)))
    return [b for b in seen if b]


def test_name_order_bounded_batches_and_exact_restart(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "b.jsonl", [line(k) for k in range(7, 12)], at=1_000)  # the later name is the older file
    put(source, "a.jsonl", [line(0), "", line(1), "{broken", line(2), line(3)], end="", at=2_000)
    put(source, "_hidden.jsonl", [line(99)])
    stream = lambda: recording.stream_recording(spark, str(source), rows_per_batch=4, rows_per_task=3)
    first = batches_of(spark, stream(), tmp_path / "mark")
    flat = [r for b in first for r in b]
    assert flat == [("a.jsonl", n, p) for n, p in ((1, "p0"), (3, "p1"), (4, "{broken"), (5, "p2"), (6, "p3"))] + [("b.jsonl", k - 6, f"p{k}") for k in range(7, 12)]
    assert all(len(b) <= 4 for b in first) and len(first) == 3
    # Started again: nothing is repeated; a later name brings only its own rows.
    assert batches_of(spark, stream(), tmp_path / "mark") == []
    put(source, "c/c.jsonl", [line(k) for k in range(20, 29)], at=500)
    more = batches_of(spark, stream(), tmp_path / "mark")
    assert [p for b in more for _, _, p in b] == [f"p{k}" for k in range(20, 29)] and [len(b) for b in more] == [4, 4, 1]


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    source = tmp_path / "in"
    put(source, "a.jsonl", [line(k) for k in range(10)])
    seen = []

    def step(df, k):
        got = sorted(r.line for r in df.collect())
        seen.append(got)
        if k == 1 and len([s for s in seen if s == got]) == 1:
            raise RuntimeError("lost")

    mark = str(tmp_path / "mark")
    stream = lambda: recording.stream_recording(spark, str(source), rows_per_batch=4)
    try:
        recording.run_to_end(stream().writeStream.foreachBatch(step).option("checkpointLocation", mark))
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    recording.run_to_end(stream().writeStream.foreachBatch(step).option("checkpointLocation", mark))
    assert [s for s in seen if s] == [[1, 2, 3, 4], [5, 6, 7, 8], [5, 6, 7, 8], [9, 10]]


def test_parquet_sink_holds_every_line_once(spark, tmp_path):
    for f in range(5):
        put(tmp_path / "in", f"{f}.jsonl", [line(100 * f + k) for k in range(37)])
    stream = lambda: recording.stream_recording(spark, f"file://{tmp_path}/in", rows_per_batch=20, rows_per_task=6)
    for _ in range(2):
        recording.run_to_end(writer(stream(), tmp_path / "out", tmp_path / "mark"))
    got = rows(spark.read.parquet(str(tmp_path / "out")), "file", "line")
    assert [(r["file"], r["line"], r["payload"]) for r in got] == [(f"{f}.jsonl", k + 1, f"p{100 * f + k}") for f in range(5) for k in range(37)]


def test_no_folder_and_no_files(spark, tmp_path):
    assert batches_of(spark, recording.stream_recording(spark, str(tmp_path / "none")), tmp_path / "mark") == []


def test_line_ends_of_parts(tmp_path):
    put(tmp_path, "a.jsonl", ["x" * k for k in (0, 3, 5, 0, 2)], end="")
    reader = recording.RecordingReader({"path": str(tmp_path), "rowsPerBatch": "100", "rowsPerTask": "2"})
    assert list(reader._line_ends("a.jsonl", 0, None, None)) == [(2, 5), (2, 12), (1, 14)]
    assert list(reader._line_ends("a.jsonl", 5, None, 3)) == [(2, 12), (1, 14)]
    assert list(reader._line_ends("a.jsonl", 0, None, 3)) == [(2, 5), (1, 11)]
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [(n, v) for p in parts for b in reader.read(p) for n, v in zip(b["line"].to_pylist(), b["value"].to_pylist())]
    assert got == [(2, "xxx"), (3, "xxxxx"), (5, "xx")]


def test_many_lots_in_one_micro_batch(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", [line(k) for k in range(7)], end="")
    put(tmp_path / "in", "b.jsonl", [line(k) for k in range(7, 17)])
    spark.dataSource.register(recording.RecordingSource)
    reader = spark.readStream.format("recorded_lines").option("path", str(tmp_path / "in")).option("rowsPerBatch", 4).option("rowsPerTask", 3)
    seen = []
    step = lambda df, k: seen.append([(r.file, r.line, r.lot) for r in recording.recorded_rows(df).orderBy("file", "line").collect()])
    lines = reader.option("lotsPerBatch", 3).load()
    recording.run_to_end(lines.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "mark")))
    order = [("a.jsonl", k + 1) for k in range(7)] + [("b.jsonl", k + 1) for k in range(10)]
    # 17 lines in lots of four: two micro-batches, whose lots are numbered from 0 and cross the file border.
    assert [b for b in seen if b] == [[(*at, k // 4) for k, at in enumerate(order[:12])], [(*at, k // 4) for k, at in enumerate(order[12:])]]
