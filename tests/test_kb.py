"""Knowledge files as a data source: splits, parsers of one's own, faults, and streams that agree with batches."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from lectern.sources import files, kb
from lectern.streaming import frames


def test_files_of_all_kinds(spark, tmp_path):
    """The same segments as by the readers; faults are rows; hidden files and empty pages are none."""
    (tmp_path / "sub").mkdir()
    for name, text in {"a.txt": "one\ntwo", "sub/b.MD": "# head", "c.bin": "x", "d.low": "loud", "e.bad": "?", ".h.txt": "no", "_m.txt": "no", "none": "x", "empty.txt": ""}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")

    def louder(file, part, parts):
        yield 0, 7, file.read().decode().upper(), 9

    def broken(file, part, parts):
        raise ValueError("no such format")

    kb.register(spark, {".LOW": kb.Parser("low", louder), ".bad": kb.Parser("bad", broken)}, "kb_kinds")
    for path in (str(tmp_path), f"file://{tmp_path}/", f"file:{tmp_path}"):
        rows = {r.source: r for r in spark.read.format("kb_kinds").load(path).collect()}
        assert {n: (r.content, r.page_number, r.total_pages, r.file_type, r.error) for n, r in rows.items()} == {
            "a.txt": ("one\ntwo", None, None, "txt", None), "b.MD": ("# head", None, None, "md", None), "d.low": ("LOUD", 7, 9, "low", None), "empty.txt": ("", None, None, "txt", None),
            "c.bin": (None, None, None, None, "unsupported file type: .bin"), "none": (None, None, None, None, "unsupported file type: "), "e.bad": (None, None, None, "bad", "ValueError: no such format"),
        }
    read = {r.source: r.document_id for r in files.read_text(spark, str(tmp_path)).collect()}
    assert all(rows[name].document_id == key for name, key in read.items() if name in rows) and "a.txt" in read
    assert spark.read.format("kb_kinds").load(f"{tmp_path}/a.txt").count() == 1
    (tmp_path / "nothing").mkdir()
    assert spark.read.format("kb_kinds").load(f"{tmp_path}/nothing").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("kb_kinds").load(f"{tmp_path}/nowhere").count()


def pages(file, part, parts):
    """A stand-in for the optional PDF reader: pages end at form feeds."""
    found = file.read().decode().split("\x0c")
    for i in range(len(found) * part // parts, len(found) * (part + 1) // parts):
        yield i, i + 1, found[i], len(found)


@pytest.mark.parametrize("split", [7, 100, 1 << 20])
def test_large_files_are_split(spark, tmp_path, split):
    """Every page and line once, whatever the splits; no task has more than its share."""
    texts = [f"page {i} é" if i % 5 else " " for i in range(40)]
    (tmp_path / "a.pdf").write_text("\x0c".join(texts), encoding="utf-8")
    lines = ["x" * (i * 7 % 90) or None for i in range(60)]
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" + "\n" * (i % 3) for i, t in enumerate(lines)).rstrip("\n"), encoding="utf-8")
    for i in range(5):
        (tmp_path / f"s{i}.txt").write_text("0123456789" * 3, encoding="utf-8")
    parsers = {".pdf": kb.Parser("pdf", pages, True), ".jsonl": kb.json_lines("text")}
    kb.register(spark, parsers, "kb_split")
    frame = spark.read.format("kb_split").option("splitBytes", split).load(str(tmp_path))
    rows = frame.orderBy("source", "index").collect()
    assert not any(r.error for r in rows)
    assert [(r["index"], r.page_number, r.content, r.total_pages) for r in rows if r.source == "a.pdf"] == [(i, i + 1, t, 40) for i, t in enumerate(texts) if t.strip()]
    assert [r.content for r in rows if r.source == "b.jsonl"] == [t for t in lines if t] and sum(r.file_type == "txt" for r in rows) == 5
    tasks = kb.planned(kb.listed(str(tmp_path)), {**kb.PARSERS, **parsers}, split)
    assert frame.rdd.getNumPartitions() == len(tasks) and (len(tasks) > 60 if split == 7 else len(tasks) == 1 if split == 1 << 20 else 10 < len(tasks) < 60)
    assert max(sum(item[1] == 0 and item[2] == 1 for item in t.items) for t in tasks) == {7: 1, 100: 3, 1 << 20: 7}[split]


def test_stream_agrees_with_batch(spark, tmp_path):
    """Files that come before and after a restart are read once each; a file that is not settled waits."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    kb.register(spark, {".jsonl": kb.json_lines("text")})

    def put(name, text, age):
        (folder / name).write_text(text, encoding="utf-8")
        at = time.time_ns() - age * 10**9
        os.utime(folder / name, ns=(at, at))

    def run():
        rows = spark.readStream.format("kb").option("splitBytes", 40).option("settle", 60).load(str(folder))
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.source, r["index"], r.content) for r in spark.read.parquet(out).collect())

    put("a.txt", "first", 3000)
    put("b.jsonl", "".join(json.dumps({"text": f"line {i}"}) + "\n" for i in range(20)), 2000)
    assert len(run()) == 21
    put("c.md", "second", 1000)
    put("d.txt", "not yet", 0)
    found = run()
    assert len(found) == 22 and run() == found
    put("d.txt", "at last", 500)
    batch = sorted((r.source, r["index"], r.content) for r in spark.read.format("kb").load(str(folder)).where(F.col("error").isNull()).collect())
    assert run() == batch and len(batch) == 23


def test_frames_of_a_stream(spark, tmp_path):
    """Replies of two runs are framed once each and in order; a batch that runs again repeats nothing."""
    source, target = str(tmp_path / "replies"), str(tmp_path / "frames")
    reply = "conv_id long, turn long, content string, error string"

    def add(rows):
        spark.createDataFrame(rows, reply).write.mode("append").parquet(source)
        stream = spark.readStream.schema(reply).parquet(source)
        frames.event_stream(stream, target, str(tmp_path / "checkpoint"), cite, ("conv_id", "turn")).awaitTermination()
        return {(r.conv_id, r.turn, r.seq): (r.type, r.data) for r in frames.events(frames.written(spark, target), ("conv_id", "turn")).collect()}

    def cite(rows):
        return rows.where("turn = 1").select("conv_id", "turn", F.struct(F.lit("a").alias("source")).alias("citation"))

    first = add([(1, 1, "two \"words\"", None), (1, 3, "", "late")])
    assert first == {(1, 1, 0): ("citations", '[{"source":"a"}]'), (1, 1, 1): ("token", "two "), (1, 1, 2): ("token", '"words"'), (1, 1, 3): ("done", ""), (1, 3, 0): ("token", ""), (1, 3, 1): ("error", '{"message":"late"}')}
    second = add([(2, 1, "é\n", None)])
    assert second == first | {(2, 1, 0): ("citations", '[{"source":"a"}]'), (2, 1, 1): ("token", "é\n"), (2, 1, 2): ("done", "")}
    frames.write_frames(spark.createDataFrame([(2, 1, "é\n", None)], reply), target, 1, cite, ("conv_id", "turn"))
    assert frames.written(spark, target).count() == len(second)
