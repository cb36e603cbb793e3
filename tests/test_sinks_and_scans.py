"""Chained sinks through failures, listings that open few folders, scans that end early."""

import hashlib
import hmac
import json
import os
import uuid

import pyarrow.fs as pafs
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringStartsWith

from siltstone.operators import chains, scans
from siltstone.sources import audit_files, backends
from siltstone.streaming import sinks

KEY = b"k"
EVENT = "chain string, ordinal long, body string"


def batches(n, size=4):
    return [[(f"c{i % 3}" if i % 7 else None, b * 100 + i, json.dumps({"n": b * 100 + i, "t": 'q"é\\'}, ensure_ascii=False)) for i in range(size)] for b in range(n)]


def expected(parts):
    state, out = {}, {}
    for part in parts:
        for chain, _, body in sorted(part, key=lambda e: (e[0] or "", e[1])):
            name = chain or ""
            prior, place = state.get(name, (bytes(32), -1))
            text = f'{{"sequence":{place + 1},"chain":{json.dumps(name)},{body[1:]}'
            own = hmac.new(KEY, prior + text.encode(), hashlib.sha256).digest()
            state[name] = (own, place + 1)
            out[name, place + 1] = f'{{"integrity_hash":"{own.hex()}",{text[1:]}'
    return out


def found(spark, folder):
    return {(r.chain, r.line_no): r.value for r in sinks.read(spark, folder).collect()}


def test_sink_batches_written_twice_broken_off_and_compacted(spark, monkeypatch):
    monkeypatch.setattr(sinks, "COMPACT", 2)
    folder, parts = audit_files.fresh_folder(spark, "sink"), batches(4)
    frames = [spark.createDataFrame(p, EVENT) for p in parts]
    assert sinks.read(spark, folder).count() == 0
    sinks.append(frames[0], 0, folder, KEY)
    sinks.append(frames[0], 0, folder, KEY)
    # killed after its lines: they do not count, and the batch is written over
    frames[1].select("chain", F.lit(7).cast("long").alias("sequence"), F.lit("x").alias("hash"), F.lit("half").alias("value")).write.parquet(f"{folder}/lines/batch=1")
    assert found(spark, folder) == expected(parts[:1])
    sinks.append(frames[1], 1, folder, KEY)
    # killed within its heads, which have no mark of success
    sinks.append(frames[2], 2, folder, KEY)
    fs, path = sinks._path(spark, f"{folder}/heads/batch=2/_SUCCESS")
    fs.delete(path, False)
    assert found(spark, folder) == expected(parts[:2])
    sinks.append(frames[2], 2, folder, KEY)
    sinks.append(spark.createDataFrame([], EVENT), 3, folder, KEY)
    sinks.append(frames[3], 4, folder, KEY)
    assert found(spark, folder) == expected(parts)
    assert chains.all_failures(sinks.read(spark, folder), KEY).count() == 0
    assert chains.failures_in_ranges(sinks.read(spark, folder), KEY).count() == 0


def test_a_stream_that_fails_in_a_batch_goes_on_from_it(spark, monkeypatch):
    source, folder, parts = audit_files.fresh_folder(spark, "events"), audit_files.fresh_folder(spark, "sink"), batches(2, 6)
    stream = lambda: spark.readStream.schema(EVENT).json(source)
    spark.createDataFrame(parts[0], EVENT).coalesce(1).write.mode("append").json(source)
    whole = sinks.append

    def broken(rows, batch, sink, key):
        whole(rows, batch, sink, key)
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "append", broken)
    with pytest.raises(PySparkException):
        sinks.start(stream(), folder, KEY).awaitTermination()
    monkeypatch.setattr(sinks, "append", whole)
    spark.createDataFrame(parts[1], EVENT).coalesce(1).write.mode("append").json(source)
    sinks.start(stream(), folder, KEY).awaitTermination()
    sinks.start(stream(), folder, KEY).awaitTermination()
    assert found(spark, folder) == expected(parts)


def test_plain_lines_and_forms(spark):
    folder = audit_files.fresh_folder(spark, "plain")
    rows = spark.createDataFrame([("t1", "j", "plan", None, 5), ("t2", "j", "custom", "m", None)], "ts string, job string, event string, message string, bytes long")
    lines = rows.select(F.lit("j").alias("chain"), F.monotonically_increasing_id().alias("ordinal"), sinks.line(rows.columns, "telemetry").alias("body"))
    sinks.append(lines, 0, folder, None)
    assert sorted(found(spark, folder).values()) == ['{"ts":"t1","job":"j","event":"plan","bytes":5}', '{"ts":"t2","job":"j","event":"custom","message":"m"}']
    with pytest.raises(ValueError, match="provenance lines need"):
        sinks.line(["ts"], "provenance")
    with pytest.raises(PySparkException):
        rows.withColumn("job", F.lit(None).cast("string")).select(sinks.line(rows.columns, "telemetry")).collect()


@pytest.fixture
def tree(tmp_path):
    for name in ("a/x/1", "a/y/2", "ab/3", "b/.h/4", "b/c/d/e/5", ".top/6", "7", "a/.8"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(name)
    return tmp_path


def names(reader):
    return sorted(f[0] for part in reader.partitions() for f in reader.read(part))


def test_filters_open_fewer_folders(tree):
    every = backends.ListingReader(str(tree), backends.REGISTRY.find(str(tree)))
    assert names(every) == sorted(["a/x/1", "a/y/2", "ab/3", "b/.h/4", "b/c/d/e/5", ".top/6", "7", "a/.8"])
    few = backends.ListingReader(str(tree), backends.REGISTRY.find(str(tree)))
    other = GreaterThan(("size",), 1)
    assert list(few.pushFilters([StringStartsWith(("path",), "a/"), Not(EqualTo(("hidden",), True)), other])) == [other]
    assert names(few) == ["a/x/1", "a/y/2"]
    assert few.opened < every.opened
    none = backends.ListingReader(str(tree), backends.REGISTRY.find(str(tree)))
    list(none.pushFilters([StringStartsWith(("path",), "a/"), StringStartsWith(("path",), "b")]))
    assert names(none) == [] and none.opened == 0


def test_listing_of_a_registered_backend(spark, tree):
    held = backends.Registry()
    root = str(tree)
    held.register("mem", lambda address: (pafs.SubTreeFileSystem(root, pafs.LocalFileSystem()), ""))
    assert "mem" in held.names() and held.unregister("mem") and not held.unregister("mem")
    with pytest.raises(ValueError, match="no backend"):
        held.find("mem://x")
    rows = backends.folder_listing(spark, "mem://x", lambda address: (pafs.SubTreeFileSystem(root, pafs.LocalFileSystem()), ""))
    assert {(r.path, r["size"]) for r in rows.collect()} == {(n, len(n)) for n in ("a/x/1", "a/y/2", "ab/3", "b/.h/4", "b/c/d/e/5", ".top/6", "7", "a/.8")}
    spark.conf.set(backends.PUSHDOWN, "true")
    try:
        some = backends.folder_listing(spark, root).where("path like 'a/%' and not hidden and size > 0")
        assert sorted(r.path for r in some.collect()) == ["a/x/1", "a/y/2"]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "StartsWith(path" not in plan.split("BatchScan")[0]
    finally:
        spark.conf.unset(backends.PUSHDOWN)


def test_early_scans(spark):
    path = audit_files.fresh_folder(spark, f"ordered-{uuid.uuid4().hex}")
    rows = spark.range(2000).select(F.floor(F.col("id") / 7).alias("k"), "id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id")).alias("v"))
    scans.save_ordered(rows, path, ["k", "id"], 12)
    early = scans.scan_until(spark, path, lambda f: f["id"] != 30)
    assert sorted(r.id for r in early.rows.collect()) == list(range(31)) and early.ended and early.files_read == 1 < early.files
    middle = scans.scan_until(spark, path, lambda f: ~f["id"].isin([900, 901, 1500]), growth=2)
    assert sorted(r.id for r in middle.rows.collect()) == list(range(901)) and middle.files_read < middle.files
    one = scans.scan_until(spark, path, lambda f: f["id"] < 1406, condition="k = 200")
    assert sorted(r.id for r in one.rows.collect()) == list(range(1400, 1407))
    whole = scans.scan_until(spark, path, lambda f: f["id"] >= 0)
    assert whole.rows.count() == 2000 and not whole.ended and whole.files_read == whole.files
    empty = audit_files.fresh_folder(spark, "ordered-empty")
    scans.save_ordered(rows.where("false"), empty, ["k"], 3)
    assert scans.scan_until(spark, empty, lambda f: f["id"] < 0).rows.count() == 0
