"""What tasks hold and write does not grow with the input beyond its share: plans and batches of steps that once did."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from compare import assert_same

from siltstone.functions.hashes import rotating_hash
from siltstone.operators import batches, chunking, delta, spans
from siltstone.plans import logs
from siltstone.sources.audit_files import written


def contents(spark):
    rnd = random.Random(8)
    held = {1: rnd.randbytes(1000), 2: b"", 3: None, 4: b"\0" * 128, 5: rnd.randbytes(129), 6: "é".encode() * 70}
    return held, spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in held.items()], "file_id long, content binary")


def test_signatures_hold_no_content_beside_its_blocks(spark):
    """No queue of a Python expression, which held each block's row with its whole content."""
    held, files = contents(spark)
    for weak, hashed in (("adler32", zlib.adler32), ("rotating", lambda b: f"{rotating_hash(b):016x}")):
        found = delta.signatures(files, 64, weak=weak)
        assert "EvalPython" not in found._jdf.queryExecution().toString()
        want = [(k, i, len(v[i : i + 64]), hashed(v[i : i + 64]), hashlib.sha256(v[i : i + 64]).hexdigest()) for k, v in held.items() if v for i in range(0, len(v), 64)]
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_slices_have_all_rows_and_few_bytes():
    values = [b"x" * n for n in (5, 0, 7, 30, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(values, pa.binary())], names=["k", "v"])
    got = list(batches.slices([batch, batch.slice(0, 0)], 1, most=10))
    assert [r for b in got for r in b.column(1).to_pylist()] == values
    assert all(b.num_rows == 1 or sum(len(v or b"") for v in b.column(1).to_pylist()) <= 10 for b in got)


def test_steps_meet_their_destination_once_a_pair(spark):
    """Rows with a step and a whole destination were sorted by the aggregate, and spilled."""
    held, files = contents(spark)
    pairs = files.selectExpr("file_id AS pair_id", "content AS source", "reverse(content) AS dest").unionByName(files.selectExpr("file_id + 100 AS pair_id", "content AS source", "substring(content, 30) AS dest"))
    found = delta.rebuilt(pairs, delta.deltas(pairs, 16))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    assert {r.pair_id: bytes(r.content) for r in found.collect()} == {k + n: v for k, v in held.items() for n in (0, 100) if v}


def large_batch(rows, columns):
    rnd = random.Random(9)
    return pa.RecordBatch.from_arrays([pa.array(range(rows)), *[pa.array([rnd.randbytes(1000) for _ in range(rows)], pa.binary()) for _ in range(columns)]], names=["k", "a", "b"][: columns + 1])


def test_steps_of_a_batch_go_out_in_slices():
    batch = large_batch(3000, 2)
    out = list(delta._steps([batch], 64, "k"))
    assert len(out) > 5 and max(b.nbytes for b in out) < 2 * batches.AT_ONCE
    assert [r["k"] for b in out for r in b.to_pylist()] == list(range(3000))


def test_chunks_of_a_batch_go_out_in_slices():
    batch, config = large_batch(3000, 1), chunking.ChunkConfig(64, 256, 1024)
    out = list(chunking._chunk_rows([batch], config, "k"))
    assert len(out) > 2 and sum(sum(b.column("length").to_pylist()) for b in out) == 3_000_000
    assert max(b.num_rows for b in out) < 20_000


def test_jump_tables_of_matches_equal_those_of_all_places():
    rnd = np.random.default_rng(1)
    for _ in range(500):
        block = int(rnd.integers(1, 20))
        size = block * int(rnd.integers(2, 8))
        places = np.sort(rnd.choice(size, int(rnd.integers(1, size + 1)), replace=False))
        nth = np.searchsorted(places, np.arange(size))
        after = np.where(nth < len(places), places[np.minimum(nth, len(places) - 1)] + block, size)
        want = spans.jump_table(after, np.where(nth < len(places), after, -1), size, block)
        assert all(np.array_equal(a, b) for a, b in zip(delta._match_table(places, size, block), want, strict=True))


def test_choices_of_spans_are_dealt_by_number(spark, monkeypatch):
    """Matches are few bytes, which a coalesced shuffle put into one task."""
    plans = {}
    monkeypatch.setattr(delta, "written", lambda table, label: plans.update({label: table._jdf.queryExecution().toString()}) or table)
    data = random.Random(2).randbytes(9000)
    files = spark.createDataFrame([(1, 0, bytearray(data))], "file_id long, offset long, data binary")
    assert delta.large_deltas(files, files, 64, least_span=512).count() == 9000 // 64 + 1
    for label in ("delta-tables", "delta-chosen"):
        assert "REPARTITION_BY_NUM" in plans[label]


def test_workers_read_written_steps_in_small_batches(spark):
    """What a step sends to Python at a time does not grow with its task."""
    rows = spark.range(4000, numPartitions=1).selectExpr("id", "repeat('x', 10000) AS text")
    sizes = rows.mapInArrow(lambda found: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in found), "n long")
    assert max(r.n for r in written(sizes, "sizes").collect()) < 6 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(64 << 20)


def test_breaker_stream_in_portions_equals_the_batch(spark, duck, sf_dir, monkeypatch):
    """Timers of one micro-batch fill a worker; portions of the events in the order of time bound them."""
    starts = []
    follow = logs.states.circuit_breaker_stream
    monkeypatch.setattr(logs.states, "circuit_breaker_stream", lambda *a, **b: starts.append(1) or follow(*a, **b))
    monkeypatch.setattr(logs, "PORTION", -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // 3))
    assert_same(logs.QUERIES["st3_breaker_stream"], logs.ORACLES["st3_breaker_stream"], spark, duck, sf_dir)
    assert len(starts) == 3
