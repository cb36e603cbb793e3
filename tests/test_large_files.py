"""Deltas and content-defined chunks of files cut into spans, against the walks over whole contents."""

import random

import pytest

from siltstone.operators import chunking, delta, spans


def cases():
    rnd = random.Random(6)
    base = bytes(rnd.randrange(256) for _ in range(9000))
    low = bytes(rnd.choice(b"ab") for _ in range(6000))
    return {
        1: (base, base), 2: (base[:3000] + b"inserted" + base[3000:], base), 3: (b"", base), 4: (base, b""), 5: (b"\0" * 7000, b"\0" * 5000),
        6: (low, low[100:] + low[:100]), 7: (base[4000:] + base[:4000] + low, low + base), 8: (b"short", b"short"), 9: (base[:5013], base[5000:] + base[:5013]),
        10: (b"x" * 3 + b"\0" * 4000 + base[:777] + b"\0" * 4001, base[:777] + b"\0" * 300),
    }


def pieces(spark, contents, size, seed=1):
    """Pieces of uneven sizes, out of order."""
    rnd, rows = random.Random(seed), []
    for k, data in contents.items():
        at = 0
        while at < len(data):
            n = rnd.randrange(1, size)
            rows.append((k, at, bytearray(data[at : at + n]), "other"))
            at += n
    rnd.shuffle(rows)
    return spark.createDataFrame([*rows, (None, 0, bytearray(b"nobody"), "x"), (1, 0, bytearray(b""), "x")], "file_id long, offset long, data binary, span string")


@pytest.mark.parametrize("block,span,many", [(64, 128, 10**6), (7, 500, 10**6), (64, 4096, 0), (1024, 2048, 10**6)])
def test_large_deltas_equal_the_greedy_walk(spark, monkeypatch, block, span, many):
    monkeypatch.setattr(delta, "MANY_BLOCKS", many)
    held = cases()
    found = delta.large_deltas(pieces(spark, {k: s for k, (s, _) in held.items()}, 1500), pieces(spark, {k: d for k, (_, d) in held.items()}, 700, 2), block, least_span=span)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.file_id, r.src_offset)):
        got.setdefault(r.file_id, []).append((r.op, r.src_offset, r.dest_offset, r.length))
    assert got == {k: steps for k, (s, d) in held.items() if (steps := delta.greedy_delta(s, d, block))}


def test_large_deltas_of_large_blocks(spark):
    rnd = random.Random(3)
    data = rnd.randbytes(700_000)
    held = {1: (data[:200_000] + b"new" + data[200_000:], data), 2: (b"\xab" * 500_000, b"\xab" * 200_000)}
    found = delta.large_deltas(pieces(spark, {k: s for k, (s, _) in held.items()}, 200_000), pieces(spark, {k: d for k, (_, d) in held.items()}, 200_000), 65536, least_span=131072)
    for k, (s, d) in held.items():
        assert sorted((r.src_offset, r.op, r.dest_offset, r.length) for r in found.where(f"file_id = {k}").collect()) == [(a, op, b, n) for op, a, b, n in delta.greedy_delta(s, d, 65536)]


@pytest.mark.parametrize("sizes,span", [((64, 256, 1024), 2048), ((12, 32, 64), 128), ((64, 256, 1024), 1 << 20)])
def test_large_chunks_equal_the_walk(spark, sizes, span):
    held, config = {k: s for k, (s, _) in cases().items()}, chunking.ChunkConfig(*sizes)
    found = chunking.large_content_chunks(pieces(spark, held, 900), config, least_span=span)
    files = spark.createDataFrame([(k, bytearray(s)) for k, s in held.items()], "file_id long, content binary")
    want = chunking.content_chunks(files, config)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_spans_hold_their_bytes_and_the_overlap(spark):
    data = bytes(range(250)) * 4
    rows = {r.span: bytes(r.data) for r in spans.spans_of(pieces(spark, {7: data}, 90).where("file_id = 7"), 128, 30, "file_id").collect()}
    assert rows == {i: data[128 * i : 128 * i + 158] for i in range(8)}
    files = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray())], "file_id long, content binary")
    assert sorted((r.file_id, r.offset, bytes(r.data)) for r in spans.pieces_of(files, 300, "file_id", "content").collect()) == [(1, i, data[i : i + 300]) for i in range(0, 1000, 300)]
