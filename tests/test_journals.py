"""Contents after a replay against a replay of byte arrays."""

import hashlib
import random

import pytest

from siltstone.operators import journals

ENTRY = "ordinal long, path string, op string, data binary, size long, ops array<struct<kind:string,length:long,data:binary>>"


def replayed(entries, existing):
    files = {p: bytearray(b) for p, b in existing}
    for _, path, op, data, size, ops in sorted(e for e in entries if e[1] is not None):
        if op == "create_file":
            data = data or b""
            size = len(data) if size is None else size
            files[path] = bytearray(data[:size].ljust(size, b"\0"))
        elif op == "delete_file":
            files.pop(path, None)
        elif op == "update_file":
            at = 0
            for kind, length, piece in ops or []:
                if kind == "copy_chunk":
                    at += length or 0
                    continue
                held = files.setdefault(path, bytearray())
                piece = piece or b""
                if piece and len(held) < at + len(piece):
                    held.extend(bytes(at + len(piece) - len(held)))
                held[at : at + len(piece)] = piece
                at += len(piece)
            if size is not None:
                held = files.setdefault(path, bytearray())
                files[path] = bytearray(held[:size].ljust(size, b"\0"))
    return {p: bytes(b) for p, b in files.items()}


def _random_journal(n, paths, seed):
    rnd = random.Random(seed)
    word = lambda most: bytes(rnd.randrange(1, 256) for _ in range(rnd.randrange(most)))
    out = []
    for k in range(n):
        path, kind = rnd.choice(paths), rnd.random()
        if kind < 0.03:
            out.append((k, path, "delete_file", None, None, None))
        elif kind < 0.08:
            out.append((k, path, "create_file", word(60), rnd.choice([None, 0, 13, 70]), None))
        elif kind < 0.12:
            out.append((k, path, "set_metadata", None, None, None))
        else:
            ops = [(rnd.choice(["write_chunk", "copy_chunk"]), 9, word(25)) for _ in range(rnd.randrange(1, 5))]
            ops = [(a, b if a == "copy_chunk" else None, c if a == "write_chunk" else None) for a, b, c in ops]
            out.append((k, path, "update_file", None, rnd.choice([None, rnd.randrange(90)]) if any(o[0] == "write_chunk" and o[2] for o in ops) else rnd.randrange(90), ops))
    return out


@pytest.mark.parametrize(("hot", "seed"), [(10_000, 1), (3, 2)])
def test_contents_equal_a_replay(spark, hot, seed):
    entries = [*_random_journal(150, ["a", "b", "old"], seed), (500, None, "delete_file", None, None, None), (501, "empty", "create_file", None, None, None)]
    existing = [("old", b"0123456789" * 9), ("kept", b"xyz" * 7)]
    ops = journals.steps(spark.createDataFrame(entries, ENTRY))
    there = spark.createDataFrame(existing, "path string, data binary")
    want = replayed(entries, existing)
    held: dict[str, list] = {}
    for r in journals.blocks(ops, there, 16, hot).collect():
        held.setdefault(r.path, []).append((r.block, bytes(r.data)))
    assert {p: b"".join(b for _, b in sorted(v)) for p, v in held.items()} == {p: b for p, b in want.items() if b}
    found = {r.path: (r["size"], r.blocks, r.digest) for r in journals.contents(ops, there, 16, hot).collect()}
    root = lambda b: hashlib.sha256("".join(hashlib.sha256(b[i : i + 16]).hexdigest() for i in range(0, len(b), 16)).encode()).hexdigest()
    assert found == {p: (len(b), -(-len(b) // 16), root(b)) for p, b in want.items()}
    covered: dict[str, int] = {}
    for r in journals.extents(ops, there, 16, hot).collect():
        covered[r.path] = covered.get(r.path, 0) + r.length
    assert covered == {p: len(b) for p, b in want.items() if b}


def test_no_operations(spark):
    ops = journals.steps(spark.createDataFrame([], ENTRY))
    assert journals.extents(ops).count() == journals.contents(ops).count() == 0
