"""Operators on small inputs with known answers."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import blake3, hashes, patterns, scalars
from siltstone.operators import chains, chunking, containers, dedup, delta, index, logs, manifests, spans, sync
from siltstone.plans import logs as log_plans
from siltstone.sources import commands, listing
from siltstone.streaming import states


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_dedup_small_and_empty(spark):
    rows = [("01", 1, 0, 4096), ("02", 1, 4096, 4096), ("02", 2, 0, 4096), ("02", 3, 0, 4096), ("03", 1, 8192, 4096)]
    df = spark.createDataFrame(rows, "content_id string, file_id long, offset long, length long")
    r = dedup.dedup_stats(df).first()
    assert (r.unique_chunks, r.total_references, r.deduplicated_chunks, r.max_references, r.space_savings_pct) == (3, 5, 1, 3, 40.0)
    r = dedup.dedup_stats(df.limit(0)).first()
    assert (r.unique_chunks, r.total_references, r.dedup_ratio, r.space_savings_pct) == (0, 0, 0.0, 0.0)


def test_dedup_hot_key(spark):
    df = spark.range(20_000).select(F.lit("h").alias("content_id"), F.concat(F.lit("/data/file_"), F.col("id").cast("string")).alias("path"))
    r = index.bulk_stats(df).first()
    assert (r.chunks, r.locations, r.max_locations) == (1, 20_000, 20_000)


def periodic(n, v):
    out = bytearray()
    for i in range(n):
        v = (v * 7 + (i % 256)) % 256
        out.append(v)
    return bytes(out)


def test_content_chunks_survive_an_insertion(spark):
    data = periodic(2 << 20, 42)
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"\xff" + data))], "file_id long, content binary")
    chunks = chunking.content_chunks(df, chunking.ChunkConfig(16 << 10, 64 << 10, 256 << 10))
    r = index.preservation(chunks.where("file_id = 1"), chunks.where("file_id = 2")).first()
    assert r.rate > 0.9 or r.originals <= 4
    sizes = chunks.where("file_id = 1").orderBy("chunk_index").collect()
    assert [c.offset for c in sizes] == [sum(x.length for x in sizes[:i]) for i in range(len(sizes))]
    assert all(c.length <= 256 << 10 for c in sizes) and all(c.length >= 16 << 10 for c in sizes[:-1])


def test_cut_points_equal_a_sequential_walk():
    config = chunking.ChunkConfig(64, 256, 1024)
    rnd = random.Random(5)
    for n in (0, 1, 63, 64, 1023, 1024, 1025, 5000, 20_000):
        data = bytes(rnd.choice(b"abc d\0") for _ in range(n))
        ends, start = [], 0
        while len(data) - start >= config.most:
            h, i = 0, start
            while True:
                h = (h * 2 + int(chunking.GEAR[data[i]])) & 0xFFFFFFFFFFFFFFFF
                i += 1
                if i - start >= config.most or (i - start >= config.least and (h & config.mask) < chunking.CUT_BELOW):
                    break
            ends.append(i)
            start = i
        if start < len(data):
            ends.append(len(data))
        assert (chunking.cut_points(data, config) if data else []) == ends


@pytest.mark.parametrize("sizes", [(65536, 65536, 262144), (8192, 262144, 262144), (8192, 60000, 262144)])
def test_bad_chunk_sizes(sizes):
    with pytest.raises(ValueError):
        chunking.ChunkConfig(*sizes)


def test_chunk_edges(spark):
    df = spark.createDataFrame([(1, bytearray()), (2, bytearray(b"*" * 1024)), (3, bytearray(1 << 20))], "file_id long, content binary")
    counts = {r.file_id: r.n for r in chunking.content_chunks(df).groupBy("file_id").agg(F.count("*").alias("n")).collect()}
    assert 1 not in counts and counts[2] == 1
    assert all(r.is_zero for r in chunking.content_chunks(df).where("file_id = 3").collect())


@pytest.mark.parametrize("block,source,dest,least", [
    (65536, b"\xab" * (200 << 10), b"\xab" * (200 << 10), 0.95),
    (25 << 10, bytes(i % 256 if not (125 << 10) <= i < (175 << 10) else 255 for i in range(300 << 10)), bytes(i % 256 for i in range(300 << 10)), 0.8),
    (16 << 10, b"\xcc" * (100 << 10) + b"\xdd" * (50 << 10), b"\xcc" * (100 << 10), 0.6),
])
def test_delta_savings_and_round_trip(spark, block, source, dest, least):
    pairs = spark.createDataFrame([(1, bytearray(source), bytearray(dest))], "pair_id long, source binary, dest binary")
    steps = delta.deltas(pairs, block)
    assert bytes(delta.rebuilt(pairs, steps).first().content) == source
    assert delta.delta_stats(pairs, steps, block).first().savings_ratio > least


def test_greedy_delta_equals_a_plain_scan():
    rnd = random.Random(9)

    def plain(source, dest, block):
        index_, out, at, pending = {}, [], 0, 0
        for o in range(0, len(dest), block):
            index_.setdefault(dest[o : o + block], o)
        while at < len(source):
            piece = source[at : at + block]
            if piece in index_ and (len(piece) == block or block < delta.ROLLING_FROM):
                if at > pending:
                    out.append(("data", pending, at - pending))
                out.append(("copy", index_[piece], len(piece)))
                at += len(piece)
                pending = at
            else:
                at += 1
        if len(source) > pending:
            out.append(("data", pending, len(source) - pending))
        return out

    for _ in range(200):
        dest = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 60)))
        source = dest[: rnd.randrange(0, 60)] + bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(0, 9))) + dest[rnd.randrange(0, 60) :]
        block = rnd.choice((3, 4, 7))
        got = [(op, s if op == "data" else d, n) for op, s, d, n in delta.greedy_delta(source, dest, block)]
        assert got == plain(source, dest, block)


def test_signature_lookup_takes_the_first_strong_match(spark):
    held = spark.createDataFrame([(0, 10, 12345, "010203"), (10, 10, 67890, "040506"), (20, 10, 12345, "070809")], "offset long, length long, weak long, strong string")
    asked = spark.createDataFrame([(12345, "070809"), (11111, "070809")], "weak long, strong string")
    assert {r.weak: r.match_offset for r in delta.lookup(asked, held).collect()} == {12345: 20, 11111: None}


def test_rotating_hash_equals_a_loop():
    data = bytes(range(200))
    h = 0
    for b in data:
        h = ((h << 1 | h >> 63) & (1 << 64) - 1) ^ int(hashes.BLOCK_TABLE[b])
    assert hashes.rotating_hash(data) == h


def test_filters(spark):
    rules = patterns.rule_list(exclude=["target/**", "*.log"])
    df = spark.createDataFrame([("src/main.rs",), ("src/lib.rs",), ("target/debug.log",), ("README.md",)], "path string")
    assert [r.path for r in df.where(patterns.should_include(rules, F.col("path"))).collect()] == ["src/main.rs", "src/lib.rs", "README.md"]
    assert patterns.parse_rule("! - x").action == "include"
    assert patterns.parse_rule(r"- regex: ^build/.*\.o$").kind == "regex"
    with pytest.raises(patterns.RuleError) as error:
        patterns.parse_rules("+ a\n\nnonsense\n")
    assert error.value.line == 3
    with pytest.raises(patterns.RuleError):
        patterns.parse_rule("+ regex: (?=a)b")


@pytest.mark.parametrize("pattern,text,match", [("*.txt", "path/to/file.txt", True), ("data/2024-*", "data/2023-01-01.csv", False), ("?oo", "fooo", False), ("a.b", "axb", False)])
def test_object_globs(spark, pattern, text, match):
    assert one(spark, key=text).select(patterns.object_glob(F.col("key"), pattern).alias("m")).first().m is match


def test_static_prefixes():
    assert [patterns.static_prefix(p) for p in ("data/2024-*", "logs/*.txt", "*.x")] == ["data/2024-", "logs/", ""]


def test_semantic_classes(spark):
    paths = {
        "production.toml": ("critical", "atomic_replace"), "docker-compose.yaml": ("critical", "atomic_replace"), "database.wal": ("high", "append_only"),
        "pg_wal/000000010000000000000001": ("high", "append_only"), "source_code.rs": ("normal", "content_defined"), "backup_2025.iso": ("low", "content_defined"),
        "video.mp4": ("low", "content_defined"), ".env": ("critical", "atomic_replace"),
    }
    df = spark.createDataFrame([(p, bytearray(b"")) for p in paths] + [("photo", bytearray(b"\x89PNG" + b"0" * 12))], "path string, head binary")
    got = {r.path: (r.c.priority, r.c.strategy) for r in df.select("path", sync.semantic_class(F.col("path"), F.col("head")).alias("c")).collect()}
    assert got == paths | {"photo": ("low", "content_defined")}


def test_priority_chain(spark):
    rows = [("big_critical", 0, 1_000_000), ("small_critical", 0, 100), ("normal", 50, 500), ("low", 100, 50)]
    df = spark.createDataFrame(rows, "path string, rank int, size long").withColumn("queued_at", F.lit(0)).withColumn("retry_count", F.lit(0))
    assert [r.path for r in sync.prioritised(df).collect()] == ["small_critical", "big_critical", "normal", "low"]


def test_link_dest_overlap(spark):
    make = lambda rows: spark.createDataFrame(rows, "path string, content_id int, ref_priority int")
    src = make([("a", c, 0) for c in (1, 2, 3)] + [("b", c, 0) for c in (1, 2, 3, 4, 5)] + [("c", 9, 0)])
    ref = make([("a", c, 1) for c in (3, 1, 2)] + [("b", c, 1) for c in (1, 2, 3, 7)] + [("c", 8, 1)])
    got = {r.path: (r.decision, round(r.overlap, 3)) for r in sync.link_dest_overlap(src, ref).collect()}
    assert got == {"a": ("hardlink", 1.0), "b": ("delta_basis", 0.6), "c": ("full", 0.0)}


def test_hardlinks(spark):
    df = spark.createDataFrame([("a.txt", 1, 5, 2), ("b.txt", 1, 5, 2), ("c.txt", 1, 6, 1)], "path string, dev long, ino long, nlink int")
    assert {(r.path, r.original, r.is_link) for r in sync.hardlinks(df).collect()} == {("a.txt", "a.txt", False), ("b.txt", "a.txt", True)}


def test_delta_gate(spark):
    rows = [(102400, 92160, True, False, False, True), (102400, 92160, True, True, False, False), (102400, None, True, False, False, False), (102400, 92160, False, False, False, False), (100, 90, True, False, False, False), (102400, 0, True, False, False, False), (5, None, False, False, True, True)]
    df = spark.createDataFrame(rows, "size long, old long, delta boolean, whole boolean, part boolean, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", sync.should_use_delta(*map(F.col, ("size", "old", "delta", "whole", "part")))).collect())


def test_containers(spark):
    df = spark.createDataFrame([("p", 0, 100), ("p", 1, 1), ("p", 2, 0), ("p", 3, 101)], "pool string, ordinal long, length long")
    got = [(r.container_id, r.offset, r.error) for r in containers.pack_containers(df, 116).orderBy("ordinal").collect()]
    assert got == [("container_000000", 16, None), ("container_000001", 16, None), ("container_000001", 17, None), ("container_000002", -1, "too large")]


def test_bitmap(spark):
    df = spark.range(100).select(F.lit(0).alias("window_id"), F.col("id").alias("pos"), F.col("id").isin(5, 10, 15).alias("bit"))
    got = {r.pos: (r.rank, r.select_index) for r in index.bitmap_ranks(df).collect()}
    assert [got[p][0] for p in (0, 6, 11, 20)] == [0, 1, 2, 3]
    assert [p for p in sorted(got) if got[p][1] is not None] == [5, 10, 15]
    r = index.window_progress(df).first()
    assert (r.total, r.completed, r.missing, r.next_missing, r.percent) == (100, 3, 97, 0, 3.0)


def test_bloom_has_no_false_negatives(spark):
    m, k = index.bloom_size(500, 0.01)
    members = spark.range(500).select(F.col("id").alias("v"))
    probes = spark.range(3000).select(F.col("id").alias("v"))
    found = {r.v for r in index.bloom_probe(probes, "v", index.bloom_build(members, "v", m, k), m, k).collect()}
    assert set(range(500)) <= found and len(found) < 650


def test_windows_closed_form(spark):
    want = {}
    for n in (1, 3, 4, 5, 63, 64, 65, 124, 125, 200):
        starts, first = [], 0
        while first < n:
            starts.append((first, min(64, n - first)))
            first += max(min(64, n - first) - 4, 1)
        want[n] = starts
    df = spark.createDataFrame([(n, i, f"{n}-{i}") for n in want for i in range(n)], "file_id long, chunk_index long, content_id string")
    got = {}
    for r in manifests.windows(df).orderBy("window_id").collect():
        got.setdefault(r.file_id, []).append((r.first_chunk, r["count"]))
        ids = "".join(f"{r.file_id}-{i}" for i in range(r.first_chunk, r.first_chunk + r["count"]))
        assert r.merkle_root == hashlib.sha256(ids.encode()).hexdigest()
    assert got == want


def test_chain_sign_and_tamper(spark, sf_dir):
    rows = spark.createDataFrame([("c", i, f'{{"sequence":{i},"type":"custom"}}') for i in range(5)], "chain string, sequence long, canonical string")
    signed = chains.sign(rows, b"k")
    prior = bytes(32)
    for r in signed.orderBy("sequence").collect():
        prior = hmac.new(b"k", prior + r.canonical.encode(), hashlib.sha256).digest()
        assert r.integrity_hash == prior.hex()
    line = F.concat(F.lit('{"integrity_hash":"'), "integrity_hash", F.lit('",'), F.substring("canonical", F.lit(2), F.length("canonical")))
    lines = signed.select("chain", F.col("sequence").alias("line_no"), line.alias("value"))
    assert chains.all_failures(lines, b"k").count() == 0 and chains.first_failures(lines, b"k").count() == 0
    bad = lines.withColumn("value", F.when(F.col("line_no") == 2, F.replace("value", F.lit("custom"), F.lit("other"))).otherwise(F.col("value")))
    assert [(r.line_no, r.failure) for r in chains.first_failures(bad, b"k").collect()] == [(2, "hash")]
    assert chains.all_failures(bad, b"k").agg(F.min("line_no")).first()[0] == 2
    gone = lines.where("line_no != 1")
    assert chains.first_failures(gone, b"k").first().failure == "sequence"
    tampered = log_plans.signed_lines(spark, sf_dir)
    first = {(r.chain, r.line_no) for r in chains.first_failures(tampered, log_plans.KEY).collect()}
    every = chains.all_failures(tampered, log_plans.KEY).groupBy("chain").agg(F.min("line_no").alias("n")).collect()
    assert first == {(r.chain, r.n) for r in every}


def test_hmac_equals_library(spark):
    for key in (b"k", b"x" * 100):
        mac = one(spark, m=bytearray(b"text")).select(scalars.hmac_sha256(key, F.col("m")).alias("h")).first().h
        assert mac == hmac.new(key, b"text", hashlib.sha256).hexdigest()


def test_history_lines(spark):
    lines = ['{"timestamp":"t","src":"/a","bytes":5,"duration":1.5,"status":"done"}', '﻿{"time":"u","bytes_copied":"x","bytes":7}', "", "oops", "[1]", '{"bytes":-1}']
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {r.line_no: (r.timestamp, r.source, r.bytes, r.duration_secs, r.status) for r in logs.history(df).collect()}
    assert got == {0: ("t", "/a", 5, 1.5, "done"), 1: ("u", "-", None, None, "ok"), 5: ("unknown", "-", None, None, "ok")}


def test_audit_round_trip(spark, tmp_path):
    rows = [("t1", "=cmd", "b,c", 10, 5, None, 1.5, "success", 1, None), ("t2", 'q"q', "d", 0, 0, "s", None, "failed", 2, "boom")]
    df = spark.createDataFrame(rows, logs.AUDIT_ENTRY)
    logs.write_audit(df, f"{tmp_path}/a.json")
    logs.write_audit(df, f"{tmp_path}/a.csv", "csv")
    (tmp_path / "a.json" / "bad.json").write_text('{"timestamp": "x"}\nnot json\n\n')
    assert {tuple(r) for r in logs.read_audit_json(spark, f"{tmp_path}/a.json").collect()} == set(rows)
    assert {r.source for r in logs.read_audit_csv(spark, f"{tmp_path}/a.csv").collect()} == {"'=cmd", 'q"q'}


def test_provenance_reader(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"ts":"1","event_type":"chunk_created"}\n\n{"event_type":"nothing"}\n{"ts":"2","event_type":"job_failed","context":{"a":"b"}}\n')
    got = logs.read_provenance(spark, str(tmp_path)).select("event_type", logs.is_chunk_event(F.col("event_type")).alias("c"), logs.is_job_event(F.col("event_type")).alias("j")).collect()
    assert {tuple(r) for r in got} == {("chunk_created", True, False), ("job_failed", False, True)}


def test_strict_reader_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a":1}\nbroken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.read_strict(spark, str(tmp_path), "a int").collect()


def test_failures_in_ranges_equal_the_walk(spark):
    """Chains altered, cut and stripped; one whose lines fit the last good hash again, twice; one long chain in many ranges."""
    key, rows = b"k", []
    mac = lambda prior, text: hmac.new(key, prior + text.encode(), hashlib.sha256).digest()
    rnd = random.Random(11)
    for chain in ("whole", "altered", "again", "cut", "bare", "long"):
        prior, good = bytes(32), bytes(32)
        for i in range(200 if chain == "long" else 30):
            text = f'{{"sequence":{i},"type":"{rnd.choice("abc")}"}}'
            stuck = chain == "again" and i in (9, 10, 20) or chain == "long" and i == 150
            prior = mac(good if chain == "again" and i in (12, 23) else prior, text)
            if chain == "again" and i not in (*range(9, 12), *range(20, 23)):
                good = prior
            line = text if chain == "bare" and i % 7 == 3 else f'{{"integrity_hash":"{prior.hex()}",{text[1:]}'
            line = line.replace('"type":"', '"type":"x') if stuck or chain == "altered" and i == 5 else line
            if not (chain == "cut" and i in (0, 8)):
                rows.append((chain, i, line))
    lines = spark.createDataFrame(rows, "chain string, line_no long, value string").repartition(5)
    for skip in (False, True):
        want = sorted(map(tuple, chains.all_failures(lines, key, skip).collect()))
        assert sorted(map(tuple, chains.failures_in_ranges(lines, key, skip).collect())) == want
    failed = {r.line_no for r in chains.failures_in_ranges(lines, key).where("chain = 'again'").collect()}
    assert {9, 20} <= failed and not failed & {13, 14, 15, 24, 25}
    assert chains.failures_in_ranges(lines.limit(0), key).count() == 0


def test_ranks_from_the_directory(spark):
    """Small and sparse windows, probes between, before and after all ones, in super-blocks that have none."""
    ones = {1: [5, 10, 15], 2: [0, 59, 60, 61, 3839, 3840, 20_000], 3: []}
    bits = spark.createDataFrame([(w, p, True) for w, held in ones.items() for p in held] + [(3, 7, False), (1, 6, False)], "window_id long, pos long, bit boolean")
    asked = [(w, p) for w in (1, 2, 3, 4) for p in (0, 5, 6, 11, 20, 59, 60, 62, 3839, 3840, 3841, 9000, 20_000, 20_001, 10**6)]
    found = index.ranks_at(spark.createDataFrame(asked, "window_id long, pos long"), index.rank_directory(bits))
    assert {(r.window_id, r.pos): (r.rank, r.set) for r in found.collect()} == {(w, p): (sum(x < p for x in ones.get(w, ())), p in ones.get(w, ())) for w, p in asked}


def test_retry_outcomes(spark):
    rows = [("a", 1, "io", True, "abort"), ("a", 2, None, False, "abort"), ("b", 1, "config", False, "abort"), ("c", 1, "io", True, "skip"), ("c", 2, None, False, "skip")]
    df = spark.createDataFrame(rows, "op_id string, attempt int, error_kind string, is_transient boolean, mode string")
    assert {r.op_id: (r.made, r.outcome) for r in states.retry_outcomes(df).collect()} == {"a": (2, "succeeded"), "b": (1, "failed"), "c": (1, "skipped")}


def test_circuit_breaker():
    state, seen = (states.CLOSED, 0, 0), []
    for at, ok in ((0, False), (1, False), (2, True), (60_000, True), (60_001, False)):
        state, allowed = states.breaker_step(state, at, ok, 2, 30_000)
        seen.append((allowed, state[0]))
    assert seen == [(True, "closed"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_breaker_stream_equals_batch_over_restarts(spark, tmp_path):
    """Events out of order within the watermark's delay, in three runs from one checkpoint."""
    rnd = random.Random(8)
    rows = [(f"e{i % 3}", i, i // 2 * 1800 + 1, i % 4 != 1) for i in range(90)]
    df = spark.createDataFrame(rows, "endpoint string, ordinal long, at_ms long, succeeded boolean")
    batch = {tuple(r) for r in states.circuit_breaker(df, 2, 3000).collect()}
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError):
        states.circuit_breaker_stream(stream)
    spark.conf.set(name, states.ROCKS)
    try:
        found = states.circuit_breaker_stream(stream, 2, 3000, late="30 seconds", tick_ms=5000)
        for part in (rows[:30], rows[30:60], [*rows[60:], ("end", 0, 10**7, True)]):
            rnd.shuffle(part)
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert {tuple(r) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()} == batch


def test_token_bucket_equals_the_fold(spark):
    """One stream in many ranges, ties in time, nulls as a stream's name, requests above the capacity."""
    rnd, rows = random.Random(7), []
    for i in range(400):
        rows.append((rnd.choice(["hot", "hot", "hot", "b", None]), i, rnd.randrange(6000), rnd.choice([0, 1, 50, 4000, 200_000])))
    df = spark.createDataFrame(rows, "stream string, ordinal long, at_ms long, bytes long").repartition(3)
    want, held = {}, {}
    for name, i, at, size in sorted(rows, key=lambda r: (r[2], r[1])):
        left, last = held.get(name, (1000, at))
        asked = -(-size // 100)
        left = min(1000, left + at - last) - asked
        held[name] = (left, at)
        want[i] = (name, asked, max(0, -left))
    found = states.token_bucket(df, 100_000)
    assert {r.ordinal: (r.stream, r.tokens, r.wait_ms) for r in found.collect()} == want
    assert "Python" not in found._jdf.queryExecution().toString()


def test_blake3_of_public_vectors_and_of_files_in_spans(spark, monkeypatch):
    known = {  # fixed values: the published vectors, whose input counts up modulo 251
        0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
        1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
        1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
        1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
        1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
        2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
        2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
        3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    }
    contents = {n: bytes(i % 251 for i in range(n)) for n in known}
    assert dict(zip(known, blake3.hashes(list(contents.values())), strict=True)) == known
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in contents.items()] + [(-1, None)], "file_id long, content binary")
    assert {r.file_id: r.h for r in files.select("file_id", blake3.blake3("content").alias("h")).collect()} == known | {-1: None}
    large = {n: random.Random(n).randbytes(n) for n in (1, 2048, 2049, 4096, 30_001, 65_536, 70_000, 131_072)}
    whole = dict(zip(large, blake3.hashes(list(large.values())), strict=True))
    monkeypatch.setattr(blake3, "TOGETHER", 8)
    assert dict(zip(large, blake3.hashes(list(large.values())), strict=True)) == whole
    monkeypatch.setattr(blake3, "SPAN", 2048)
    monkeypatch.setattr(blake3, "GROUP", 4)
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in large.items()], "file_id long, content binary")
    held = spans.spans_of(spans.pieces_of(files, 3000, "file_id", "content"), 2048, 0, "file_id")
    assert {r.file_id: r.blake3 for r in blake3.large_hashes(held, "file_id").collect()} == whole


def test_rolling_counts_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(2).write.parquet(f"{tmp_path}/ev")
    stream = states.rolling_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev"), late="1000 days")
    query = stream.writeStream.format("memory").queryName("rolling").outputMode("update").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rolling").agg(F.sum("n")).first()[0] >= events.count()


def test_listing(spark, tmp_path):
    for name in ("a/b/c.txt", "a/.hidden/x", "top.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("hello")
    files = listing.scan(spark, f"file:{tmp_path}")
    assert {r.path for r in listing.listed(files).collect()} == {"a/b/c.txt", "top.txt"}
    assert [r.path for r in listing.listed(files, recursive=False).collect()] == ["top.txt"]
    assert listing.head(listing.scan(spark, f"file:{tmp_path}", True), 2).first()["head"] == b"he"


def test_commands(spark):
    lines = ["cp 'a b' c", "", "# note", "run x", 'ls "open', "du s3://b"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {r.line_no: (r.verb, r.arguments, r.status) for r in commands.parse_commands(df).collect()}
    assert got == {0: ("copy", ["a b", "c"], "ok"), 3: ("run", ["x"], "rejected"), 4: (None, None, "bad"), 5: ("du", ["s3://b"], "ok")}


def test_preserve_flags():
    assert scalars.parse_preserve("times, mode") == {"times", "permissions"}
    assert len(scalars.parse_preserve("all")) == 5
    with pytest.raises(ValueError):
        scalars.parse_preserve("nothing")
