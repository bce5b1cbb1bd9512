"""Logs in order, against plain simulators."""

import random

import pytest

from treelake.operators import cluster
from treelake.schema import code, op
from treelake.streaming import replay, windows

REQUEST = "event_id bigint, opcode int, dir string, name string"


def random_log(seed: int, n: int, start: int) -> list[tuple]:
    """Requests on three directories of the seed, with three names each."""
    rng = random.Random(seed)
    ops = [op("MKDIR"), op("CREATE"), op("CREATE"), op("UNLINK"), op("OPEN"), op("STAT")]
    return [(start + i, rng.choice(ops), f"s{seed}d{rng.randrange(3)}", f"f{rng.randrange(3)}") for i in range(n)]


def simulate(log: list[tuple]) -> dict[int, int]:
    dirs, files, out = set(), set(), {}
    for seq, kind, where, name in sorted(log):
        if kind == op("MKDIR"):
            out[seq] = code("PATH_EXISTS") if where in dirs else 0
            dirs.add(where)
        elif where not in dirs:
            out[seq] = code("PATH_IS_INVALID")
        elif kind == op("CREATE"):
            out[seq] = code("FILE_EXISTS") if (where, name) in files else 0
            files.add((where, name))
        else:
            out[seq] = 0 if (where, name) in files else code("FILE_NOT_EXISTS")
            if kind == op("UNLINK"):
                files.discard((where, name))
    return out


def test_random_logs(spark):
    log = [row for seed in range(200) for row in random_log(seed, 40, seed * 40)]
    random.Random(0).shuffle(log)
    rows = replay.replay(spark.createDataFrame([], replay.DIRECTORIES), spark.createDataFrame([], replay.FILES), spark.createDataFrame(log, REQUEST))[0]
    assert {r.event_id: r.error_code for r in rows.collect()} == simulate(log)


def test_stream_in_batches(spark, tmp_path, monkeypatch):
    """Five files are five batches; the state crosses them, and a whole state is written at the third."""
    monkeypatch.setattr(replay, "WHOLE", 2)
    log = random_log(7, 150, 0)
    for i in range(5):
        spark.createDataFrame(log[i * 30 : i * 30 + 30], REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    rows = replay.replay_stream(stream).collect()
    assert {r.event_id: r.error_code for r in rows} == simulate(log)


def test_nulls_and_nothing(spark):
    empty = spark.createDataFrame([], REQUEST)
    state = spark.createDataFrame([("a", 0)], replay.DIRECTORIES), spark.createDataFrame([("a", "f", True)], replay.FILES)
    assert replay.replay(*state, empty)[0].count() == 0
    log = [(1, op("CREATE"), None, "f"), (2, op("CREATE"), "a", None), (3, op("CREATE"), "a", "f"), (4, op("MKDIR"), "a", None)]
    rows = replay.replay(*state, spark.createDataFrame(log, REQUEST))[0].collect()
    bad = code("PATH_IS_INVALID")
    assert {r.event_id: r.error_code for r in rows} == {1: bad, 2: bad, 3: code("FILE_EXISTS"), 4: code("PATH_EXISTS")}


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_open_handles(spark, monkeypatch, block):
    monkeypatch.setattr(windows, "HANDLE_BLOCK", block)
    rng = random.Random(block)
    log = [(i, rng.randrange(4), rng.choice([6, 5, 5, 4])) for i in range(400)]
    wanted = {}
    for _, client, kind in log:
        opened, now, peak = wanted.get(client, (0, 0, 0))
        now = max(now + {6: 1, 5: -1}.get(kind, 0), 0)
        wanted[client] = (opened + (kind == 6), now, max(peak, now))
    rows = windows.open_handles(spark.createDataFrame(log, "event_id bigint, client bigint, opcode int"), 6, 5).collect()
    assert {r.client: (r.opened, r.still_open, r.peak) for r in rows} == wanted


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_adjust_wait(spark, block):
    rng = random.Random(block)
    log = [(i % 3, i, rng.randrange(40)) for i in range(300)]
    wanted = {0: 1, 1: 1, 2: 1}
    for pool, _, load in log:
        wanted[pool] = min(wanted[pool] * 2, 64) if load <= 20 else max(wanted[pool] // 2, 1)
    rows = cluster.adjust_wait(spark.createDataFrame(log, "pool int, seq bigint, load bigint"), batch=10, top=64, block=block).collect()
    assert {r.pool: r.wait for r in rows} == wanted


def test_coalesce_writes(spark):
    """Runs, a full buffer, a gap, a write with no start, and a key that is null."""
    writes = [("a", 1, 0, 4), ("a", 2, 4, 4), ("a", 3, 8, 4), ("a", 4, 20, 2), ("a", 5, None, 3), ("a", 6, 22, 2), (None, 1, 5, 1), (None, 2, 6, 20)]
    rows = cluster.coalesce_writes(spark.createDataFrame(writes, "file string, seq bigint, start bigint, size bigint"), "file", limit=10).collect()
    assert {(r.file, r.flush): (r.start, r.bytes) for r in rows} == {
        ("a", 0): (0, 8), ("a", 1): (8, 4), ("a", 2): (20, 2), ("a", 3): (None, 3), ("a", 4): (22, 2), (None, 0): (5, 1), (None, 1): (6, 20),
    }
