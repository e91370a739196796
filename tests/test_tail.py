"""Tails by byte offset: blocks, restarts, rotation, truncation; and line numbers over rolled files."""

import os
import random

import pytest

from logloom.jobs.w1 import run as run_w1
from logloom.operators.audit import merge_audit
from logloom.operators.filters import dedupe_consecutive
from logloom.operators.parsers import parse_shell_history
from logloom.schemas import FilterSettings
from logloom.sources import tail
from logloom.sources.lines import read_lines, read_rolled, stream_lines


@pytest.fixture
def place(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path


def reader(place, path="logs", **options):
    return tail.TailReader({"path": str(place / path), "state": str(place / "state"), **options})


def read(r, start, end):
    """Rows between two offsets, block by block."""
    rows = [row for p in r.partitions(start, end) for b in r.read(p) for row in b.to_pylist()]
    return [r["value"] for r in sorted(rows, key=lambda r: (r["file_order"], r["offset"]))]


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 5000])
def test_blocks_give_every_line_once(place, block, monkeypatch):
    monkeypatch.setattr(tail, "CHUNK", 5)
    rng = random.Random(block)
    lines = ["".join(rng.choice("ab é\r") for _ in range(rng.choice([0, 0, 1, 3, 40]))) for _ in range(200)]
    (place / "logs" / "a.log").write_text("\n".join(lines) + "\nopen end", newline="")
    r = reader(place, blockBytes=str(block), fromBegin="true")
    assert read(r, r.initialOffset(), r.latestOffset()) == lines
    starts = [x for p in r.partitions(r.initialOffset(), r.latestOffset()) for b in r.read(p) for x in b["offset"].to_pylist()]
    assert starts == sorted(set(starts)) and len(starts) == len(lines)


def test_start_at_the_end_and_complete_lines(place):
    log = place / "logs" / "a.log"
    log.write_text("old\nhalf")
    r = reader(place)
    start = r.initialOffset()
    assert r.latestOffset() == start
    append(log, " done\nnext")
    end = reader(place).latestOffset()
    assert read(reader(place), start, end) == ["half done"]
    append(log, "\n")
    assert read(r, end, r.latestOffset()) == ["next"]
    assert read(r, start, r.latestOffset()) == ["half done", "next"]  # as after a restart from an older offset


def test_rotation_renames_and_truncation(place):
    log, old = place / "logs" / "a.log", place / "logs" / "a.log.1"
    log.write_text("one\n")
    r = reader(place, "logs/a.log", fromBegin="true")
    at = r.latestOffset()
    assert read(r, r.initialOffset(), at) == ["one"]
    append(log, "two\n")
    log.rename(old)
    append(old, "three\n")
    log.write_text("four\n")
    end = r.latestOffset()
    assert read(r, at, end) == ["two", "three", "four"]
    parts = r.partitions(at, end)
    old.rename(place / "logs" / "a.log.2")  # between planning and reading
    assert sorted(v for p in parts for b in r.read(p) for v in b["value"].to_pylist()) == ["four", "three", "two"]
    log.write_text("5\n")  # cut and written again
    later = r.latestOffset()
    assert read(r, end, later) == ["5"]
    log.write_text("other text of more bytes than before\n")  # longer, but not the same beginning
    assert read(r, later, r.latestOffset()) == ["other text of more bytes than before"]
    (place / "logs" / "a.log.3.gz").write_text("packed\n")
    assert r.latestOffset() == reader(place, "logs/a.log").latestOffset()


def test_files_that_are_gone(place):
    log, other = place / "logs" / "a.log", place / "logs" / "b.log"
    log.write_text("one\n")
    other.write_text("x\n")
    r = reader(place, fromBegin="true")
    start, end = r.initialOffset(), r.latestOffset()
    other.unlink()
    with pytest.raises(RuntimeError, match="failOnDataLoss"):
        read(r, start, end)
    assert read(reader(place, failOnDataLoss="false"), start, end) == ["one"]
    r.latestOffset()
    r.commit(end)
    assert list(r.latestOffset()["at"]) == ["0"]
    other.write_text("new\n")
    assert read(r, end, r.latestOffset()) == ["new"]
    order = {f["path"]: f["order"] for f in tail.State(str(place / "state")).files.values()}
    assert order[str(other)] == 2  # no number is given twice


def test_state_survives_a_crash(place):
    (place / "logs" / "a.log").write_text("one\n")
    r = reader(place, fromBegin="true")
    r.initialOffset()
    (place / "state" / "tail.json.new").write_text("{half")
    assert read(reader(place), {"at": {}}, reader(place).latestOffset()) == ["one"]


def test_which_files(place):
    for name in ("host=a/x.log", "host=b/x.log", "host=b/y.txt", "host=b/_SUCCESS", "host=b/.x.crc", "host=b/_temporary/z.log", "other/x.log", "x.log.gz", "w[1].log"):
        (place / "logs" / name).parent.mkdir(parents=True, exist_ok=True)
        (place / "logs" / name).write_text("1\n")
    listed = lambda pattern: [os.path.relpath(p, place / "logs") for p in tail.Posix().listed(str(place / "logs") + pattern)]
    assert listed("") == ["host=a/x.log", "host=b/x.log", "host=b/y.txt", "other/x.log", "w[1].log"]
    assert listed("/host=*") == ["host=a/x.log", "host=b/x.log", "host=b/y.txt"] and listed("/host=*/x.log") == ["host=a/x.log", "host=b/x.log"]
    assert listed("/w[1].log") == ["w[1].log"] and listed("/none") == listed("/host=b/_SUCCESS") == []


def test_store_paths(place):
    """Files of a store are known by path; here a local one."""
    (place / "logs" / "host=a").mkdir()
    (place / "logs" / "host=a" / "x.log").write_text("one\ntwo\n")
    files = tail.Store(f"file://{place}/logs")
    assert [os.path.basename(p) for p in files.listed("")] == ["x.log"]
    (path,) = files.listed("")
    assert files.size(path) == 8 and files.identity(path) == path and tail._complete(files, path, 0, 8) == 8


def test_stream_over_restarts(spark, place):
    logs, out = place / "logs", str(place / "out")
    (logs / "a.log").write_text("before\n")

    def run():
        lines = stream_lines(spark, "bash_history", str(logs), str(place / "tail"), "h", blockBytes="6")
        lines.select("line", "seq").writeStream.format("parquet").option("checkpointLocation", str(place / "ck")).trigger(availableNow=True).start(out).awaitTermination(120)
        return [r["line"] for r in spark.read.schema("line string, seq long").parquet(out).orderBy("seq").collect()]

    assert run() == []
    append(logs / "a.log", "one\r\n" + "long " * 50 + "\n")
    assert run() == ["one", "long " * 50]
    (logs / "a.log").rename(logs / "a.log.1")
    append(logs / "a.log.1", "last of the old\n")
    (logs / "a.log").write_text("first of the new\n")
    assert run() == ["one", "long " * 50, "last of the old", "first of the new"]
    assert run() == ["one", "long " * 50, "last of the old", "first of the new"]


def rolled(folder, lines, cuts):
    folder.mkdir()
    bounds = [0, *cuts, len(lines)]
    names = [f"a.log.{n}" for n in range(len(cuts), 0, -1)] + ["a.log"]
    for i, (name, a, b) in enumerate(zip(names, bounds, bounds[1:])):
        (folder / name).write_text("".join(x + "\n" for x in lines[a:b]))
        os.utime(folder / name, (1_700_000_000 + i // 2, 1_700_000_000 + i // 2))  # equal times: the rotation's number decides


def record(kind, serial, rest):
    return f"type={kind} msg=audit(1700000000.000:{serial}): {rest}"


def test_rolled_files_equal_one_file(spark, tmp_path):
    rng = random.Random(3)
    history = [rng.choice(["ls", "cd", "pwd"]) for _ in range(400)]
    audit = [record(k, s, f'comm="{k}{s}"') for s in range(60) for k in rng.sample(["AVC", "SYSCALL", "PROCTITLE", "PROCTITLE"], 4)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name, lines in (("history", history), ("audit", audit)):
            rolled(tmp_path / name, lines, [101, 202, 203])
            rolled(tmp_path / f"{name}-one", lines, [])
            rows = read_rolled(spark, "auditd", str(tmp_path / name), "h").select("seq", "line").orderBy("seq").collect()
            assert [tuple(r) for r in rows] == list(enumerate(lines))
            assert read_rolled(spark, "auditd", str(tmp_path / name), "h").rdd.getNumPartitions() > 4
        shell = [sorted(r["seq"] for r in dedupe_consecutive(parse_shell_history(read_rolled(spark, "bash_history", str(tmp_path / f), "h"))).collect()) for f in ("history", "history-one")]
        assert shell[0] == shell[1] == [i for i, c in enumerate(history) if not i or history[i - 1] != c]
        merged = [sorted(r["raw_log"] for r in merge_audit(read_rolled(spark, "auditd", str(tmp_path / f), "h"), "eager").collect()) for f in ("audit", "audit-one")]
        assert merged[0] == merged[1]
        events = []
        for kind in ("", "-one"):
            out = str(tmp_path / f"out{kind}")
            run_w1(spark, {"auditd": str(tmp_path / f"audit{kind}"), "bash_history": str(tmp_path / f"history{kind}")}, out, FilterSettings(dedupe_bash_history=True), "h", "me", "eager")
            events.append(sorted((r["source"], r["raw_log"]) for r in spark.read.parquet(out).collect()))
        assert events[0] == events[1] and len(events[0]) == len(shell[0]) + len(merged[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rolled_folders_are_apart(spark, tmp_path):
    for host in "ab":
        (tmp_path / f"host={host}").mkdir()
        (tmp_path / f"host={host}" / "x.log").write_text("1\n2\n")
    rows = read_rolled(spark, "auth", str(tmp_path / "*"), None).select("seq").collect()
    assert sorted(r["seq"] for r in rows) == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        read_rolled(spark, "none", str(tmp_path))
    assert read_lines(spark, "auth", str(tmp_path / "*")).count() == 4
