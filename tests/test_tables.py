"""Tables by a log of commits: crashes, writers side by side, files that are written and read; arrays of any layout; pruning."""

import json
import os
import random
import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom import tables
from logloom.jobs import w3
from logloom.operators.documents import find_events
from logloom.operators.query import compile_query, implied_filter, matches, parsed_query
from logloom.sources import arrays
from logloom.sources.documents import load_collection
from logloom.tables import DocumentTable

DOC = "database string, _id string, fields map<string,string>"


def docs(spark, rows):
    return spark.createDataFrame([(d, i, {k: str(v) for k, v in f.items()}) for d, i, f in rows], DOC).repartition(2)


def new(spark, database, values):
    return spark.createDataFrame([(database, {"k": str(v)}, n) for n, v in enumerate(values)], "database string, fields map<string,string>, n int")


def content(table, database=None):
    return sorted((r["database"], r["_id"], r["fields"]["k"]) for r in table.read(database).collect())


def files(root):
    return {str(p) for p in Path(root).rglob("*") if p.is_file()}


def test_insert_delete_and_what_is_written(spark, tmp_path):
    root = str(tmp_path / "t")
    table = DocumentTable(spark, root)
    assert table.read().count() == 0 and table.delete("a", "{}") == 0 and table.snapshot().version == 0
    assert table.load(docs(spark, [("a", "7", {"k": "x"}), ("a b/=%", "1", {"k": "y"}), ("a", "text", {"k": "z"})])) == 3
    assert table.insert(new(spark, "a", ["p", "q"]).unionByName(new(spark, "new", ["r"])), ("n",)) == 3
    assert content(table) == sorted([("a", "7", "x"), ("a b/=%", "1", "y"), ("a", "text", "z"), ("a", "8", "p"), ("a", "9", "q"), ("new", "1", "r")])
    before = files(f"{root}/data")
    assert table.delete("a", '{"k":"p"}') == 1
    rewritten = files(f"{root}/data") - before
    kept = [p for p in rewritten if p.endswith(".parquet") and not Path(p).name.startswith(".")]
    assert len(kept) <= 1 and all("database=a/" in p for p in kept)  # what else is in that one file
    assert table.delete("a", "{}") == 3 and table.delete("a", "{}") == 0
    assert content(table) == [("a b/=%", "1", "y"), ("new", "1", "r")]
    assert table.insert(new(spark, "a", ["s"]), ("n",)) == 1 and content(table, "a") == [("a", "10", "s")]  # an id is not given twice
    assert content(table, "none") == [] and table.read("a", version=1).count() == 2
    with pytest.raises(ValueError):
        table.snapshot(99)


@pytest.mark.parametrize("step", ["write", "publish"])
def test_crash_and_rerun(spark, tmp_path, monkeypatch, step):
    """A job that dies before or after its data is written changes nothing, and its rerun does it once."""
    root = str(tmp_path / "t")
    DocumentTable(spark, root).load(docs(spark, [("a", "1", {"k": "x"}), ("a", "2", {"k": "y"})]))
    requests = spark.createDataFrame([('{"database":"a","operation":"insert","data":[{"k":"1"},{"k":"2"}]}',)], "payload string")
    key = F.col("fields.k").cast("long")
    real = getattr(DocumentTable, f"_{step}")

    def dies(self, *args):
        if step == "write":
            real(self, *args)
        raise KeyboardInterrupt

    monkeypatch.setattr(DocumentTable, f"_{step}", dies)
    for _ in range(2):
        with pytest.raises(KeyboardInterrupt):
            w3.update(spark, root, requests, key, {"a": '{"k":"x"}'}, ("job", 3))
    monkeypatch.setattr(DocumentTable, f"_{step}", real)
    (tmp_path / "t" / "data" / "commit=half" / "_temporary").mkdir(parents=True)  # what a killed driver leaves
    assert w3.update(spark, root, requests, key, {"a": '{"k":"x"}'}, ("job", 3)) == {"inserted": 2, "deleted": 1, "version": 3}
    assert w3.update(spark, root, requests, key, {"a": '{"k":"x"}'}, ("job", 3)) == {"inserted": 2, "deleted": 1, "version": 3}  # nothing is done again
    assert content(DocumentTable(spark, root)) == [("a", "2", "y"), ("a", "3", "1"), ("a", "4", "2")]
    assert [r["_id"] for r in w3.search(spark, root, "a", '{"k":"2"}').collect()] == ["4"]


@pytest.mark.parametrize("mounted", [True, False])
def test_two_writers(spark, tmp_path, monkeypatch, mounted):
    """Whoever comes second works on what the first one left: no row is lost, no id given twice, no delete forgotten."""
    one, two = DocumentTable(spark, str(tmp_path / "t")), DocumentTable(spark, str(tmp_path / "t"))
    one._mounted = two._mounted = mounted
    one.load(docs(spark, [("a", "1", {"k": "x"}), ("b", "1", {"k": "x"})]))
    real, between = DocumentTable._publish, []

    def publish(self, version, entry):
        if between:
            between.pop()()
        real(self, version, entry)

    monkeypatch.setattr(DocumentTable, "_publish", publish)
    between.append(lambda: two.insert(new(spark, "a", ["two"]), ("n",)))
    assert one.insert(new(spark, "a", ["one"]), ("n",)) == 1
    assert content(one, "a") == [("a", "1", "x"), ("a", "2", "two"), ("a", "3", "one")]
    if not mounted:
        return
    between.append(lambda: two.insert(new(spark, "b", ["x", "y"]), ("n",)))
    assert one.delete("b", '{"k":"x"}') == 2 and content(one, "b") == [("b", "3", "y")]
    between.append(lambda: two.delete("a", '{"k":"x"}'))
    assert one.delete("a", '{"k":"one"}') == 1 and content(one, "a") == [("a", "2", "two")]
    between.append(lambda: two.insert(new(spark, "b", ["z"]), ("n",)))
    assert one.insert(new(spark, "a", ["last"]), ("n",)) == 1  # another database: the files stay as they are
    assert content(one) == [("a", "2", "two"), ("a", "4", "last"), ("b", "3", "y"), ("b", "4", "z")]


def test_whole_entries_compact_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "WHOLE_EVERY", 3)
    root = str(tmp_path / "t")
    table = DocumentTable(spark, root)
    for i in range(4):
        table.insert(new(spark, "a", [i]), ("n",), ("app", i))
    log = sorted(os.listdir(f"{root}/log"))
    for name in log[:2]:
        os.remove(f"{root}/log/{name}")  # what comes after a whole entry needs none before
    assert [r[2] for r in content(table)] == list("0123") and table.insert(new(spark, "a", [9]), ("n",), ("app", 2)) == 0
    assert table.compact("a") == 4 and table.compact("a") == 0 and len(table.snapshot().files) == 1
    assert table.vacuum(keep_versions=1, older_than_sec=0) == 8 and [r[2] for r in content(table)] == list("0123")
    assert len(os.listdir(f"{root}/data")) == len(os.listdir(f"{root}/index")) == 1


def files_read(df):
    """The metric of the scan that reads documents."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scans = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name == "FileSourceScanExec":
            scans.append(int(node.metrics().apply("numFiles").value()))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(scans)


def test_lookup_reads_one_file(spark, tmp_path):
    table = DocumentTable(spark, str(tmp_path / "t"), ("user",))
    table.load(docs(spark, [("d", f"id-{i}", {"k": i, "user": f" +0{i} " if i % 2 else f"u{i}"}) for i in range(40)]).repartitionByRange(10, "_id"))
    assert len(table.snapshot().of("d")) == 10
    assert table.get("d", "id-7").collect()[0]["fields"]["k"] == "7" and files_read(table.get("d", "id-7")) == 1
    for query, n in (('{"user":7}', 1), ('{"user":{"$in":["u4",9]},"k":{"$gt":5}}', 1), ('{"$or":[{"user":"u4"},{"_id":"id-5"}]}', 2), ('{"user":"none"}', 0), ('{"user":99999999999}', 0)):
        found = table.find("d", query)
        assert found.count() == n and files_read(found) <= (10 if "$or" in query else 2)
    assert files_read(table.find("d", '{"k":{"$gt":5}}')) == 10
    assert table.delete("d", '{"_id":"id-7"}') == 1 and table.get("d", "id-7").count() == 0
    assert table.find("d", '{"user":7}').count() == 0


QUERIES = [
    "{}", '{"t":"ab"}', '{"t":7}', '{"t":""}', '{"t":{"$eq":"ab c"}}', '{"t":{"$gt":"ab"}}', '{"t":{"$lt":"ab c"}}', '{"t":{"$gt":"a","$lt":"b"}}', '{"t":{"$lt":"a\\tc"}}', '{"t":{"$gt":5}}', '{"t":{"$in":["ab","x",""]}}', '{"t":{"$in":["ab",7]}}',
    '{"t":{"$like":"ab%"}}', '{"t":{"$like":"a_"}}', '{"t":{"$like":"%b"}}', '{"t":{"$eq":""}}', '{"t":{"$none":1}}', '{"$or":[{"t":"ab"},{"s":{"$gt":"b"}}]}', '{"$or":[{"t":"ab"},{"t":7}]}', '{"$or":[]}', '{"$and":[{"t":{"$gt":"a"}},{"s":"b"}]}', '{"$and":[]}',
    '{"t":"ab","s":{"$like":"b\\\\%"}}', '{"none":"x"}', '{"s":1,"$or":[{"t":"ab"}]}', '{"_id":"1"}', '{"t":true}', '{"t":[1]}', '{"t":99999999999}', '{"t":{"$in":[]}}', '{"t":{"$gt":"é"}}',
]


def values():
    rng = random.Random(8)
    made = ["".join(rng.choice("ab7+- \t\né!0") for _ in range(rng.randrange(6))) for _ in range(400)]
    return [None, "", " ", "ab", " ab", "ab \n", "ab\t", "+7", "07 ", "99999999999", "true", "[1]", "ab c", "ab\tc", "2025-12-01T10:00", *made]


def test_implied_and_plain_predicates(spark):
    """The weaker condition loses no match, and the predicate for queries that are data agrees with the compiled one."""
    rng = random.Random(1)
    rows = [(str(i), t, rng.choice(values()), (t or "")[:3]) for i, t in enumerate(values())]
    table = spark.createDataFrame(rows, "_id string, t string, s string, day string")
    known = {"t": F.col("t"), "s": F.col("s"), "_id": F.col("_id")}
    exact = [compile_query(q, lambda n: known.get(n, F.lit(None).cast("string"))) for q in QUERIES]
    weaker = [implied_filter(q, {"t": F.col("t"), "s": F.col("s")}, {"t": (F.col("day"), 3)}) for q in QUERIES]
    both = F.array(*[F.struct(e.alias("exact"), (F.lit(True) if w is None else F.coalesce(w, F.lit(False))).alias("weaker")) for e, w in zip(exact, weaker, strict=True)])
    got = {r["_id"]: r["both"] for r in table.select("_id", both.alias("both")).collect()}
    for i, t, s, _ in rows:
        fields = {k: v for k, v in (("t", t), ("s", s)) if v is not None}
        for query, found in zip(QUERIES, got[i], strict=True):
            assert found["exact"] == matches(parsed_query(query), fields, i), (query, t, s)
            assert found["weaker"] or not found["exact"], (query, t, s)
    assert sum(w is not None for w in weaker) > 10


def test_pushed_filters(spark, tmp_path):
    rows = [(f"2024-01-{d:02}T{h:02}:00:00.000Z", f"u{h}", f"2024-01-{d:02}") for d in range(1, 11) for h in range(24)] + [(" 2024-01-05T", "12", " 2024-01-0")]
    spark.createDataFrame(rows, "timestamp string, user string, event_date string").write.partitionBy("event_date").parquet(str(tmp_path / "e"))
    events = spark.read.schema("timestamp string, user string, event_date string").parquet(str(tmp_path / "e"))
    found = find_events(events, '{"timestamp":{"$gt":"2024-01-04T12","$lt":"2024-01-06"},"user":{"$like":"u1%"}}')
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: []" not in plan and "PartitionFilters: []" not in plan
    assert found.count() == sum("2024-01-04T12" < t.strip() < "2024-01-06" and u.startswith("u1") for t, u, _ in rows) and files_read(found) <= 5
    assert find_events(events, '{"timestamp":{"$gt":"2024-01-05T","$lt":"2024-01-05T0"},"user":12}').count() == 0
    assert find_events(events, '{"timestamp":"2024-01-05T","user":12}').count() == 1


def test_arrays_of_any_layout(spark, tmp_path):
    rng = random.Random(6)
    texts = ['a } "{', "\\", '\\"', "} ]", "é\n", "", "plain", '{"x":[1]}', "\\\\}"]
    objects = [{"_id": str(i), "t": rng.choice(texts), "n": i, "deep": {"a": [{"b": "}"}], "c": rng.choice(texts)}, "long": "x}" * rng.choice([0, 3, 400])} for i in range(60)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for indent in (None, 2):
            path = tmp_path / f"{indent!r}.json".replace("\\", "")
            path.write_text(json.dumps(objects, indent=indent, ensure_ascii=indent is None))
            for size in ("700", "100000"):
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                got = [json.loads(r["text"]) for r in arrays.read_objects(spark, str(path)).collect()]
                assert sorted(got, key=lambda o: o["n"]) == objects, (indent, size)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        loaded = load_collection(spark, str(tmp_path / "2.json"), "d", one_per_line=False)
        assert {r["_id"]: (r["fields"]["t"], json.loads(r["fields"]["deep"])) for r in loaded.collect()} == {o["_id"]: (o["t"], o["deep"]) for o in objects}
        assert spark.read.text(str(tmp_path / "2.json"), lineSep="}").rdd.getNumPartitions() > 5
        for i, text in enumerate(("", "[]", "[ ]\n", '[{"_id":"1"}]', '{"_id":"1"}')):
            (tmp_path / f"s{i}.json").write_text(text)
            assert arrays.read_objects(spark, str(tmp_path / f"s{i}.json")).count() == (1 if "_id" in text else 0)
        for i, text in enumerate(('[{"_id":"1"', '[{"a":"x}]', '[{"a":{"b":1}')):
            (tmp_path / f"torn{i}.json").write_text(text)
            with pytest.raises(ValueError):
                arrays.read_objects(spark, str(tmp_path / f"torn{i}.json"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    shutil.rmtree(tmp_path, ignore_errors=True)


def test_structure_of_bytes():
    data = np.frombuffer(b'{"a\\\\":{"b":"}\\"}"}}', dtype=np.uint8)
    depth, inside = arrays.structure(data, False)
    assert depth[-1] == 0 and depth.max() == 2 and not inside
    assert arrays.structure(np.frombuffer(b'x}"}', dtype=np.uint8), True)[0].tolist() == [0, 0, 0, -1]
