"""Query language and document tables."""

import pytest
from pyspark.sql import functions as F

from logloom.operators import documents as docs
from logloom.operators.query import compile_query
from logloom.schemas import DOC
from logloom.sources import documents as io


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("d", "1", {"name": "Alice", "age": "25"}), ("d", "2", {"name": "Bob", "age": "9"}), ("d", "3", {"name": "Carl", "age": "x"})], DOC)


CASES = {
    "{}": "123",
    "": "123",
    '{"age":{"$gt":20}}': "13",
    '{"age":{"$lt":20}}': "2",
    '{"age":"+25"}': "1",
    '{"name":{"$like":"%l%"}}': "13",
    '{"_id":{"$in":[1,"3"]}}': "13",
    '{"_id":{"$in":[]}}': "",
    '{"age":{"$gt":5,"$lt":10}}': "2",
    '{"$or":[{"name":"Bob"},{"age":25}]}': "12",
    '{"$and":[{"name":{"$like":"_o_"}},{"age":9}]}': "2",
    '{"name":"Bob","$or":[{"age":9}]}': "",
    '{"$or":[{"name":"Bob"}],"name":"Carl"}': "2",
    '{"$or":[]}': "",
    '{"age":{"$eq":""}}': "",
    '{"age":{"$gt":99999999999}}': "3",
    '{"city":"X"}': "",
    '{"name":"Bob","name":"Carl"}': "",
    '{"age":{"$none":1}}': "",
}


@pytest.mark.parametrize("query", CASES)
def test_find(people, query):
    assert "".join(sorted(r["_id"] for r in docs.find(people, query).collect())) == CASES[query]
    kept, n = docs.delete(people, query)
    assert kept.count() + n.first()[0] == 3 and docs.find_count(people, query).first()[0] == n.first()[0]


@pytest.mark.parametrize("query", ["[", "[1]", '{"$or":1}', '{"a":{"$in":1}}'])
def test_malformed(query):
    with pytest.raises(ValueError):
        compile_query(query)


def test_like_has_no_escape(spark):
    rows = spark.createDataFrame([("d", "1", {"a": "x\\%y"}), ("d", "2", {"a": "x%y"}), ("d", "3", {"a": "x\nzz"})], DOC)
    assert [r["_id"] for r in docs.find(rows, '{"a":{"$like":"x\\\\%"}}').collect()] == ["1"]
    assert sorted(r["_id"] for r in docs.find(rows, '{"a":{"$like":"x%"}}').collect()) == ["1", "2", "3"]


def test_insert_upsert_get(spark, people):
    new = spark.createDataFrame([("d", {"k": str(i)}, i) for i in range(50)], "database string, fields map<string,string>, i int").repartition(7)
    out = docs.insert(people, new, ("i",))
    assert sorted((int(r["_id"]), r["fields"]["k"]) for r in out.where("_id > 3 or length(_id) > 1").collect()) == [(i + 4, str(i)) for i in range(50)]
    changes = spark.createDataFrame([("d", " 2", {"name": "B1"}, 1), ("d", "2", {"name": "B2"}, 2), ("d", "9", {"name": "N"}, 1)], DOC + ", seq long")
    got = {r["_id"]: r["fields"]["name"] for r in docs.upsert(people, changes).collect()}
    assert got == {"1": "Alice", "2": "B2", "3": "Carl", "9": "N"}
    assert docs.get(people, "2").count() == 1
    assert docs.insert(people.limit(0), new.limit(0), ("i",)).count() == 0


def test_parse_and_collections(spark, people, tmp_path):
    text = spark.createDataFrame([('{"_id":1,"a":2.5,"a":true,"n":{"x":1}}',), ('{"a":1}',), ('{"_id":""}',), ("junk",)], "j string")
    (row,) = docs.parse_documents(text, "j").collect()
    assert row["_id"] == "1" and row["fields"]["a"] == "true" and row["fields"]["n"] == '{"x":1}'
    path = tmp_path / "c.json"
    path.write_text('[\n{"_id":"1","a":"x, {y}"},\n{"_id":"2","a":"\\"q\\""}\n]')
    for one in (True, False):
        got = {r["_id"]: r["fields"]["a"] for r in io.load_collection(spark, str(path), "d", one).collect()}
        assert got == {"1": "x, {y}", "2": '"q"'}
    io.save_collection(people, str(tmp_path / "v1"))
    assert io.read_collection(spark, str(tmp_path / "v1"), "d").count() == 3 and io.read_collection(spark, str(tmp_path / "v1"), "e").count() == 0


def test_payloads(spark, tmp_path):
    from logloom.operators.parsers import parse_auth
    from tests.test_events import lines

    events = parse_auth(lines(spark, [f'sshd: Failed password for u{i} from 1.2.3.{i} port 1 "q"' for i in range(23)]))
    made = io.insert_payloads(events, "mydb", 5)
    assert made.count() == 5
    made.select("payload").write.text(str(tmp_path / "q"))
    back = io.read_payloads(spark, str(tmp_path / "q"))
    assert sorted(r["fields"]["ip"] for r in back.collect()) == sorted(f"1.2.3.{i}" for i in range(23))
    single = spark.createDataFrame([('{"database":"d","operation":"insert","data":{"a":1},"query":{}}',)], "payload string")
    assert io.expand_payloads(single).first()["fields"] == {"a": "1"}
    doc = io.to_json_lines(io.to_event_docs(events, "me")).first()["value"]
    assert '"agent_id":"me"' in doc and '"command"' not in doc


def test_databases_are_apart(spark):
    rows = spark.createDataFrame([("a", "41", {"k": "1"}), ("b", "1", {"k": "2"}), ("a", "1", {"k": "3"}), ("a", " 1", {"k": "4"})], DOC)
    new = spark.createDataFrame([(d, {"n": str(i)}, i) for i, d in enumerate("abcab")] + [("a", None, 9)], "database string, fields map<string,string>, i int")
    made = {(r["database"], r["_id"]) for r in docs.insert(rows, new, ("i",)).where("fields['n'] is not null").collect()}
    assert made == {("a", "42"), ("a", "43"), ("b", "2"), ("b", "3"), ("c", "1")}
    changes = spark.createDataFrame([("a", "1 ", {"k": "new"}, 1)], DOC + ", seq long")
    got = {(r["database"], r["_id"]): r["fields"]["k"] for r in docs.upsert(rows, changes).collect()}
    assert got == {("a", "41"): "1", ("b", "1"): "2", ("a", "1"): "new"}
    assert docs.upsert(rows, changes.limit(0)).count() == 3
