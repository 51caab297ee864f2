"""Leases, freed extractions and files of relationships."""

import json

import pytest

from codequarry.plans import pipeline
from codequarry.sources import stores
from codequarry.streaming.lease import Busy, Lease, LeaseLost, single_flight

PY = "class UserService:\n    def get(self):\n        return 1\n"


def test_one_run_at_a_time(spark, tmp_path):
    folder = str(tmp_path / "lease")
    with single_flight(spark, folder, "one") as held:
        with pytest.raises(Busy, match="one is running"), single_flight(spark, folder, "two"):
            raise AssertionError
        held.renew()
        assert held.state()["name"] == "one" and not held.state()["stale"]
    with pytest.raises(ValueError), single_flight(spark, folder, "three"):
        raise ValueError
    assert Lease(spark, folder).state()["holder"] is None


def test_a_dead_run_is_replaced_and_learns_of_it(spark, tmp_path):
    at = [1000.0]
    one, two = (Lease(spark, str(tmp_path / "lease"), 60, lambda: at[0]) for _ in range(2))
    assert one.take("one") is False
    at[0] = 1050
    one.renew()
    at[0] = 1105
    with pytest.raises(Busy):
        two.take("two")
    at[0] = 1111
    assert two.state()["stale"] and two.take("two") is True
    for late in (one.renew, one.give_back):
        with pytest.raises(LeaseLost):
            late()
    assert two.state()["name"] == "two"
    two.give_back()


def test_of_two_that_see_it_free_one_gets_it(spark, tmp_path):
    one, two = (Lease(spark, str(tmp_path / "lease")) for _ in range(2))
    seen = two.store.state()
    one.take("one")
    assert two.store.advance(seen, {"holder": two.holder}) is None


def test_extracted_frees_what_it_kept(spark):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    files = spark.createDataFrame([("r", "a.py", PY), ("r", "b.py", "def broken(:")], "repo string, path string, content string")
    with pipeline.extracted(files) as (kb, errors):
        assert [r.name for r in kb.services.collect()] == ["UserService"] and errors.count() == 1
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() > before
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_relationships_as_files(spark):
    rows = [("service_map", json.dumps({"n": k, "t": "x]: ["})) for k in range(50)] + [('odd "kind', "{}")]
    df = spark.createDataFrame(rows, "kind string, body string")
    (one,) = stores.relationship_files(df).collect()
    whole = json.loads(one.body)
    assert one.file == "context/relationships.json" and sorted(x["n"] for x in whole["service_map"]) == list(range(50)) and whole['odd "kind'] == [{}]
    many = stores.relationship_files(df, 300).collect()
    assert len(many) > 2 and all(f.file.startswith("context/relationships-0") for f in many)
    assert sorted(x["n"] for f in many for x in json.loads(f.body).get("service_map", [])) == list(range(50))
    assert stores.relationship_files(df.limit(0)).count() == 0
