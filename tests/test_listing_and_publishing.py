"""Listing by tasks against a plain walk; commits to several tables are seen all at once or not at all."""

import os

import pytest

from folioworks.sources import objects as O
from folioworks.sources import sinks


def test_listing_equals_a_walk(spark, tmp_path):
    want = {}
    for k in range(300):
        folder = tmp_path / f"a{k % 7}" / ("deep/er" if k % 3 else "") / f"b{k % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        path = folder / f"{k}.{'bin' if k % 2 else 'txt'}"
        path.write_bytes(b"x" * k)
        want[f"file:{path}"] = k
    (tmp_path / "empty").mkdir()
    (tmp_path / "a0/sp ace.bin").write_bytes(b"1")
    want[f"file:{tmp_path}/a0/sp ace.bin"] = 1
    for prefix in (str(tmp_path), f"file:{tmp_path}"):
        rows = O.list_objects(spark, prefix).collect()
        assert {r.path: r.length for r in rows} == want and len(rows) == len(want)
    got = {r.path for r in O.list_objects(spark, str(tmp_path), "*.bin").collect()}
    assert got == {p for p in want if p.endswith(".bin")}
    one = O.list_objects(spark, f"{tmp_path}/a0/sp ace.bin").collect()
    assert len(one) == 1 and one[0].length == 1
    hashed = O.hash_objects(O.list_objects(spark, str(tmp_path / "a1")))
    assert hashed.filter("failure is not null").count() == 0 and hashed.count() == len([p for p in want if "/a1/" in p])


def test_listing_of_many_objects_stays_out_of_the_driver(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"d{k}").mkdir()
        for n in range(500):
            open(tmp_path / f"d{k}/{n}", "w").close()
    found = O.list_objects(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "FileScan parquet" in plan         # a written table, not rows held by the driver
    assert found.count() == 20_000 == found.select("path").distinct().count()


def test_a_missing_prefix_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere|No such file|not exist"):
        O.list_objects(spark, str(tmp_path / "nowhere")).collect()


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    def rows(*ids):
        return spark.createDataFrame([(i,) for i in ids], "id int")
    assert sinks.published(spark, root, "library").count() == 0
    sinks.publish({"library": rows(1, 2), "audit": rows(10)}, root, "c1")
    kept = sinks.write_commit

    def stops(table_rows, table, commit_id):
        if table.endswith(sinks.MARKERS):
            raise RuntimeError("stopped")
        kept(table_rows, table, commit_id)
    monkeypatch.setattr(sinks, "write_commit", stops)
    with pytest.raises(RuntimeError):
        sinks.publish({"library": rows(3), "audit": rows(11)}, root, "c2")
    monkeypatch.setattr(sinks, "write_commit", kept)
    assert os.path.isdir(f"{root}/library/commit_id=c2")                        # written, not seen
    assert sorted(r.id for r in sinks.published(spark, root, "library").collect()) == [1, 2]
    assert sorted(r.id for r in sinks.published(spark, root, "audit").collect()) == [10]
    for _ in range(2):
        sinks.publish({"library": rows(3), "audit": rows(11)}, root, "c2")
        assert sorted((r.id, r.commit_id) for r in sinks.published(spark, root, "library").collect()) == [(1, "c1"), (2, "c1"), (3, "c2")]
        assert sorted(r.id for r in sinks.published(spark, root, "audit").collect()) == [10, 11]
