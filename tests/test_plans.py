"""Plans: no cartesian products or nested loops, pushed filters, pruned columns; every query against its SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from folioworks.operators import archives, duplicates, review
from folioworks.plans import views as V
from folioworks.sources import logs

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all tables that a query writes on its way."""
    seen, writer = [], type(spark.range(1).write)
    kept = writer.parquet

    def noted(self, *args, **options):
        seen.append(plan_of(self._df))
        return kept(self, *args, **options)
    monkeypatch.setattr(writer, "parquet", noted)
    return seen


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_equals_its_sql(spark, db, plans, name):
    frame = E.queries()[name](spark, SF)
    for plan in [plan_of(frame), *plans]:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = [tuple(r) for r in frame.collect()]
    sql = E.oracle_sql().get(name)
    sql = sql and sql.replace("/root/testdata/sf0.01/", f"{SF}/")           # where it reads the table files themselves
    if sql is None:
        assert got
        return
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(got, frame.columns) == rows_of(cursor.fetchall(), columns)


def test_entry(spark):
    assert E.entry(spark).columns == ["batch_id", "files", "in_progress", "pending_review", "ready_to_add"]


def test_library_lookup_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "library")
    spark.createDataFrame([("o", "d", "t")], "organization_id string, document_id string, title string").write.parquet(path)
    plan = plan_of(review.get_document(spark.read.parquet(path), "o", "d").select("title"))
    assert "EqualTo(organization_id,o)" in plan and "EqualTo(document_id,d)" in plan


def test_status_filter_prunes_partitions(spark, tmp_path):
    from folioworks.operators.sweeps import stale_sweep
    from folioworks.sources.sinks import write_snapshot
    path = str(tmp_path / "files")
    files = spark.createDataFrame([("f", "processing", 1, 5, 5, None), ("g", "staged", 0, None, None, None)],
                                  "file_id string, status string, attempt_count int, heartbeat_us bigint, uploaded_us bigint, status_message string")
    write_snapshot(files, path, "status")
    plan = plan_of(stale_sweep(spark.read.parquet(path), 10 ** 9))
    assert re.search(r"PartitionFilters: \[[^\]]*processing", plan)


def test_archive_rules_shuffle_entries_once(spark):
    """Totals are partial sums; the rows themselves move once, by archive, for all windows and the final counts."""
    df = archives.archive_outcome(V.entries(spark, SF), V.ENTRY_ORDER, V.ENTRY_LIMITS)
    moved = [line for line in plan_of(df).splitlines() if "Exchange hashpartitioning(archive" in line]
    assert len(moved) <= 3 and all("hashpartitioning(archive" in line for line in plan_of(df).splitlines() if "Exchange hash" in line)


def test_duplicate_join_is_two_equi_joins(spark):
    docs = V.documents(spark, SF)
    plan = plan_of(duplicates.find_duplicate(V.candidates(docs), V.library(docs)))
    assert len(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", plan)) == 2


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(E.queries()["unknown_batches"](spark, SF))
    assert "o_totalprice" not in "".join(re.findall(r"ReadSchema: (.*)", plan))


def test_folder_depth_numbers_every_entry(spark):
    """the entry's place in its archive is part of the job."""
    rows = E.queries()["folder_depth"](spark, SF).collect()
    places = {}
    for row in rows:
        places.setdefault(row.archive, []).append(row.entry_pos)
    assert len(rows) == V.entries(spark, SF).count()
    assert all(sorted(found) == list(range(len(found))) for found in places.values())


def test_log_merge_keeps_every_line(spark):
    """the snapshots together hold all lines of files, not those that a filter leaves."""
    lines = logs.parse_lines(V.log_lines(V.events(spark, SF))).filter("file_id IS NOT NULL")
    key = ["file_id", "ts_us", "event", "pid"]
    merged = E.queries()["log_merge"](spark, SF)
    assert lines.select(*key).distinct().exceptAll(merged).isEmpty()
    assert merged.count() == lines.select(*key).distinct().count()
