import pytest
from pyspark.sql import functions as F

from quarryline.sources.links import LinkTable
from quarryline.sources.sinks import replace_links
from quarryline.sources.store import Folder


def given(spark, *rows):
    return spark.createDataFrame(list(rows), "wizard_id long, ids array<long>")


def state(table):
    return {r["wizard_id"]: r["ids"] for r in table.sets().collect()}


def test_records_are_replaced_one_by_one(spark, tmp_path):
    t = LinkTable(spark, str(tmp_path / "l"), buckets=4)
    assert (t.version, state(t)) == (0, {})
    assert t.replace(given(spark, (1, [10, 11]), (2, [20]), (3, [30, 30, None]), (None, [9]))) == 1
    assert state(t) == {1: [10, 11], 2: [20], 3: [30]}
    before = t.links()
    assert t.replace(given(spark, (2, [21, 22]), (4, [40]), (3, []), (1, None), (5, [50]), (5, [51]))) == 2
    assert state(t) == {1: [10, 11], 2: [21, 22], 4: [40], 5: [50, 51]}
    assert sorted(tuple(r) for r in before.collect()) == [(1, 10), (1, 11), (2, 20), (3, 30)]  # a reader of the old version
    assert t.replace(given(spark, (1, None))) == 2  # nothing to do
    t.vacuum()
    again = LinkTable(spark, str(tmp_path / "l"), buckets=99)
    assert (again.buckets, again.version, state(again)) == (4, 2, {1: [10, 11], 2: [21, 22], 4: [40], 5: [50, 51]})
    again.replace(given(spark, *((k, []) for k in (1, 2, 4, 5))))
    assert state(again) == {}
    again.replace(given(spark, (7, [1])))
    assert state(again) == {7: [1]}


def test_a_failed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    t = LinkTable(spark, str(tmp_path / "l"), buckets=2)
    t.replace(given(spark, (1, [10]), (2, [20])))
    was = t.folder.names()
    broken = given(spark, (1, [11]), (3, [30])).withColumn("ids", F.when(F.col("wizard_id") == 3, F.raise_error(F.lit("lost")).cast("array<long>")).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="lost"):
        t.replace(broken)
    assert state(t) == {1: [10], 2: [20]} and t.folder.names() == was
    # Files are there, but the driver dies before the manifest is.
    monkeypatch.setattr(Folder, "commit_json", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        t.replace(given(spark, (1, [11])))
    assert state(t) == {1: [10], 2: [20]} and t.folder.names() == was


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    t, other = (LinkTable(spark, str(tmp_path / "l"), buckets=2) for _ in range(2))
    t.replace(given(spark, (1, [10])))
    commit = Folder.commit_json

    def late(self, name, value):
        monkeypatch.setattr(Folder, "commit_json", commit)
        other.replace(given(spark, (1, [12])))
        commit(self, name, value)

    monkeypatch.setattr(Folder, "commit_json", late)
    with pytest.raises(FileExistsError):
        t.replace(given(spark, (1, [11])))
    assert (t.version, state(t)) == (2, {1: [12]})


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = LinkTable(spark, str(tmp_path / "l"), buckets=16)
    t.replace(spark.range(1000).select(F.col("id").alias("wizard_id"), F.array("id").alias("ids")))
    first = t._manifest()[1]["folders"]
    t.replace(given(spark, (5, [1, 2])))
    second = t._manifest()[1]["folders"]
    assert len(first) == 16 and sum(first[b] != second[b] for b in first) == 1


def test_hot_record(spark, tmp_path):
    many = spark.range(5000).select(F.lit(1).alias("wizard_id"), F.array("id").alias("ids"))
    replace_links(many, str(tmp_path / "l"))
    replace_links(given(spark, (2, [3])), str(tmp_path / "l"))
    assert {k: len(v) for k, v in state(LinkTable(spark, str(tmp_path / "l"))).items()} == {1: 5000, 2: 1}
