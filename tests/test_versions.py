import pytest

from ferrule.streaming.versions import ChangeLog, Conflict, DuplicateKey


@pytest.fixture()
def log(spark, tmp_path):
    return ChangeLog(spark, f"file://{tmp_path}/log", {"id": "int"}, {"v": "int", "name": "string"}, unique=[["name"]])


def frame(spark, *rows):
    return spark.createDataFrame(rows, "id int, v int, name string")


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "v", "name").collect())


def test_commits_and_snapshots(spark, log):
    t = log.begin()
    log.insert(t, frame(spark, (1, 10, "a"), (2, 20, "b")))
    assert rows(log.view(t)) == [(1, 10, "a"), (2, 20, "b")]
    assert rows(log.read()) == []  # nobody else sees it
    first = log.commit(t)
    t = log.begin()
    log.update(t, frame(spark, (1, 11, "a")))
    log.delete(t, frame(spark, (2, 0, "")).select("id"))
    second = log.commit(t)
    assert rows(log.read()) == [(1, 11, "a")]
    assert rows(log.read(first)) == [(1, 10, "a"), (2, 20, "b")]
    assert log.checkpoint() == second
    assert rows(log.read()) == [(1, 11, "a")]
    t = log.begin()
    log.update(t, frame(spark, (3, 11, "a")), frame(spark, (1, 0, "")).select("id"))  # the key moves
    log.commit(t)
    assert rows(log.read()) == [(3, 11, "a")]


def test_duplicates(spark, log):
    t = log.begin()
    log.insert(t, frame(spark, (1, 10, "a")))
    log.commit(t)
    with pytest.raises(DuplicateKey):
        log.insert(log.begin(), frame(spark, (1, 0, "z")))
    t = log.begin()
    log.insert(t, frame(spark, (1, 0, "z"), (2, 5, "c")), ignore=True)
    log.commit(t)
    assert rows(log.read()) == [(1, 10, "a"), (2, 5, "c")]
    t = log.begin()
    log.insert(t, frame(spark, (1, 99, "y")), replace=True)
    log.commit(t)
    assert rows(log.read())[0] == (1, 99, "y")
    t = log.begin()
    log.insert(t, frame(spark, (7, 1, "y")))
    with pytest.raises(DuplicateKey):
        log.commit(t)
    assert len(rows(log.read())) == 2


def test_conflicts(spark, log):
    t = log.begin()
    log.insert(t, frame(spark, (1, 10, "a")))
    log.commit(t)
    reader, other = log.begin(), log.begin()
    reader.reads.append(spark.createDataFrame([(1, log.epoch()), (9, None)], "id int, tid long"))
    seen = spark.createDataFrame([tuple(r) for r in log.versions().where("id < 5").collect()], "id int, tid long")
    ranged = log.begin()
    ranged.ranges.append((seen, "id < 5"))
    log.update(reader, frame(spark, (1, 12, "a")))
    log.update(ranged, frame(spark, (1, 13, "a")))
    log.insert(other, frame(spark, (2, 1, "p"), (9, 1, "q")))
    log.commit(other)
    for t in (reader, ranged):  # a row that was not there, and a phantom
        with pytest.raises(Conflict):
            log.commit(t)
    assert rows(log.read())[0] == (1, 10, "a")


def test_epochs_are_published_once(spark, log):
    log._publish(frame(spark, (1, 1, "a")), "epoch-00000000000000000001")
    with pytest.raises(Conflict):
        log._publish(frame(spark, (1, 1, "a")), "epoch-00000000000000000001")


def test_duplicates_within_a_statement_and_a_transaction(spark, log):
    t = log.begin()
    with pytest.raises(DuplicateKey):
        log.insert(t, frame(spark, (1, 10, "a"), (1, 11, "b")))
    log.insert(t, frame(spark, (2, 10, "a")))
    with pytest.raises(DuplicateKey):
        log.insert(t, frame(spark, (2, 11, "b")))
    log.insert(t, frame(spark, (2, 11, "b"), (3, 5, "c"), (3, 4, "d")), ignore=True, order=["v"])
    assert rows(log.view(t)) == [(2, 10, "a"), (3, 4, "d")]
    log.delete(t, frame(spark, (2, 0, "")).select("id"))
    log.insert(t, frame(spark, (2, 12, "a")))  # gone, so it may come again
    log.insert(t, frame(spark, (3, 6, "x"), (3, 7, "y")), replace=True, order=["v"])
    log.commit(t)
    assert rows(log.read()) == [(2, 12, "a"), (3, 7, "y")]


def test_two_inserts_of_one_key_conflict(spark, log):
    a, b, c = log.begin(), log.begin(), log.begin()
    log.insert(a, frame(spark, (1, 10, "a")))
    log.insert(b, frame(spark, (1, 20, "b")))
    log.insert(c, frame(spark, (2, 30, "c")))
    log.commit(a)
    with pytest.raises(Conflict):
        log.commit(b)
    log.commit(c)
    assert rows(log.read()) == [(1, 10, "a"), (2, 30, "c")]


def test_on_duplicate_key_update(spark, log):
    t = log.begin()
    log.insert(t, frame(spark, (1, 10, "a")))
    log.commit(t)
    t = log.begin()
    add = lambda old, new: {"v": old["v"] + new["v"]}
    log.insert(t, frame(spark, (1, 1, "x"), (1, 2, "y"), (2, 5, "b"), (2, 6, "z"), (3, 7, "c")), update=add, order=["v"])
    assert rows(log.view(t)) == [(1, 13, "a"), (2, 11, "b"), (3, 7, "c")]
    log.commit(t)
    assert rows(log.read()) == [(1, 13, "a"), (2, 11, "b"), (3, 7, "c")]
    t = log.begin()
    log.insert(t, frame(spark, (4, 1, "a")))  # another row has that name
    with pytest.raises(DuplicateKey):
        log.commit(t)


def test_index_follows_commits(spark, log):
    t = log.begin()
    log.insert(t, frame(spark, (1, 10, "a"), (2, 20, "b"), (3, 20, "c")))
    log.commit(t)
    log.add_index("by_v", ["v"])
    from pyspark.sql import functions as F

    at = lambda v: rows(log.read_index("by_v", F.col("v") == v))
    assert at(20) == [(2, 20, "b"), (3, 20, "c")]
    t = log.begin()
    log.update(t, frame(spark, (2, 10, "b")))
    log.delete(t, frame(spark, (3, 0, "")).select("id"))
    log.insert(t, frame(spark, (1, 30, "a"), (4, 20, "d")), replace=True)
    log.commit(t)
    assert (at(10), at(20), at(30)) == ([(2, 10, "b")], [(4, 20, "d")], [(1, 30, "a")])
    log.drop_index("by_v")
    assert not log.indexes
