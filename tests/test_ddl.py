import pytest
from pyspark.sql import types as T

from ferrule.functions.typed import Refused
from ferrule.sources.ddl import Catalog, Definition, index, spark_type, with_hidden_key
from ferrule.streaming.versions import ChangeLog, tail


@pytest.mark.parametrize(
    "declared,expected",
    [
        ("INT", T.IntegerType()), ("int unsigned", T.LongType()), ("BIGINT UNSIGNED", T.DecimalType(20, 0)), ("DECIMAL(15,2)", T.DecimalType(15, 2)),
        ("decimal(60,2)", T.DecimalType(38, 2)), ("DATE", T.DateType()), ("DATETIME(6)", T.TimestampNTZType()), ("double", T.DoubleType()),
        ("float", T.FloatType()), ("varchar(20)", T.StringType()), ("varbinary(8)", T.BinaryType()), ("time", T.StringType()),
    ],
)
def test_types(declared, expected):
    assert spark_type(declared) == expected


def test_definitions(spark):
    c = Catalog(spark)
    d = Definition("t_ddl", {"id": "int", "v": "varchar(10)"}, ["id"])
    c.create(d)
    c.create(Definition("t_ddl", {"id": "int", "v": "varchar(10)"}, ["id"]))
    with pytest.raises(Refused):
        c.create(Definition("t_ddl", {"id": "bigint"}, ["id"]))
    with pytest.raises(Refused):
        Definition("x", {"a": "text"})
    with pytest.raises(Refused):
        Definition("x", {"a": "int"}, ["b"])
    with pytest.raises(Refused):
        spark_type("geometry")
    c.load("t_ddl", spark.createDataFrame([(1, "a")], "id int, v string"))
    assert spark.sql("select v from t_ddl where id = 1").first().v == "a"
    with pytest.raises(Refused):
        c.load("t_ddl", spark.createDataFrame([(1,)], "id long"))
    c.unload("t_ddl")


def test_hidden_keys_and_indexes(spark):
    rows = spark.range(100, numPartitions=5).selectExpr("id % 7 as g", "id")
    ids = [r.hidden_key for r in with_hidden_key(rows, 41).collect()]
    assert len(set(ids)) == 100 and min(ids) == 42
    assert [tuple(r) for r in index(rows, ["g"], ["id"], 3).collect()] == sorted((i % 7, i) for i in range(100))


def test_the_log_can_be_followed(spark, tmp_path):
    log = ChangeLog(spark, f"file://{tmp_path}/log", {"id": "int"}, {"v": "int"})
    for k in range(2):
        t = log.begin()
        log.insert(t, spark.createDataFrame([(k, k)], "id int, v int"))
        log.commit(t)
    q = tail(spark, log.path, log.schema).writeStream.format("memory").queryName("followed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.epoch, r.id) for r in spark.sql("select epoch, id from followed").collect()) == [(1, 0), (2, 1)]
