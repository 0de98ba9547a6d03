"""Files and the partitioned store."""

import tempfile

import pytest
from pyspark.sql import functions as F

from trapline.session import shared_folder
from trapline.sources import files, store
from trapline.sources.lookups import RunConfig, chain_settings


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="trapline-test-")


def test_crlf_without_a_last_newline(spark, folder):
    path = f"{folder}/width.csv"
    with open(path, "w", newline="") as out:
        out.write("width,\r\n17.03,\r\n20.92,")
    assert [r.width for r in files.read_column(spark, path, "width").collect()] == [17.03, 20.92]


def test_na_is_null(spark, folder):
    path = f"{folder}/t.csv"
    with open(path, "w") as out:
        out.write("ind,sex\n5,M\nNA,NA\n")
    rows = files.read_table(spark, path, "ind BIGINT, sex STRING").collect()
    assert [tuple(r) for r in rows] == [(5, "M"), (None, None)]


def test_row_keys_of_a_file_read_in_many_ranges(spark, folder):
    path = f"{folder}/v.csv"
    with open(path, "w") as out:
        out.write("\n".join(str(float(i)) for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.with_row_key(files.read_vector(spark, path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3000 and all(r.row_key == r.v for r in rows)


def test_store_replaces_one_run_only(spark, folder):
    def table(species, x):
        return spark.createDataFrame([(species, x)], "species string, x int")
    store.save_derived({"t": table("CPIC", 1).union(table("SODO", 2))}, folder, "2020-05-01")
    store.save_derived({"t": table("CPIC", 9)}, folder, "2020-05-01")
    store.save_derived({"t": table("CPIC", 5)}, folder, "2020-05-23", testing=True)

    def load(*config):
        return [r.x for r in store.load_derived(spark, folder, "t", RunConfig(*config)).collect()]
    assert load("CPIC", "2020-05-01") == [9] and load("SODO", "2020-05-01") == [2]
    assert load("CPIC", "2020-05-23", True) == [5] and load("CPIC", "2020-05-23") == []


def test_a_killed_write_leaves_the_old_part(spark, folder, monkeypatch):
    """A write that dies, and one that dies between writing and publishing."""
    config = RunConfig("CPIC", "2020-05-01")
    rows = spark.range(1000).selectExpr("'CPIC' AS species", "id AS x")
    store.save_derived({"k": rows}, folder, config.run_date)
    held = store.load_derived(spark, folder, "k", config)

    def total():
        return store.load_derived(spark, folder, "k", config).agg(F.sum("x")).first()[0]

    broken = rows.repartition(4).withColumn("x", F.expr(
        "if(x = 999, raise_error('killed'), x + 1)"))
    with pytest.raises(Exception, match="killed"):
        store.save_derived({"k": broken}, folder, config.run_date)
    assert total() == 499_500

    def die(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as patch:
        patch.setattr(store.shared, "replace_file", die)
        with pytest.raises(KeyboardInterrupt):
            store.save_derived({"k": rows.withColumn("x", F.col("x") + 1)}, folder, config.run_date)
    assert total() == 499_500
    store.save_derived({"k": rows.withColumn("x", F.col("x") + 1)}, folder, config.run_date)
    # a reader that began before sees what it began with
    assert total() == 500_500 and held.agg(F.sum("x")).first()[0] == 499_500
    assert len(store.remove_unpublished(spark, folder, "k")) == 3
    assert total() == 500_500 and store.remove_unpublished(spark, folder, "k") == []


def test_odd_run_keys(spark, folder):
    rows = spark.createDataFrame([("a b/c,é", 1)], "species string, x int")
    store.save_derived({"odd": rows}, folder, "2020/05 01")
    assert [r.x for r in store.load_derived(spark, folder, "odd", RunConfig(
        "a b/c,é", "2020/05 01")).collect()] == [1]
    with pytest.raises(FileNotFoundError):
        store.load_derived(spark, folder, "none", RunConfig("CPIC", "x"))


def test_a_stored_order_is_verified(spark, folder):
    order = ["g", "k"]
    rows = spark.range(5000).selectExpr("id % 7 AS g", "if(id % 50 = 0, null, hash(id)) AS k",
                                        "id AS x").repartition(6)
    store.save_ordered(rows, f"{folder}/good", order)
    got = store.load_ordered(spark, f"{folder}/good", order).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5001))
    keys = [(r.g, r.k is not None, r.k or 0) for r in got]
    assert keys == sorted(keys)
    sorted_files = rows.repartition(3, "x").sortWithinPartitions(*order)
    for name, bad in (("shuffled", rows), ("overlapping", sorted_files)):
        bad.write.parquet(f"{folder}/{name}")
        with pytest.raises(ValueError, match="out of order"):
            store.load_ordered(spark, f"{folder}/{name}", order)


def test_store_prunes_partitions(spark, folder):
    rows = spark.range(4).select(F.lit("CPIC").alias("species"), "id")
    store.save_derived({"t": rows}, folder, "2020-05-01")
    plan = store.load_derived(spark, folder, "t", RunConfig("CPIC", "2020-05-01"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(species" in text


def test_run_settings():
    assert RunConfig("CPIC", "2020-05-23").cap == 7000
    assert RunConfig("CPIC", "2020-05-23", True).cap == 100
    assert chain_settings(RunConfig("SODO", "x")).every == 10
    assert chain_settings(RunConfig("CPIC", "x", True)).iterations == 700
    assert chain_settings(RunConfig("CPIC", "x")).iterations == 15000
    assert chain_settings(RunConfig("SODO", "x"), "compiled").every == 6
    assert chain_settings(RunConfig("CPIC", "x", True), "variable").burn == 1
    with pytest.raises(KeyError):
        chain_settings(RunConfig("CPIC", "x"), "unknown")


class Session:
    """Just enough of a session to ask for its shared folder."""

    def __init__(self, settings, master):
        self.master, self.settings, self.checkpoints = master, settings, None
        self.conf = self.sparkContext = self

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.checkpoints

    def setCheckpointDir(self, folder):
        self.checkpoints = folder


def test_shared_folder_is_taken_from_the_session():
    session = Session({"spark.checkpoint.dir": "hdfs://shared/cuts"}, "yarn")
    assert shared_folder(session) == session.checkpoints == "hdfs://shared/cuts"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_folder(Session({}, "yarn"))
