"""A cursor source and a sink by epochs, as streams that are started again, read twice, or fail."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomspark.sources import connectors

SCHEMA = "id long, name string"


def put(path, ids):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE IF NOT EXISTS products (id INTEGER PRIMARY KEY, name TEXT)")
    db.executemany("INSERT INTO products VALUES (?, ?)", [(i, f"p{i}") for i in ids])
    db.commit()
    db.close()


def run(out, folder, sink="epoch_files"):
    query = out.writeStream.format(sink).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(90)


def test_restarted_stream_reads_each_row_once(spark, tmp_path):
    db = str(tmp_path / "db")
    spark.dataSource.register(connectors.SqlPages)
    spark.dataSource.register(connectors.EpochFiles)
    read = lambda: spark.readStream.format("sql_pages").schema(SCHEMA).option("database", db).option("query", "select * from products").option("cursor", "id").option("batch", "7").option("partitions", "3").load()
    put(db, range(1, 51))
    run(read(), tmp_path)
    put(db, range(60, 75))
    run(read(), tmp_path)
    run(read(), tmp_path)  # nothing new
    got = sorted((r.id, r.name) for r in connectors.committed(spark, f"{tmp_path}/out", SCHEMA).collect())
    assert got == [(i, f"p{i}") for i in [*range(1, 51), *range(60, 75)]]
    assert len(os.listdir(tmp_path / "out" / "epochs")) == 2


def test_offsets_ranges_and_rate(tmp_path):
    db = str(tmp_path / "db")
    put(db, [1, 2, 5, 8, 9, 20, 21, 40])
    options = {"database": db, "query": "select * from products", "cursor": "id", "batch": "2", "rows": "3", "partitions": "2"}
    s = connectors.SqlPagesStream(["id", "name"], options)
    start, seen = s.initialOffset(), []
    while True:
        end = s.latestOffset()
        if end == start:
            break
        ranges = s.partitions(start, end)
        rows = [r[0] for p in ranges for r in s.read(p)]
        assert rows == [r[0] for p in s.partitions(start, end) for r in s.read(p)] and len(rows) <= 3 and len(ranges) <= 2
        seen += rows
        start = end
    assert seen == [1, 2, 5, 8, 9, 20, 21, 40]
    fresh = connectors.SqlPagesStream(["id"], options)  # as after a restart: nothing is known but what Spark hands over
    assert fresh.latestOffset() == {"cursor": 40}
    assert sorted(r[0] for p in fresh.partitions({"cursor": 9}, {"cursor": 40}) for r in fresh.read(p)) == [20, 21, 40]
    empty = connectors.SqlPagesStream(["id"], options | {"query": "select * from products where id > 1000"})
    assert empty.partitions(empty.initialOffset(), empty.latestOffset()) == []
    with pytest.raises(ValueError, match="reading query"):
        connectors.SqlPagesStream(["id"], options | {"query": "delete from products"})


def test_epochs_count_once_and_failed_ones_leave_nothing(tmp_path):
    path = str(tmp_path / "out")
    w = connectors.EpochWriter(path, ["id"])
    row = lambda *ids: iter([Row(id=i) for i in ids])

    def read():
        epochs = f"{path}/epochs"
        files = [f for e in sorted(os.listdir(epochs)) for f in json.load(open(f"{epochs}/{e}"))]  # noqa: SIM115
        return sorted(json.loads(x)["id"] for f in files for x in open(f"{path}/{f}"))  # noqa: SIM115

    w.commit([w.write(row(1, 2)), w.write(row()), w.write(row(3))], 0)
    assert read() == [1, 2, 3]
    messages = [w.write(row(4)), None]  # the other task failed
    w.abort(messages, 1)
    assert read() == [1, 2, 3] and not os.path.exists(f"{path}/{messages[0].file}")

    def broken():
        yield Row(id=5)
        raise OSError("task lost")

    with pytest.raises(OSError, match="lost"):
        w.write(broken())
    assert read() == [1, 2, 3]
    for _ in range(2):  # an epoch that comes again
        w.commit([w.write(row(4)), w.write(row(5))], 1)
    assert read() == [1, 2, 3, 4, 5] and len(os.listdir(f"{path}/epochs")) == 2


def test_a_failing_stream_commits_no_epoch(spark, tmp_path):
    spark.dataSource.register(connectors.EpochFiles)
    spark.range(20).coalesce(2).write.parquet(f"{tmp_path}/in")
    bad = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").withColumn("id", F.when(F.col("id") == 13, F.raise_error(F.lit("bad row")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="bad row"):
        run(bad, tmp_path)
    assert connectors.committed(spark, f"{tmp_path}/out", "id long").count() == 0
    run(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), tmp_path)  # the same stream, mended
    assert sorted(r.id for r in connectors.committed(spark, f"{tmp_path}/out", "id long").collect()) == list(range(20))
