import datetime as dt

from fieldloom.streaming import monthly


def month(spark, path, t, value):
    rows = [(c, 0, c, t, 0.0, float(c), value + c, dt.datetime(2000 + t // 12, t % 12 + 1, 1)) for c in range(4)]
    spark.createDataFrame(rows, monthly.ARRIVING).write.mode("append").parquet(path)


def test_months_arrive_and_are_replaced(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for t in range(3):
        month(spark, source, t, float(t))
    monthly.keep(monthly.arriving(spark, source), store, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(store).count() == 12
    month(spark, source, 3, 9.0)
    month(spark, source, 1, 50.0)  # a corrected month
    monthly.keep(monthly.arriving(spark, source), store, str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(store)
    assert got.count() == 16
    assert sorted(r["sla"] for r in got.where("t = 1").collect()) == [50.0, 51.0, 52.0, 53.0]
    labels = spark.createDataFrame([(c, 0) for c in range(4)], "cell_id long, cluster_id int")
    assert monthly.refit(spark, store, labels, 1).first()["n"] == 4


def test_windowed_means(spark, tmp_path):
    source = str(tmp_path / "in")
    for t in range(3):
        month(spark, source, t, float(t))
    query = monthly.yearly_means(monthly.arriving(spark, source)).writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sum(r["n"] for r in spark.sql("select * from means").collect()) == 12
