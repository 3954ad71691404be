import datetime as dt

from netloom.streaming.panels import streaming_panel, write_panel


def test_closed_windows_are_appended(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, h), e, float(d)) for d in range(1, 9) for h in (1, 13) for e in "ab"]
    spark.createDataFrame(rows, "ts timestamp, kind string, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string, v double").parquet(str(tmp_path / "in"))
    write_panel(streaming_panel(stream, "ts", "kind", "v"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.t.day, r.entity): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, "a"] == 2.0 and got[5, "b"] == 10.0 and all(v == 2.0 * d for (d, _), v in got.items())


def test_window_sizes_share_their_ends(spark):
    from netloom.operators import sparse as S
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i), f"c{j}", float(r.normal())) for i in range(40) for j in range(3)]
    returns = spark.createDataFrame(rows, "k int, t date, entity string, ret double")
    got = S.window_sizes(returns, 0.1, (10, 20), 10, 5).groupBy("window_size", "network_date", "window_id").count().collect()
    assert len({x.network_date for x in got if x.window_size == 10} ^ {x.network_date for x in got if x.window_size == 20}) == 0 and all(x["count"] == 3 for x in got)
    assert len(got) == 2 * len(S.common_ends(40, (10, 20), 10, 5))
