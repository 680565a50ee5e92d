"""Sources, sinks, the result store and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import binary, store, text
from tidemark.streaming import windows


def test_binary_signal(spark, tmp_path):
    data = np.arange(3000, dtype="<i2").reshape(1000, 3)
    path = str(tmp_path / "a.dat")
    data.tofile(path)
    df = binary.read_binary(spark, path, 3, 100.0, chunk=300)
    rows = df.orderBy("t").collect()
    assert df.columns == ["t", "ch0", "ch1", "ch2"] and len(rows) == 1000
    assert [rows[7].t, rows[7].ch1] == [0.07, 22]
    part = binary.read_binary(spark, path, 3, 100.0, select=[2], start=1, duration=2).orderBy("t").collect()
    assert (len(part), part[0].t, part[0].ch2) == (200, 1.0, 302)
    assert [r.ch0 for r in binary.read_binary(spark, path, 3, 100.0, offset=10, records=5, skip=1).orderBy("t").collect()] == [30, 36, 42, 48, 54]
    with pytest.raises(Exception, match="not both"):
        binary.read_binary(spark, path, 3, 100.0, start=1, offset=1).count()
    out = str(tmp_path / "out")
    assert binary.write_binary(df.repartition(4), out, ["ch0", "ch1", "ch2"]) == 1000
    again = np.concatenate([np.fromfile(p, "<i2") for p in sorted((tmp_path / "out").iterdir())])
    assert (again.reshape(-1, 3) == data).all()
    for chunk in (70, 5000):
        rows = binary.read_binary(spark, out, 3, 100.0, chunk=chunk).orderBy("t").collect()
        assert [(r.t, r.ch2) for r in rows] == [(i / 100, 3 * i + 2) for i in range(1000)]
    with pytest.raises(FileExistsError):
        binary.write_binary(df, out, ["ch0"])


def test_event_files(spark, tmp_path):
    (tmp_path / "a.evt").write_text("1000 beginning of run\n2500.5\tend of run\nnonsense\n3000 beginning of rest\n")
    events = text.read_events(spark, str(tmp_path / "a.evt"))
    assert sorted((r.t, r.description) for r in events.collect()) == [(1.0, "beginning of run"), (2.5005, "end of run"), (3.0, "beginning of rest")]
    assert [tuple(r) for r in text.compact_events(events).collect()] == [("run", 1.0, 2.5005)]
    text.write_events(events, str(tmp_path / "out"))
    assert text.read_events(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        text.write_events(events, str(tmp_path / "out"))
    periods = spark.createDataFrame([(1.0, 2.0, 3.0)], "start double, peak double, stop double")
    assert [r.description for r in text.period_events(periods, "ripple 5").collect()] == ["ripple 5 start", "ripple 5 peak", "ripple 5 stop"]


def test_spike_files(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"a.res.{n}").write_text("".join(f"{100 * n + i}\n" for i in range(20)))
        (tmp_path / f"a.clu.{n}").write_text("5\n" + "".join(f"{i % 4}\n" for i in range(20)))
        (tmp_path / f"a.fet.{n}").write_text("3\n" + "".join(f"{i} {2 * i} {100 * n + i}\n" for i in range(20)))
    spikes = text.read_spikes(spark, f"{tmp_path}/a.res.*", f"{tmp_path}/a.clu.*", 100.0)
    assert sorted((r.t, r.grp, r.cluster) for r in spikes.collect()) == sorted(((100 * n + i) / 100, n, i % 4) for n in (1, 2) for i in range(20))
    assert text.select_units(spikes, [(1, -1), (2, 3)]).count() == 15
    assert text.select_units(spikes, [(1, -2)]).count() == 15 and text.select_units(spikes, [(1, -3)]).count() == 20
    f = text.read_features(spark, f"{tmp_path}/a.fet.*", 100.0).where("grp = 2").orderBy("t").collect()
    assert f[3].features == [3.0, 6.0] and f[3].t == 2.03
    (tmp_path / "a.whl").write_text("1 2\n-1 -1\n3 4\n")
    p = text.read_positions(spark, f"{tmp_path}/a.whl", 10.0).orderBy("t").collect()
    assert [(r.t, r.x) for r in p] == [(0.0, 1.0), (0.1, None), (0.2, 3.0)]


def test_result_store(spark, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "results"))
    assert s.get().count() == 0
    rows = spark.createDataFrame([("rat1-day1", "rate", "", "", "", b"1"), ("rat1-day2", "rate", "", "", "", b"2")], "eid string, name string, comments string, parameters string, code string, payload binary")
    s.add(rows)
    assert s.get("name = 'rate'", "keys").count() == 2
    assert s.get(output="full").where("md5 = md5(payload)").count() == 2
    with pytest.raises(ValueError, match="already stored"):
        s.add(rows)
    s.remove("eid like '%day2'")
    assert [r.eid for r in s.get().collect()] == ["rat1-day1"]
    other = rows.withColumn("eid", F.concat("eid", F.lit("-x")))
    both, left, right = store.match_values(s.get(), other, r"^(rat\d+-day\d+)")
    assert (both.count(), left.count(), right.count()) == (1, 0, 1)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(windows.windowed_rates(stream, "user_id", "1 hour", "30 minutes"), "rates")
    assert got.agg(F.sum("n")).first()[0] > 0.9 * 2 * events.count()
    found = run(windows.bursts(stream, "user_id", "2 hours"), "bursts")
    assert 0 < found.agg(F.sum("n")).first()[0] <= events.count()
