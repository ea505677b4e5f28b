"""FIT files from an encoder of the test's own, and a folder of them taken into a catalogue twice."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from tidewave.operators import catalog
from tidewave.plans import joins
from tidewave.sources import fit

SIZES = {"B": 0x02, "b": 0x01, "H": 0x84, "h": 0x83, "I": 0x86, "f": 0x88, "d": 0x89}


class Writer:
    def __init__(self, order="<"):
        self.order, self.data, self.kinds = order, b"", {}

    def define(self, local, number, fields, own=0):
        self.kinds[local] = [f for _, f in fields]
        flag = 0x60 if own else 0x40
        self.data += struct.pack("BBB", flag | local, 0, self.order == ">") + struct.pack(self.order + "HB", number, len(fields))
        for k, f in fields:
            self.data += bytes((k, int(f[1:]), 7)) if f[0] == "s" else bytes((k, struct.calcsize(f), SIZES[f]))
        if own:
            self.data += bytes((1, 0, own, 0))
        self.own = own
        return self

    def put(self, local, *values, stamp=None):
        head = local if stamp is None else 0x80 | local << 5 | stamp & 31
        self.data += bytes((head,)) + b"".join(struct.pack(self.order + f, v) if f[0] != "s" else v.ljust(int(f[1:]), b"\0") for f, v in zip(self.kinds[local], values, strict=True)) + b"\xee" * self.own
        return self

    def file(self, head=14):
        h = struct.pack("<BBHI4s", head, 16, 2132, len(self.data), b".FIT")
        h += struct.pack("<H", fit.checksum(h)) if head == 14 else b""
        return h + self.data + struct.pack("<H", fit.checksum(h + self.data))


T0 = 1_000_000_000 - fit.EPOCH + 631_065_600 - 631_065_600  # 2001-09-09, in seconds of the format


def ride(order="<", maker=1, n=40, power=200, head=14):
    w = Writer(order).define(0, fit.FILE, [(1, "H"), (2, "H")]).put(0, maker, 77)
    w.define(1, fit.SPORT, [(0, "B"), (3, "s8")]).put(1, 2, b"road")
    w.define(2, fit.RECORD, [(253, "I"), (7, "H"), (3, "B"), (6, "H"), (4, "B"), (2, "H")])
    for k in range(n):
        w.put(2, T0 + k, power + k if k != 3 else 0xFFFF, 120, 5000 + k, 90, 3000)
    return w.define(3, fit.SESSION, [(253, "I"), (2, "I")]).put(3, T0 + n, T0 - 5).file(head)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("head", [12, 14])
def test_fields_in_both_byte_orders(order, head):
    a = fit.activity(ride(order, head=head))
    assert (a["manufacturer"], a["product"], a["sport"], a["start_unix"]) == ("garmin", "77", "cycling", T0 - 5 + fit.EPOCH)
    s = a["samples"]
    assert len(s) == 40 and s[3]["power_w"] is None
    assert s[5] == {"t_s": 5.0, "power_w": 205.0, "heart_rate_bpm": 120.0, "speed_mps": 5.005, "cadence": 90.0, "altitude_m": 100.0}


def test_short_stamps_own_fields_and_layouts_that_change():
    w = Writer().define(0, fit.RECORD, [(253, "I"), (7, "H")], own=3).put(0, T0, 100)
    w.define(1, fit.RECORD, [(7, "H"), (78, "f"), (73, "I")])
    for k in (1, 2, 31, 33, 64):  # the last but one goes over the end of five bits
        w.put(1, 100 + k, 12.5, 4000, stamp=T0 + k)
    w.define(0, 999, [(1, "d")]).put(0, 1.0)
    w.define(0, fit.RECORD, [(7, "H")]).put(0, 9).put(0, 10)
    a = fit.activity(w.file() + Writer().define(0, fit.RECORD, [(253, "I"), (7, "H")]).put(0, T0 + 70, 1).put(0, T0 + 60, 2).file())
    assert [s["t_s"] for s in a["samples"]] == [0, 1, 2, 31, 33, 64, 65, 66, 72, 72]
    assert a["samples"][1]["altitude_m"] == 12.5 and a["samples"][1]["speed_mps"] == 4.0 and a["start_unix"] == T0 + fit.EPOCH


def test_damage_is_told(spark, tmp_path):
    good = ride()
    bad = {"cut.fit": good[:-9], "bits.fit": good[:60] + bytes((good[60] ^ 1,)) + good[61:], "none.FIT": b"\0", "text.fit": b"no such file at all", "empty.fit": Writer().define(0, fit.FILE, [(1, "H")]).put(0, 1).file(), "lost.fit": Writer().define(0, fit.FILE, [(1, "H")]).put(0, 1).file().replace(b"\x00\x01\x00", b"\x05\x01\x00")}
    w = Writer()
    w.data = bytes((5,)) + b"abc"
    bad["wild.fit"] = w.file()
    for name, content in {**bad, "good.fit": good, "other.csv": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    got = {os.path.basename(r.path): r for r in fit.fit_files(spark, str(tmp_path)).collect()}
    assert set(got) == {*bad, "good.fit"}
    assert got["good.fit"].error is None and len(got["good.fit"].samples) == 40
    assert all(got[n].error and got[n].samples is None and got[n].file_hash for n in bad)
    assert got["cut.fit"].error == "cut short" and got["bits.fit"].error == "wrong checksum" and got["wild.fit"].error == "a record without a definition"
    s = fit.fit_samples(fit.fit_files(spark, str(tmp_path)))
    assert s.columns == ["activity_id", *fit.NAMES] and s.count() == 40 and s.first().activity_id == "good"


def test_a_folder_taken_in_twice(spark, tmp_path):
    root = tmp_path / "raw"
    for name, content in {"email/a.fit": ride(n=100), "polar/polar_9.fit": ride(maker=123, power=300), "z/copy.fit": ride(n=100), "2024-05-06-b.fit": ride(power=100), "bad.fit": b"?"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    top = f"file:{root}"
    history = spark.createDataFrame([("cycling", "2001-01-01", "2002-01-01", 250.0)], "sport string, since string, until string, ftp_w double").withColumns({c: F.col(c).cast("date") for c in ("since", "until")})

    def take(have):
        files = fit.fit_files(spark, str(root)).withColumns({"owner": F.lit("me"), "start": F.timestamp_seconds("start_unix")})
        samples = files.select("path", F.explode_outer("samples").alias("s")).where("s is not null").select("path", "s.*")
        return catalog.ingest(files.drop("samples"), samples, have, history, 30.0, top)

    none = spark.createDataFrame([], catalog.ACTIVITIES)
    table, outcomes = take(none)
    told = {os.path.basename(r.path): (r.source_key, r.outcome, r.reason) for r in outcomes.collect()}
    assert told["a.fit"] == ("email/a.fit", "inserted", None) and told["copy.fit"][1:] == ("skipped", "file_hash already present") and told["bad.fit"][1] == "failed"
    table.write.parquet(f"{tmp_path}/catalog")
    first = spark.read.parquet(f"{tmp_path}/catalog")
    rows = {r.source_file: r for r in first.collect()}
    assert set(rows) == {"email/a.fit", "polar/polar_9.fit", "2024-05-06-b.fit"}
    a = rows["email/a.fit"]
    p = [200.0 + k if k != 3 else 0.0 for k in range(100)]
    means = [sum(p[k - 29 : k + 1]) / 30 for k in range(29, 100)]
    np_ = (sum(m**4 for m in means) / len(means)) ** 0.25
    assert (a.ingest_pipeline, str(a.ride_date), a.ftp_used_w, a.duration_s, a.avg_hr_bpm) == ("email", "2001-09-09", 250.0, 99.0, 120.0)
    assert a.np_w == pytest.approx(np_) and a.tss == pytest.approx(99 * np_ * (np_ / 250) / (250 * 36)) and a.avg_power_w == pytest.approx(sum(p) / 100)
    assert rows["polar/polar_9.fit"].external_id == "9" and rows["2024-05-06-b.fit"].ftp_used_w == 50.0 and str(rows["2024-05-06-b.fit"].ride_date) == "2024-05-06"
    again, outcomes = take(first)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    assert {r.outcome for r in outcomes.collect()} == {"skipped", "failed"}
    # the same file with other content is scored anew; what was told of it by hand stays
    (root / "email/a.fit").write_bytes(ride(n=50))
    third, _ = take(first.withColumn("sport", F.when(F.col("source_file") == "email/a.fit", "gravel").otherwise(F.col("sport"))))
    b = {r.source_file: r for r in third.collect()}["email/a.fit"]
    assert (b.duration_s, b.sport, third.count()) == (49.0, "gravel", 3)
    daily = joins.daily_loads(first.select("owner", F.col("ride_date").alias("date"), "tss", F.col("duration_s").alias("duration"), "sport", "counts_for_load")).collect()
    assert {(str(r.date), r.ride_count) for r in daily} == {("2001-09-09", 2), ("2024-05-06", 1)}


def test_samples_are_read_once_and_each_day_is_looked_up_once(spark, tmp_path, monkeypatch):
    days = ["2024-01-01", "2024-01-01", "2024-02-01", "2024-13-45"]
    files = spark.createDataFrame([("me", f"/raw/{d}-{k}.fit", 1, f"h{k}", None, None, "run", None, None, "bad" if k == 3 else None) for k, d in enumerate(days)], "owner string, path string, bytes long, file_hash string, manufacturer string, product string, sport string, start timestamp, modified timestamp, error string")
    rows = [(f"/raw/{d}-{k}.fit", float(i), 100.0 * (k + 1), float("nan") if i else 120.0, None, 2.0) for k, d in enumerate(days) for i in range(40)]
    spark.createDataFrame(rows, "path string, t_s double, power_w double, heart_rate_bpm double, cadence double, speed_mps double").write.parquet(f"{tmp_path}/samples")
    history = spark.createDataFrame([("run", "2024-01-15", None, 250.0)], "sport string, since string, until string, ftp_w double").withColumns({c: F.col(c).cast("date") for c in ("since", "until")})
    asked, valid_at = [], joins.valid_at
    monkeypatch.setattr(joins, "valid_at", lambda facts, *a: asked.append(facts) or valid_at(facts, *a))
    table, outcomes = catalog.ingest(files, spark.read.parquet(f"{tmp_path}/samples"), spark.createDataFrame([], catalog.ACTIVITIES), history, 30.0, "/raw")
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert asked[0].count() == 2
    got = {r.source_file: (r.ftp_used_w, r.avg_hr_bpm, r.np_w, r.duration_s, r.max_cadence, r.avg_speed_kmh) for r in table.collect()}
    assert got == {f"{d}-{k}.fit": (ftp, 120.0, pytest.approx(100.0 * (k + 1)), 39.0, None, 7.2) for k, (d, ftp) in enumerate(zip(days[:3], (50.0, 50.0, 250.0)))}
    assert {r.outcome for r in outcomes.where("path like '%-3.fit'").collect()} == {"failed"}
