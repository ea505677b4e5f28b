"""A catalogue led through its versions, twice, and after a crash at any point."""

import os

import pytest

from tidewave.operators import catalog, catalog_versions


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.createDataFrame([("email/a.fit", 10.0, None), ("x/polar/b.fit", 20.0, None), ("c.fit", 30.0, "Polar Electro"), ("d.fit", 40.0, None)], "source_file string, tss double, manufacturer string")
    s = catalog_versions.Store(spark, str(tmp_path / "catalog"))
    s.create(rows)
    return s


def content(s):
    return {n: sorted(map(str, t.collect())) for n, t in s.tables().items()}


def test_from_first_to_last_twice(store):
    store.create()
    assert store.manifest()["version"] == 1
    assert store.upgrade() == 3 and store.manifest()["version"] == catalog_versions.CURRENT
    t = store.tables()
    assert set(t) == {"activities", "ftp_history", "catalog_meta", "session_groups"}
    assert {r.source_file: (r.ingest_pipeline, r.tss, r.counts_for_load, r.is_primary) for r in t["activities"].collect()} == {"email/a.fit": ("email", 10.0, True, True), "x/polar/b.fit": ("polar", 20.0, True, True), "c.fit": ("polar", 30.0, True, True), "d.fit": ("manual", 40.0, True, True)}
    before = content(store)
    assert store.upgrade() == 0 and content(store) == before


@pytest.mark.parametrize("at", [2, 3, 4])
def test_a_crash_leaves_the_last_version(store, at, monkeypatch):
    rename = catalog_versions.Store._path

    def crash(self, name):
        if name.endswith(".json") and self.manifest()["version"] == at - 1:
            raise KeyboardInterrupt
        return rename(self, name)

    monkeypatch.setattr(catalog_versions.Store, "_path", crash)
    with pytest.raises(KeyboardInterrupt):
        store.upgrade()
    monkeypatch.undo()
    assert store.manifest()["version"] == at - 1 and store.tables()["activities"].count() == 4
    assert store.upgrade() == catalog_versions.CURRENT - at + 1 and store.tables()["activities"].where("ingest_pipeline is null").count() == 0


def test_one_of_two_writers_wins(store, spark):
    other = catalog_versions.Store(spark, store.folder)
    numbers = other._numbers()
    store.commit(1, {"extra": spark.range(3).toDF("k")})
    other._numbers = lambda: numbers
    with pytest.raises(RuntimeError):
        other.commit(1, {"extra": spark.range(9).toDF("k")})
    del other._numbers
    assert other.tables()["extra"].count() == 3


def test_an_empty_folder(spark, tmp_path):
    s = catalog_versions.Store(spark, str(tmp_path / "none"))
    assert s.manifest() == {"version": 0, "tables": {}} and s.tables() == {}
    s.create(version=1)
    assert s.upgrade() == 3 and s.tables()["activities"].count() == 0
    assert set(c.split()[0] for c in catalog.ACTIVITIES.split(", ")) <= set(s.tables()["activities"].columns)
    assert os.path.isdir(tmp_path / "none" / "manifests")
