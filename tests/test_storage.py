import pytest

from gridweave import storage


@pytest.fixture
def other_file_system(spark, tmp_path, monkeypatch):
    """A default file system that isn't file://, over a local folder."""
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.gw.link./shared", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://gw/")
    monkeypatch.setattr(storage, "configured", lambda spark: "/shared/work")
    yield tmp_path
    conf.set("fs.defaultFS", before)


def test_path_without_scheme_belongs_to_the_default_file_system(spark, other_file_system):
    assert storage.shared_dir(spark) == "viewfs://gw/shared/work"
    df = storage.stored(spark.range(10).selectExpr("id", "id * 2 AS twice"), "numbers")
    assert sorted(r.twice for r in df.collect()) == [2 * i for i in range(10)]
    assert list(other_file_system.glob("work/numbers-*/part-*"))


def test_local_path_gets_its_scheme(spark, tmp_path):
    assert storage.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert storage.qualified(spark, f"file:{tmp_path}/") == f"file://{tmp_path}"
