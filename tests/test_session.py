"""The shared folder: named on clusters, temporary in local sessions."""

from types import SimpleNamespace

import pytest

from plumbline.session import shared_dir, stored


def test_clusters_must_name_the_shared_folder():
    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_stored_rows_are_read_from_the_shared_folder(spark):
    df = stored(spark.range(10), "test")
    assert df.count() == 10 and all(f.startswith(f"file://{shared_dir(spark)}") for f in df.inputFiles())
