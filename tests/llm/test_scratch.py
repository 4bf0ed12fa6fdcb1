import os

import pytest

from helixframe.llm import _common


def test_written_tables_and_their_removal(spark):
    df = _common.written(spark.range(5), "five")
    assert df.count() == 5
    folder = _common._made[-1].removeprefix("file://")
    assert os.path.isdir(folder) and folder.startswith(_common.scratch_root(spark).removeprefix("file://"))
    other = _common.written(spark.range(2), "two")
    _common.dropped(other)
    assert not os.path.isdir(other.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://"))
    _common.cleanup(spark)
    assert not os.path.isdir(folder) and not _common._made


def test_cleanup_of_what_came_later(spark):
    first = _common.written(spark.range(3), "first")
    mark = _common.mark()
    second, third = (_common.written(first, n) for n in ("second", "third"))
    _common.cleanup(spark, since=mark, keep=third)
    assert first.count() == third.count() == 3 and not os.path.isfile(second.inputFiles()[0].removeprefix("file://")) and len(_common._made) == mark + 1
    _common.cleanup(spark)


def test_batches_are_bounded_by_the_least(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for had, asked, want in (("10000", 256, "256"), ("100", 256, "100"), ("0", 256, "256"), ("256", 2048, "256")):
        spark.conf.set(name, had)
        _common.bounded_batches(spark, asked)
        assert spark.conf.get(name) == want
    spark.conf.set(name, before)


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        _common.scratch_root(Session())
