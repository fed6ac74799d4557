import os

from strandlake.lineage import checkpoint_folder, cut, kept, scratch


def tables(spark):
    from urllib.parse import urlparse

    folder = f"{urlparse(checkpoint_folder(spark)).path}/cut"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scratch_deletes_what_is_not_kept(spark):
    before = tables(spark)
    with scratch(spark):
        a = cut(spark.range(10))
        with scratch(spark):
            b = kept(cut(a.where("id > 4")))
            assert len(tables(spark) - before) == 3
        assert len(tables(spark) - before) == 2 and b.count() == 5
        c = kept(b)
    assert len(tables(spark) - before) == 1 and c.count() == 5


def test_scratch_deletes_after_errors(spark):
    before = tables(spark)
    try:
        with scratch(spark):
            cut(spark.range(3))
            raise KeyError
    except KeyError:
        pass
    assert tables(spark) == before
