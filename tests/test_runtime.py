from types import SimpleNamespace

import pytest

from nebulith import runtime


def session(setting=None, through_api=None, master="local[4]", app="app"):
    made = []
    context = SimpleNamespace(applicationId=app, getCheckpointDir=lambda: through_api, setCheckpointDir=made.append, master=master, _jvm=None, _jsc=None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting if key == "spark.checkpoint.dir" else default), sparkContext=context), made


@pytest.mark.parametrize("setting,through_api,want", [("hdfs://x/shared/", None, "hdfs://x/shared/"), (None, "s3://y/set", "s3://y/set"), ("hdfs://x/shared", "s3://y/set", "hdfs://x/shared")])
def test_scratch_is_in_the_shared_folder(setting, through_api, want):
    spark, made = session(setting, through_api, "spark://host:7077", f"app-{setting}-{through_api}")
    assert runtime._scratch_root(spark).startswith(want.rstrip("/") + "/") and not made


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,3000]"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime._scratch_root(session(None, None, master, f"bare-{master}")[0])


def test_local_sessions_get_a_folder_of_their_own():
    spark, made = session(None, None, "local[*]", "alone")
    root = runtime._scratch_root(spark)
    assert made == [root.rsplit("/", 1)[0]] and root.startswith("file:///")


def test_tables_left_are_those_kept(spark):
    import os

    scratch = runtime.Scratch(spark, "drops")
    frames = [scratch.write(spark.range(i + 1)) for i in range(4)]
    scratch.drop_but(frames[1], frames[3])
    later = scratch.write(spark.range(9))
    scratch.drop_but(later)
    there = lambda df: os.path.isdir(df._nebulith_path.removeprefix("file://"))
    assert [there(f) for f in frames] == [False, False, False, False] and there(later) and later.count() == 9
