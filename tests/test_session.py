import os

from assay_spark.session import checkpoint_dir, materialize, write_stage


def test_checkpoint_folder_comes_from_the_session(spark):
    d = checkpoint_dir(spark)
    assert d == spark.conf.get("spark.checkpoint.dir")
    assert spark.sparkContext.getCheckpointDir() is not None


def test_write_stage_lands_in_the_checkpoint_folder(spark):
    df = spark.range(10)
    back = write_stage(df, "t-stage")
    assert back.count() == 10
    root = checkpoint_dir(spark).replace("file:", "")
    assert os.path.isdir(os.path.join(root, "stages", "t-stage"))
    assert materialize(df.filter("id < 3")).count() == 3
