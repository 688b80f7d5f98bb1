"""How input is cut into tasks."""

from sparrowline.session import TASK_ROWS, spread


def sizes(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_tasks_of_a_table_stay_small_as_it_grows(spark, tmp_path):
    cores, path = spark.sparkContext.defaultParallelism, str(tmp_path / "table")
    spark.range(2 * cores * TASK_ROWS).coalesce(1).write.parquet(path)
    cut = spread(spark.read.parquet(path))
    assert max(sizes(cut)) <= TASK_ROWS + cut.rdd.getNumPartitions()
    assert cut.distinct().count() == 2 * cores * TASK_ROWS


def test_a_table_of_small_splits_is_left_alone(spark, tmp_path):
    cores, path = spark.sparkContext.defaultParallelism, str(tmp_path / "table")
    with_settings = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(4 * cores).repartition(2 * cores).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = spark.read.parquet(path)
        assert spread(scan) is scan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_settings)


def test_a_few_splits_more_than_cores_are_dealt_evenly(spark, tmp_path):
    cores, path, each = spark.sparkContext.defaultParallelism, str(tmp_path / "table"), TASK_ROWS // 2
    with_settings = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(0, (cores + 1) * each, 1, cores + 1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cut = spread(spark.read.parquet(path))
        # One more task than there are cores would leave all but one of them idle for half the time.
        assert cut.rdd.getNumPartitions() % cores == 0
        assert max(sizes(cut)) < 1.5 * each
        assert cut.distinct().count() == (cores + 1) * each
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_settings)


def test_an_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(str(tmp_path / "table"))
    assert spread(spark.read.parquet(str(tmp_path / "table"))).count() == 0
