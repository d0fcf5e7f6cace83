"""Tree levels and climbs of few rows run in few tasks, whatever the number of shuffle partitions."""

from plumbline.llm import merkle

CONFS = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_levels_take_tasks_by_their_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, merkle.manifest(docs).collect()))
    before = {k: spark.conf.get(k) for k in CONFS}
    tasks, staged = {}, merkle.stage

    def counted(df, label):
        out = staged(df, label)
        tasks.setdefault(label, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(merkle, "stage", counted)
    try:
        for k, v in CONFS.items():
            spark.conf.set(k, v)
        got = sorted(map(tuple, merkle.manifest(docs).collect()))
        assert max(tasks["merkle-level"]) == 1
        assert max(tasks["merkle-climb"]) <= spark.sparkContext.defaultParallelism
        tasks.clear()
        monkeypatch.setattr(merkle, "TASK_ROWS", 20)
        assert sorted(map(tuple, merkle.manifest(docs).collect())) == want
        assert max(tasks["merkle-level"]) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and len(got) == docs.count()
