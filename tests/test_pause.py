"""A paused stream against one that isn't."""

from pyspark.sql import functions as F

from colophon.plans.runs import active_seconds
from colophon.streaming.pause import PausableRun


def test_a_paused_run_gives_what_an_unpaused_one_gives(spark, tmp_path):
    for k in range(6):
        spark.range(100 * k, 100 * k + 100).select("id", (F.col("id") % 7).alias("k")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    now = [0.0]

    def clock():
        return now[0]

    seen = []

    def step(batch, number):
        now[0] += 10
        seen.append(number)
        batch.groupBy("k").count().write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    stream = lambda: spark.readStream.schema("id bigint, k bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = PausableRun("r", stream, step, f"{tmp_path}/cp", clock)
    pauses = []
    for n in (2, 0, 1):
        assert not run.go(batches=n)
        pauses.append(now[0])
        now[0] += 1000
    assert run.go() and run.go()
    assert sorted(seen) == list(range(6)) and len(seen) == 6
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("k").agg(F.sum("count").alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: sum(1 for i in range(600) if i % 7 == k) for k in range(7)}
    kinds = [kind for _, _, kind in run.log]
    assert kinds == ["start", "pause", "resume", "pause", "resume", "pause", "resume", "end"]
    # six batches of ten seconds; three pauses of a thousand
    assert active_seconds(run.events(spark)).first().active == 60.0 and now[0] == 3060.0


def test_a_step_that_fails_is_no_pause(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/in")
    broken = [True]

    def step(batch, number):
        if broken:
            broken.clear()
            raise ValueError("broken")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/{number}")

    run = PausableRun("r", lambda: spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), step, f"{tmp_path}/cp")
    try:
        run.go()
        raise AssertionError("the failure was lost")
    except Exception as e:
        assert "broken" in str(e)
    assert run.go() and spark.read.parquet(f"{tmp_path}/out/0").count() == 5
