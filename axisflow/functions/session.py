"""A session with the settings that the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "axisflow", master: str | None = None, partitions: int | None = None, checkpoint_dir: str | None = None, pools: bool = False, **more: str) -> SparkSession:
    """Adaptive execution, which joins partitions that are small and splits those that are skewed, and UTC.

    partitions: of shuffles, before adaptive execution joins them; leave it out on a cluster that sets its own.
    pools: a fair scheduler, so that worker groups share the executors. Names in `more` have _ for the dots.
    """
    b = SparkSession.builder.appName(app)
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    if pools:
        conf["spark.scheduler.mode"] = "FAIR"
    conf |= {k.replace("_", "."): v for k, v in more.items()}
    if master:
        b = b.master(master)
    return b.config(map=conf).getOrCreate()
