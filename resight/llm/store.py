"""Tables that cut a lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (one machine, as in tests) a new one."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("resight.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="resight-")
        spark.conf.set("resight.shared.dir", own)
    return own.rstrip("/")


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: what follows neither repeats the work above
    nor depends on the executors that did it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
