"""Records as a stream: the stages up to validation change one record at a time, so they run on a file stream
as they are; identities are then resolved for the table gathered so far, once for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config, standard
from ..operators import extract, normalize, validate
from ..plans.pipeline import Result, run_records
from ..schema import RAW


def raw_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Raw records that arrive as JSON lines of the raw schema."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(folder)


def validated_stream(raw: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or standard()
    records = normalize.normalize(extract.extract(raw), config.normalization)
    return validate.validate(records, config.confidence.field_categories)


def start(raw: DataFrame, table: str, checkpoint: str, on_result: Callable[[Result, int], None], config: Config | None = None, as_of=None) -> StreamingQuery:
    """Append each batch's extracted records to the Parquet folder table, then run on all of it.

    A batch that is run again after a failure replaces its own folder, so no record counts twice."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        extract.extract(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch_id={number}")
        records = spark.read.parquet(table).drop("batch", "batch_id")
        on_result(run_records(records, config, as_of), number)

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
