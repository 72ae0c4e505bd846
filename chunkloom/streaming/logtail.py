"""Following the transaction log with Structured Streaming.

Each micro-batch of new transactions is folded and written under the batch's number, so a batch that is run again gives the same files.
Every EVERY batches the folds since the last whole state are merged with it into the next one, so a batch costs what is
new and the state is rewritten rarely. Earlier transactions that come late lose against later ones of their key,
since the fold goes by transaction number and not by arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chunkloom.operators.namespace import latest
from chunkloom.schemas import OPERATION
from chunkloom.sources.txlog import KINDS, data_path, key, live

#: Batches from one whole state to the next.
EVERY = 16


def folded(operations: DataFrame) -> DataFrame:
    return latest(operations, ["kind", "key"], ["txid", "op_idx"])


def since_whole(batch: int) -> range:
    """The batches whose files make up the state after `batch`."""
    return range(batch - batch % EVERY, batch + 1)


def follow(spark: SparkSession, log: str, states: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the fold of the log in `states`; `once` ends with what is there now."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        operations = batch.drop("data")
        # Large transactions name the folder that has their operations.
        folders = [r[0] for r in batch.where("data IS NOT NULL").select("data").collect()]
        if folders:
            operations = operations.unionByName(session.read.schema(OPERATION).json([data_path(log, x) for x in folders]))
        new = operations.where(operations["type"].isin(*KINDS)).select("*", *key())
        if number and number % EVERY == 0:
            new = new.unionByName(session.read.parquet(*(f"{states}/{i}" for i in since_whole(number - 1))))
        folded(new).write.mode("overwrite").parquet(f"{states}/{number}")

    writer = spark.readStream.schema(f"{OPERATION}, data string").json(log).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, states: str, batch: int) -> DataFrame:
    """The live state after a batch."""
    return live(folded(spark.read.parquet(*(f"{states}/{i}" for i in since_whole(batch)))))
