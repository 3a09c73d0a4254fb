"""An operation log as a stream: each micro-batch is folded into tables of dots and clocks.

State is kept as Parquet, one folder a version, written before the pointer to it moves; a batch that comes again after
a failure finds its number in the pointer and changes nothing. Operations whose causes have not arrived are kept aside
and tried again with every batch; malformed ones go to a ledger with the number of times they were seen.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import merge

OPS = "actor string, counter long, kind string, g string, s string, p string, o string, witnessed map<string,long>"


class OpLog:
    """Dots and clocks under a folder, advanced by foreachBatch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self) -> dict:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        path = f"{place}/pointer.json"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return {"batch": -1}
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _move(self, pointer: dict) -> None:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with store.open_output_stream(f"{place}/pointer.new") as f:
            f.write(json.dumps(pointer).encode())
        store.move(f"{place}/pointer.new", f"{place}/pointer.json")

    def table(self, name: str, schema: str) -> DataFrame:
        batch = self._pointer()["batch"]
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{batch}/{name}")

    @property
    def dots(self) -> DataFrame:
        return self.table("dots", "g string, s string, p string, o string, actor string, counter long")

    @property
    def removed(self) -> DataFrame:
        return self.table("removed", "g string, s string, p string, o string, actor string, seen long")

    @property
    def clock(self) -> DataFrame:
        return self.table("clock", "g string, actor string, counter long")

    @property
    def pending(self) -> DataFrame:
        return self.table("pending", OPS)

    @property
    def rejected(self) -> DataFrame:
        return self.table("rejected", f"{OPS}, seen_count long")

    def live(self) -> DataFrame:
        return merge.live(self.dots)

    def apply(self, ops: DataFrame, batch: int) -> None:
        """Fold a micro-batch in. An operation waits until its author's former operations and all it witnessed are there."""
        if self._pointer()["batch"] >= batch:
            return
        ops = ops.select(*[c.split()[0] for c in OPS.split(", ")])
        good = F.col("kind").isin("add", "remove") & F.col("actor").isNotNull() & (F.col("counter") > 0) & F.startswith("g", F.lit("<")) & F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()
        bad = ops.where(~F.coalesce(good, F.lit(False)))
        todo = self.pending.unionByName(ops.where(good)).dropDuplicates(["g", "actor", "counter"])
        clock, dots, removed = self.clock, self.dots, self.removed
        todo = todo.join(clock.withColumnRenamed("counter", "have"), ["g", "actor"], "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("counter > have")
        order = Window.partitionBy("g", "actor").orderBy("counter")
        todo = todo.withColumn("gap", F.col("counter") > F.col("have") + F.row_number().over(order)).drop("have")
        named = todo.select("g", "actor", "counter", F.explode(F.coalesce("witnessed", F.create_map().cast("map<string,long>"))).alias("cause", "need")).where("cause <> actor")
        lacking = named.join(clock.select("g", F.col("actor").alias("cause"), F.col("counter").alias("have")), ["g", "cause"], "left").where("need > coalesce(have, 0)")
        arrived = todo.select("g", F.col("actor").alias("cause"), F.col("counter").alias("got"))
        lacking = lacking.join(arrived.groupBy("g", "cause").agg(F.max("got").alias("got")), ["g", "cause"], "left").where("need > coalesce(got, 0)").select("g", "actor", F.col("counter").alias("stuck"))
        lacking = lacking.unionByName(todo.where("gap").select("g", "actor", F.col("counter").alias("stuck")))
        todo = todo.drop("gap")
        first = lacking.groupBy("g", "actor").agg(F.min("stuck").alias("stuck"))  # an author's later operations wait too
        split = todo.join(first, ["g", "actor"], "left")
        waits = split.where("counter >= stuck").drop("stuck")
        ready = split.where("stuck IS NULL OR counter < stuck").drop("stuck")
        seen = ready.where("kind = 'remove'").select("g", "s", "p", "o", F.explode("witnessed").alias("actor", "seen"))
        removed = removed.unionByName(seen).groupBy("g", "s", "p", "o", "actor").agg(F.max("seen").alias("seen"))
        adds = dots.unionByName(ready.where("kind = 'add'").select("g", "s", "p", "o", "actor", "counter"))
        kept = adds.join(removed, ["g", "s", "p", "o", "actor"], "left").where("seen IS NULL OR counter > seen").drop("seen")
        ledger = self.rejected.unionByName(bad.withColumn("seen_count", F.lit(1).cast("long")))
        key = [c.split()[0] for c in OPS.split(", ") if not c.startswith("witnessed")]
        ledger = ledger.groupBy(*key).agg(F.first("witnessed").alias("witnessed"), F.sum("seen_count").alias("seen_count"))
        for name, df in (("dots", kept), ("removed", removed), ("clock", merge.clock(ready.select("g", "actor", "counter").unionByName(clock))), ("pending", waits), ("rejected", ledger)):
            df.write.mode("overwrite").parquet(f"{self.folder}/{batch}/{name}")
        self._move({"batch": batch})

    def follow(self, stream: DataFrame, checkpoint: str):
        """Start folding a streaming DataFrame of operations."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
