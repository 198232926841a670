"""Facts as a Spark table bucketed by entity: a lookup of few entities reads their buckets only, and a
join by entity needs no shuffle of the table.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.schemas import FACTS

BUCKETS = 64
#: Entities that are looked up by value, which prunes buckets; more are joined, bucket by bucket.
LOOKED_UP = 1000


class FactBuckets:
    """One version of the table below a folder, and the batches (table, name) that it has folded."""

    def __init__(self, spark: SparkSession, path: str, number: int, folded: frozenset[tuple[str, str]]) -> None:
        self.spark, self.path, self.number, self.folded = spark, path, number, folded

    @staticmethod
    def _name(path: str) -> str:
        return f"engram_facts_{hashlib.md5(path.encode()).hexdigest()}"

    @classmethod
    def write(cls, spark: SparkSession, root: str, rows: DataFrame, folded: list[tuple[str, str]], number: int = BUCKETS) -> None:
        """Write a new version; it counts once its list of batches, written last, is complete."""
        # names in order of time; the later version holds all that the earlier one does
        path = f"{root}/v={_now(spark):020d}-{uuid.uuid4().hex[:8]}"
        writer = rows.select(*FACTS.names).repartition(number, "entity_id").write.format("parquet").option("path", f"{path}/rows")
        writer.bucketBy(number, "entity_id").sortBy("entity_id").saveAsTable(cls._name(path))
        listed = spark.createDataFrame([(number, *f) for f in folded] or [(number, "", "")], "number int, name string, batch string")
        listed.coalesce(1).write.parquet(f"{path}/folded")

    @classmethod
    def latest(cls, spark: SparkSession, root: str) -> "FactBuckets | None":
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        found = sorted(s.getPath().toString() for s in fs.listStatus(folder))
        for path in reversed(found):
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/folded/_SUCCESS")):
                rows = spark.read.parquet(f"{path}/folded").collect()
                return cls(spark, path, rows[0].number, frozenset((r["name"], r.batch) for r in rows if r["name"]))
        return None

    def rows(self) -> DataFrame:
        """All facts. A session that did not write the table declares it over the files first."""
        name = self._name(self.path)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FACTS.fields)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
                f"CLUSTERED BY (entity_id) SORTED BY (entity_id) INTO {self.number} BUCKETS LOCATION '{self.path}/rows'")
        return self.spark.table(name)

    def of(self, ids: DataFrame) -> DataFrame:
        """The facts of some entities (column entity_id, distinct)."""
        few = [r.entity_id for r in ids.limit(LOOKED_UP + 1).collect()]
        if len(few) <= LOOKED_UP:
            return self.rows().where(F.col("entity_id").isin(few))
        return self.rows().join(ids, "entity_id", "left_semi")


def _now(spark: SparkSession) -> int:
    return spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
