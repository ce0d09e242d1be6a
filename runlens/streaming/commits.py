"""Tables that the outputs of a trigger reach together or not at all.

A trigger writes each output to a folder of its own and then one small commit that names these folders. Readers take the
folders of commits only, so a trigger that fails half-way is not seen, and when it runs again, its new folders count. Outputs
are parts, which add to what a table holds, or snapshots, which replace it. What a snapshot has replaced is removed
when the next one is committed, so readers have that long to finish.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import remove

COMMIT = "table string, path string, snapshot boolean, trigger bigint"


def _log(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{root}/_commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def last_trigger(spark: SparkSession, root: str) -> int:
    """The newest committed trigger, -1 before the first."""
    newest = _log(spark, root).agg(F.max("trigger")).first()[0]
    return -1 if newest is None else newest


def commit(spark: SparkSession, root: str, trigger: int, parts: dict = None, snapshots: dict = None) -> bool:
    """Write the outputs of a trigger and make them visible at once; a trigger that is committed already is left alone.

    ``parts`` and ``snapshots`` map table names to rows.
    """
    if trigger <= last_trigger(spark, root):
        return False
    rows = []
    for outputs, whole in ((parts or {}, False), (snapshots or {}, True)):
        for table, df in outputs.items():
            path = f"{root}/{table}/{trigger}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            rows.append((table, path, whole, trigger))
    # One file, which the writer puts in place by renaming it.
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{root}/_commits/{trigger}")
    if snapshots:
        retire(spark, root)
    return True


def _live(log: list, table: str) -> list:
    """The newest snapshot of a table and the parts after it."""
    own = [r for r in log if r.table == table]
    since = max((r.trigger for r in own if r.snapshot), default=-1)
    return [r for r in own if r.trigger > since or r.trigger == since and r.snapshot]


def read(spark: SparkSession, root: str, table: str, schema) -> DataFrame:
    """The committed rows of a table; none before its first commit."""
    paths = [r.path for r in _live(_log(spark, root).collect(), table)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def retire(spark: SparkSession, root: str) -> None:
    """Remove the folders, and the commits left without any, that the snapshot before the newest one had replaced."""
    log = _log(spark, root).collect()
    gone = []
    for table in {r.table for r in log}:
        before = sorted(r.trigger for r in log if r.table == table and r.snapshot)[:-1]
        gone += [r for r in log if before and r.table == table and (
            r.trigger < before[-1] or r.trigger == before[-1] and not r.snapshot)]
    for row in gone:
        remove(spark, row.path)
    newest = max((r.trigger for r in log), default=-1)
    for trigger in {r.trigger for r in gone} - {r.trigger for r in log if r not in gone} - {newest}:
        remove(spark, f"{root}/_commits/{trigger}")
    # A commit that still names a removed folder beside live ones is rewritten without it.
    for trigger in {r.trigger for r in gone} & {r.trigger for r in log if r not in gone}:
        rest = [tuple(r) for r in log if r.trigger == trigger and r not in gone]
        spark.createDataFrame(rest, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{root}/_commits/{trigger}")
