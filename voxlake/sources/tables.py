"""Stage tables and incremental upkeep.

Stage outputs are immutable Parquet folders, one partition per run; the current state is the newest run of each call.
Spark's commit protocol makes each append all-or-nothing, and a failed run leaves nothing visible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.utils import AnalysisException

from voxlake.sources.snapshots import Snapshots, State


def write_transcripts(segments: DataFrame, path: str) -> None:
    """Segments by provider; running again replaces that provider's partition only."""
    segments.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("provider").parquet(path)


def append_run(df: DataFrame, path: str, run_id: int) -> None:
    """Add a run. Writing the same run again replaces it, so a retried job leaves it once; other runs are not touched."""
    run = df.withColumn("run_id", F.lit(run_id).cast("bigint"))
    run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def table_stage(root: str, run_id: int) -> Callable[[str, DataFrame], DataFrame]:
    """A stage writer for `analyse`: each stage result becomes one run of its own table and is read back from there."""

    def stage(name: str, df: DataFrame) -> DataFrame:
        path = f"{root.rstrip('/')}/{name}"
        append_run(df, path, run_id)
        schema = StructType(list(df.schema.fields)).add("run_id", LongType())
        return df.sparkSession.read.schema(schema).parquet(path).where(F.col("run_id") == run_id).drop("run_id")

    return stage


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty frame of `schema` when nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def latest(stage: DataFrame, key: str = "call_id", touched: DataFrame | None = None) -> DataFrame:
    """Rows of the newest run per key. `touched` names runs that hold a key without rows, so an emptied call stays empty."""
    log = stage.select(key, "run_id")
    if touched is not None:
        log = log.unionByName(touched.select(key, F.col("run_id").cast("bigint")))
    newest = log.groupBy(key).agg(F.max("run_id").alias("run_id"))
    return stage.join(newest, [key, "run_id"], "left_semi")


def upsert_dimension(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: unknown keys only, the earliest by `order` where a batch has several. First writer wins."""
    columns = [c for c in incoming.columns if c not in (key, order)]
    first = incoming.groupBy(key).agg(F.min(F.struct(order, *columns)).alias("_f"))
    return first.select(key, *[F.col(f"_f.{c}").alias(c) for c in columns]).join(existing.select(key), key, "left_anti")


REPLACED = ("audio_path", "transcript_provider", "transcribed_at")


def upsert_calls(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merged calls: new ones added; known ones keep everything but path, provider and transcription time."""
    old, new = existing.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col("o.call_id") == F.col("n.call_id"), "full_outer")
    merged = [
        F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        if c in REPLACED
        else F.when(F.col("o.call_id").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        if c in incoming.columns
        else F.col(f"o.{c}").alias(c)
        for c in existing.columns
    ]
    return joined.select(*merged)


def replace_calls(existing: DataFrame, incoming: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Replace all rows of the affected calls (those in `calls`, else those in `incoming`)."""
    affected = (calls if calls is not None else incoming).select("call_id").distinct()
    return existing.join(affected, "call_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def drop_calls(existing: DataFrame, calls: DataFrame) -> DataFrame:
    return existing.join(calls.select("call_id"), "call_id", "left_anti")


def not_yet_transcribed(wanted: DataFrame, calls: DataFrame, provider: str | None = None) -> DataFrame:
    """Calls still to transcribe. A call done by another provider counts as not done when `provider` is given."""
    done = calls.where(F.col("transcribed_at").isNotNull())
    if provider is not None:
        done = done.where(F.col("transcript_provider") == provider)
    return wanted.join(done.select("call_id"), "call_id", "left_anti")


def pending_analysis(
    calls: DataFrame, judged: DataFrame, reanalyze: bool = False, call_id=None, limit: int | None = None
) -> DataFrame:
    chosen = calls.where(F.col("transcribed_at").isNotNull()) if "transcribed_at" in calls.columns else calls
    if call_id is not None:
        chosen = chosen.where(F.col("call_id") == call_id)
    if not reanalyze:
        chosen = chosen.join(judged.select("call_id"), "call_id", "left_anti")
    return chosen if limit is None else chosen.orderBy("call_id").limit(limit)


JUDGED = (
    "intent_label", "resolution_status", "summary", "mood_shift_turn_index", "attention_score", "factors", "analyzed_at",
)


def invalidate(
    calls: DataFrame, evidence: DataFrame, call_clusters: DataFrame, affected: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forget judgments, citations and cluster membership of the affected calls."""
    marked = calls.join(affected.select("call_id", F.lit(True).alias("_hit")).distinct(), "call_id", "left")
    cleared = marked.select(
        *[
            F.when(F.col("_hit").isNull(), F.col(c)).alias(c) if c in JUDGED else F.col(c)
            for c in calls.columns
        ]
    )
    return cleared, drop_calls(evidence, affected), drop_calls(call_clusters, affected)


def cluster_tables(labels: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(issue_clusters, call_clusters)`: one cluster per call, noise left out."""
    issues = names.select("cluster_id", "label", F.current_timestamp().alias("created_at"))
    bridge = labels.where(F.col("cluster_id").isNotNull()).select(F.col("id").alias("call_id"), "cluster_id")
    return issues, bridge


def refresh_clusters(labels: DataFrame, names: DataFrame, root: str, min_age: float = 86_400.0) -> State:
    """Replace both tables as one state, and remove what earlier and failed runs have left."""
    issues, bridge = cluster_tables(labels, names)
    store = Snapshots(labels.sparkSession, root)
    state = store.commit({"issue_clusters": issues, "call_clusters": bridge})
    store.clean(keep=2, min_age=min_age)
    return state


def split_failures(outcome: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an `error`, and `(call_id, error)` of the rest. The stage is committed for the good ones only."""
    return outcome.where(F.col("error").isNull()).drop("error"), outcome.where(F.col("error").isNotNull()).select(
        "call_id", "error"
    )
