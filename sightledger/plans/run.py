"""One resolution run, from files to ledger and report, that can be started again at any point.

Each stage leaves a table and a record of it, each review batch a ledger commit. A run that was stopped is started
again with the same id: recorded stages are read, published batches are kept, and what follows is done as if nothing
had happened. A run that is closed changes nothing more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sightledger.functions.vectors import l2_normalize
from sightledger.operators import commit as CM
from sightledger.operators.candidates import process_candidates
from sightledger.operators.registration import digests, register_sources
from sightledger.operators.review import guarded
from sightledger.params import Params
from sightledger.plans.resolve import Reviewer, build_clusters, review_loop, rule_reviewer
from sightledger.sources import fingerprints as FP, ledger as L, reports as RP
from sightledger.sources.assets import scan_assets
from sightledger.session import distributed_row_number, union_all

CANDIDATE_SQL = ("source_id string, raw_candidate_id string, score double, image_w int, image_h int, "
                 "bbox struct<x_min:double,y_min:double,x_max:double,y_max:double>, runs array<struct<start:bigint,len:int>>")
FINGERPRINT_SQL = "id string, source_id string, score double, vector array<float>, local array<array<float>>"


@dataclass(frozen=True)
class Plugins:
    """User functions. ``segment`` and ``embed`` are loaders: called once per task, they return a batch function.

    segment: rows of source_id, path, content -> rows of CANDIDATE_SQL; embed: rows of id, source_id, score, bbox
    corners -> rows of FINGERPRINT_SQL; review: see ``resolve.Reviewer``.
    """
    segment: Callable
    embed: Callable
    review: Reviewer = rule_reviewer
    models: tuple[str, str, str] = ("segmenter", "embedder", "reviewer")


class Stages:
    """Tables of the stages that are done, by name. A stage counts once its record is written."""

    _RECORD = T.StructType([T.StructField("stage", T.StringType()), T.StructField("path", T.StringType())])

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        try:
            rows = spark.read.schema(self._RECORD).parquet(f"{folder}/_stages").collect()  # a row per stage
        except Exception:
            rows = []
        self.done = {r.stage: r.path for r in rows}

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.done:
            path = f"{self.folder}/{name}_{uuid.uuid4().hex}"
            make().write.parquet(path)
            self.spark.createDataFrame([(name, path)], self._RECORD).coalesce(1).write.mode("append").parquet(f"{self.folder}/_stages")
            self.done[name] = path
        return self.spark.read.parquet(self.done[name])


class BatchCommits:
    """Ledger commits of a run's review batches: one per batch, or per group of batches that were reviewed at once."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, candidates: DataFrame, at: datetime):
        self.spark, self.root, self.prefix, self.candidates, self.at = spark, root, f"{run_id}:batch:", candidates, at

    def batches(self) -> list[int]:
        """Last batch of every published commit."""
        return [int(c.rsplit(":", 1)[1]) for c in L.published(self.spark, self.root, self.prefix)]

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        at = F.lit(self.at).cast("timestamp")
        ended = tables["decisions"].select("proposal_id", F.lit("decided").alias("status"), F.lit(None).cast("string").alias("filter_reason"), F.col("cluster_id").alias("target_id"))
        ended = ended.unionByName(tables["filtered"].select("proposal_id", "status", "filter_reason", "target_id"))
        rows = self.candidates.drop("status", "filter_reason").join(ended.withColumnRenamed("proposal_id", "id"), "id")
        L.write_commit(self.spark, self.root, f"{self.prefix}{batch_id:09d}", {
            "objects": tables["changes"].withColumn("created_at", at),
            "observations": tables["observations"].withColumn("created_at", at),
            "decisions": tables["decisions"].withColumn("created_at", at),
            "proposals": rows.withColumn("created_at", at)})


def history_of(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(stored views with their vectors, objects in all versions) of a ledger."""
    tables = L.read_ledger(spark, root)
    try:
        stored, _ = FP.read_fingerprints(spark, f"{root}/fingerprints")
    except Exception:  # no run has stored one yet
        stored = spark.createDataFrame([], FP.FINGERPRINT)
    views = tables["observations"].join(stored.select("proposal_id", "vector", "local"), "proposal_id")
    return views.select("object_id", F.col("id").alias("observation_id"), "vector", "local"), tables["objects"].select(
        "id", "version", "summary", "status")


def run_directory(spark: SparkSession, root: str, directory: str, plugins: Plugins, p: Params, run_id: str, at: datetime) -> DataFrame:
    """A run over the image files below a directory; see ``run_assets``."""
    return run_assets(spark, root, scan_assets(spark, directory), plugins, p, run_id, at)


def _sources(spark, root, assets, run_id) -> DataFrame:
    """Every input with its content hash and what became of it: new, resumed, duplicate or conflict."""
    hashed = distributed_row_number(digests(assets.select("path", "name", "content")), [], [F.lower("path"), F.col("path")], "ordinal")
    known = L.read_ledger(spark, root)["source_images"].groupBy("sha256").agg(
        F.max_by(F.struct("run_id", "status"), F.struct("created_at", "run_id")).alias("s")).select("sha256", "s.run_id", "s.status")
    return register_sources(hashed.withColumn("run_id", F.lit(run_id)), known)


def _source_errors(segmented: DataFrame, prints: DataFrame, working: DataFrame) -> DataFrame:
    """(source_id, error): a failed image or fingerprint fails its source, a failed load all that were at work."""
    errors = segmented.filter("error is not null").select("source_id", F.lit(0).alias("step"), "error_kind", F.lit("").alias("id"), "error")
    errors = errors.unionByName(prints.filter("error is not null").select("source_id", F.lit(1).alias("step"), "error_kind", "id", "error"))
    first = errors.groupBy("source_id").agg(F.min_by("error", F.struct("step", "id")).alias("error"))
    load = errors.filter("error_kind = 'load'").agg(F.min_by("error", "step").alias("e"), F.min("step").alias("s")).first()
    if load["e"] is None:
        return first
    reached = working.select("source_id") if load["s"] == 0 else prints.select("source_id").distinct()
    return first.join(reached.withColumn("_load", F.lit(load["e"])), "source_id", "full_outer").select(
        "source_id", F.coalesce("error", "_load").alias("error"))


def run_assets(spark: SparkSession, root: str, assets: DataFrame, plugins: Plugins, p: Params, run_id: str, at: datetime) -> DataFrame:
    """One run over assets (path, name, content): sources, candidates, fingerprints, clusters, reviews, ledger, report.

    ``root`` holds the ledger, the fingerprint store, the reports and the run's own tables; it is made if it is not
    there. ``at`` is the time that rows of this run carry. Returns (source_id, sha256, status) of the run's sources.
    """
    if not L.has_ledger(spark, root):
        L.init_ledger(spark, root)
    stages = Stages(spark, f"{root}/_runs/{run_id}")
    closed = f"{run_id}:close"
    registered = stages.table("sources", lambda: _sources(spark, root, assets, run_id))
    working = registered.filter(F.col("outcome").isin("new", "resumed")).select("source_id", "path")
    if closed in L.published(spark, root, closed):
        return _result(spark, root, run_id)
    content = working.join(assets.select("path", "content"), "path")
    segmented = stages.table("segmented", lambda: guarded(content.select("source_id", "path", "content"), plugins.segment, CANDIDATE_SQL, ("source_id",)))
    broken = segmented.filter("error is not null").select("source_id").distinct()
    processed = stages.table("candidates", lambda: process_candidates(
        segmented.join(broken, "source_id", "left_anti").drop("error", "error_kind"), p))
    kept = processed.filter("status = 'pending'").select("id", "source_id", "score", "bbox.*")
    prints = stages.table("fingerprints", lambda: guarded(kept, plugins.embed, FINGERPRINT_SQL, ("id", "source_id")))
    failed = stages.table("failed_sources", lambda: _source_errors(segmented, prints, working))
    good = prints.filter("error is null").join(failed.select("source_id"), "source_id", "left_anti").drop("error", "error_kind")
    members, clusters = _clusters(stages, good, p)
    history, objects = history_of(spark, root)
    before = stages.table("history", lambda: history)
    known = stages.table("objects", lambda: objects)
    open_sources = registered.filter("outcome in ('new', 'resumed')").select(F.col("source_id").alias("id"), "status")
    result = review_loop(
        members, clusters, good, before, known, plugins.review, p, run_id,
        open_sources.join(failed.select(F.col("source_id").alias("id")), "id", "left_anti"), None, f"{root}/_runs/{run_id}/loop",
        BatchCommits(spark, root, run_id, processed, at))
    # Fingerprints of what was accepted are the history of later runs; they count once the run is closed.
    accepted = good.join(result.observations.select(F.col("proposal_id").alias("id")), "id", "left_semi")
    stages.table("stored", lambda: _store(spark, root, accepted, plugins.models[1], p))
    return _close(spark, root, run_id, registered, processed, prints, failed, result, plugins, at)


def _clusters(stages: Stages, good: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    made: list = []

    def both(which):
        if not made:
            made.extend(build_clusters(good, p))
        return made[which]

    return stages.table("members", lambda: both(0)), stages.table("clusters", lambda: both(1))


def _store(spark, root, accepted: DataFrame, model: str, p: Params) -> DataFrame:
    """A7: quantised fingerprints with their hashes. A run that stops here may store some twice, with equal rows."""
    rows = accepted.select(F.col("id").alias("proposal_id"), "source_id", "vector", "local",
                           F.array().cast("array<struct<r:int,c:int>>").alias("patch_rc"))
    try:
        there = spark.read.schema(FP.FINGERPRINT).parquet(f"{root}/fingerprints").select("proposal_id")
        rows = rows.join(there, "proposal_id", "left_anti")
    except Exception:
        pass
    FP.write_fingerprints(FP.quantise(rows, model, "1", "last", 0), f"{root}/fingerprints")
    return accepted.select("id")


def _close(spark, root, run_id, registered, processed, prints, failed, result, plugins: Plugins, at: datetime) -> DataFrame:
    """Final statuses of proposals, sources and the run, in one commit, then the report."""
    stamp = F.lit(at).cast("timestamp")
    cause = failed.withColumnRenamed("error", "_cause")
    # What no batch has ended: filtered candidates, failed clusters, and all that is pending on a failed source.
    outcomes = result.outcomes.select(F.col("proposal_id").alias("id"), F.col("status").alias("_status"), F.col("error").alias("_error"))
    state = processed.join(outcomes, "id", "left").join(cause, "source_id", "left")
    ended = F.col("_status").isin("decided", "filtered")
    pending = F.col("status") == "pending"
    lost = pending & ~F.coalesce(ended, F.lit(False))
    state = state.withColumn("final", F.when(lost, "failed").when(pending, F.col("_status")).otherwise(F.col("status")))
    state = state.withColumn("error_message", F.when(lost, F.coalesce("_error", "_cause", F.lit("no fingerprint"))))
    rest = state.filter(~(pending & F.coalesce(ended, F.lit(False)))).drop("status").withColumnRenamed("final", "status")
    mine = registered.filter("status = 'processing' and outcome in ('new', 'resumed')").select(
        F.col("source_id").alias("id"), "run_id", "sha256", F.col("path").alias("relative_path"), "status")
    statuses = state.select("source_id", F.col("final").alias("status"))
    sources = CM.finalize_sources(mine, statuses).join(cause.withColumnRenamed("source_id", "id"), "id", "left").select(
        "id", "run_id", "sha256", "relative_path",
        F.when(F.col("_cause").isNotNull(), "failed").otherwise(F.col("final_status")).alias("status"),
        F.coalesce("_cause", "final_error").alias("error_message"), stamp.alias("created_at"))
    running = spark.createDataFrame([(run_id, "running")], "id string, status string")
    errors = failed.agg(F.count(F.lit(1)).cast("int").alias("errors")).select(F.lit(run_id).alias("run_id"), "errors")
    closing = CM.complete_runs(running, sources, state.select("source_id", F.col("final").alias("status")), errors)
    runs = closing.select(
        F.col("run_id").alias("id"), F.col("final_status").alias("status"), stamp.alias("started_at"), stamp.alias("completed_at"),
        F.lit(plugins.models[0]).alias("segmenter_model_id"), F.lit(plugins.models[1]).alias("embedder_model_id"),
        F.lit(plugins.models[2]).alias("reviewer_model_id"))
    _report(spark, root, run_id, registered, processed, prints, sources, closing, result)
    L.write_commit(spark, root, f"{run_id}:close", {
        "runs": runs, "source_images": sources, "proposals": rest.withColumn("created_at", stamp)})
    return _result(spark, root, run_id)


def _report(spark, root, run_id, registered, processed, prints, sources, closing, result) -> None:
    """A9: header, images and clusters of the run. A report written again replaces itself."""
    per = processed.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("raw_candidates"), F.count_if(F.col("status") == "pending").alias("kept"),
        F.count_if(F.col("status") == "filtered").alias("filtered"))
    done = prints.filter("error is null").groupBy("source_id").agg(F.count(F.lit(1)).alias("fingerprints"))
    images = registered.select("run_id", "source_id", "path", "ordinal", (F.col("outcome") == "duplicate").alias("duplicate")).join(
        per, "source_id", "left").join(done, "source_id", "left").join(
        sources.select(F.col("id").alias("source_id"), "status", F.col("error_message").alias("error")), "source_id", "left")
    sizes = result.members.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.countDistinct("source_id").alias("source_count"))
    clusters = result.clusters.join(sizes, "cluster_id").withColumn("run_id", F.lit(run_id))
    header = closing.withColumnRenamed("final_status", "status")
    RP.replace_report(RP.report_sections(header, images, clusters), f"{root}/reports", run_id)


def _result(spark, root, run_id) -> DataFrame:
    rows = L.read_ledger(spark, root)["source_images"].filter(F.col("run_id") == run_id)
    return rows.select(F.col("id").alias("source_id"), "sha256", "status")
