"""Counts, health checks and report roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightledger.schema import (
    CANDIDATE_SOURCE, CHECKS, DECISION, LEGACY_SCHEMA_VERSION, LIBRARY_DIRECTORIES, PROPOSAL_STATUS,
    SCHEMA_VERSION, SOURCE_STATUS,
)
from sightledger.session import union_all


def _zero(c) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def _status_counts(df: DataFrame, key: str, column: str, values, prefix: str) -> DataFrame:
    return df.groupBy(key).agg(*[
        F.count_if(F.col(column) == v).alias(f"{prefix}_{v}") for v in values
    ])


def run_summary(
    runs: DataFrame, sources: DataFrame, proposals: DataFrame, decisions: DataFrame,
    observations: DataFrame, objects: DataFrame,
) -> DataFrame:
    """Zero-filled status counts per run, observations added, active objects overall.

    Proposals and decisions are first counted per source, so what is joined to the
    source table is already small.
    """
    src_run = sources.select(F.col("id").alias("source_id"), "run_id")
    p_cols = [f"proposals_{v}" for v in PROPOSAL_STATUS]
    d_cols = [f"decisions_{v}" for v in DECISION]

    def to_run(per_source: DataFrame, cols) -> DataFrame:
        return per_source.join(src_run, "source_id").groupBy("run_id").agg(
            *[F.sum(c).alias(c) for c in cols])

    s = _status_counts(sources, "run_id", "status", SOURCE_STATUS, "sources")
    p = to_run(_status_counts(proposals, "source_id", "status", PROPOSAL_STATUS, "proposals"), p_cols)
    owner = proposals.select(F.col("id").alias("proposal_id"), "source_id")
    d = to_run(_status_counts(
        decisions.select("proposal_id", "decision").join(owner, "proposal_id"),
        "source_id", "decision", DECISION, "decisions"), d_cols)
    o = to_run(observations.groupBy("source_id").agg(F.count(F.lit(1)).alias("observations_added")),
               ["observations_added"])
    active = objects.agg(F.count_if(F.col("status") == "active").alias("active_objects_total"))
    counts = [f"sources_{v}" for v in SOURCE_STATUS] + p_cols + d_cols + ["observations_added"]
    df = runs.select(F.col("id").alias("run_id"), "status")
    for part in (s, p, d, o):
        df = df.join(part, "run_id", "left")
    return df.crossJoin(F.broadcast(active)).select(  # a single row
        "run_id", "status", *[_zero(c).alias(c) for c in counts], "active_objects_total")


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    frames = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    frames.append(tables["objects"].agg(F.count_if(F.col("status") == "active").alias("rows"))
                  .select(F.lit("active_objects").alias("table"), "rows"))
    return union_all(frames)


def runs_with_counts(runs: DataFrame, sources: DataFrame, proposals: DataFrame, observations: DataFrame) -> DataFrame:
    src = sources.groupBy("run_id").agg(F.count(F.lit(1)).alias("source_count"))
    owner = sources.select(F.col("id").alias("source_id"), "run_id")

    def per_run(df, name):
        per_source = df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
        return per_source.join(owner, "source_id").groupBy("run_id").agg(F.sum("n").alias(name))

    df = runs.withColumnRenamed("id", "run_id")
    for part in (src, per_run(proposals, "proposal_count"), per_run(observations, "observation_count")):
        df = df.join(part, "run_id", "left")
    names = ("source_count", "proposal_count", "observation_count")
    return df.select(*runs.drop("id").columns, "run_id", *[_zero(c).alias(c) for c in names])


def _truthy(*cols: Column) -> Column:
    """First non-null, non-zero value; zero falls through."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cols], F.lit(0))


def _nullish(*cols: Column) -> Column:
    """First non-null value; zero is kept."""
    return F.coalesce(*cols, F.lit(0))


def _image_sums(images: DataFrame, raw: Column) -> DataFrame:
    return images.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("input_files"),
        F.sum(raw).cast("long").alias("raw_candidates"),
        F.sum(F.coalesce("kept", F.lit(0))).cast("long").alias("kept"),
        F.sum(F.coalesce("filtered", F.lit(0))).cast("long").alias("filtered"),
        F.count_if(F.coalesce("duplicate", F.lit(False))).alias("duplicate_images"),
    )


_RAW = ("raw_candidates", "grid_points", "above_confidence_threshold_candidates")


REVIEW_NOTICE = "A passed structure report says nothing about semantic accuracy: inspect candidates, clusters, reviews, decisions and timelines."


def report_counts(sources: DataFrame, proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """(run_id, kind, status, n): sources, proposals and decisions of a run by status."""
    of_source = sources.select(F.col("id").alias("source_id"), "run_id")
    p = proposals.select(F.col("id").alias("proposal_id"), "source_id", "status").join(of_source, "source_id")
    d = decisions.select("proposal_id", "decision").join(p.select("proposal_id", "run_id"), "proposal_id")
    return union_all([
        df.groupBy("run_id", F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        for kind, df, status in (("source", sources, "status"), ("proposal", p, "status"), ("decision", d, "decision"))])


def _counts_by_run(counts: DataFrame) -> DataFrame:
    """One map status -> n per kind, and the number of sources; a run has a handful of statuses."""
    def as_map(kind):
        entries = F.collect_list(F.when(F.col("kind") == kind, F.struct("status", "n")))
        return F.map_from_entries(F.array_sort(entries)).alias(f"{kind}_counts")

    return counts.filter("status is not null").groupBy("run_id").agg(
        *[as_map(k) for k in ("source", "proposal", "decision")],
        F.sum(F.when(F.col("kind") == "source", F.col("n")).otherwise(0)).alias("unique_sources"))


def result_summary(reports: DataFrame, images: DataFrame, clusters: DataFrame, counts: DataFrame, errors: DataFrame) -> DataFrame:
    """Roll-up per run from report sections; the raw count skips zeros.

    counts: see `report_counts`; errors: see `error_digest`. Counts by status are maps.
    """
    img = _image_sums(images, _truthy(*[F.col(c) for c in _RAW]))
    clu = clusters.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("reviewed")).alias("reviewed_clusters"))
    by_decision = clusters.filter(F.col("final_decision").isNotNull()).groupBy("run_id", F.col("final_decision").alias("status")).agg(
        F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("cluster_counts"))
    faults = error_digest(errors).groupBy("run_id").agg(F.count(F.lit(1)).alias("error_count"))
    df = reports
    for part in (img, clu, by_decision, faults, _counts_by_run(counts)):
        df = df.join(part, "run_id", "left")
    return df.select(
        "run_id", "status", _zero("input_files").alias("input_files"), _zero("unique_sources").alias("unique_sources"),
        _zero("raw_candidates").alias("raw_candidates"), _zero("kept").alias("kept"),
        _zero("filtered").alias("filtered"), _zero("clusters").alias("clusters"),
        _zero("reviewed_clusters").alias("reviewed_clusters"),
        _zero("duplicate_sources_skipped").alias("duplicate_sources_skipped"),
        _zero("observations_added").alias("observations_added"),
        _zero("active_objects_total").alias("active_objects_total"),
        "source_counts", "proposal_counts", "decision_counts", "cluster_counts",
        _zero("error_count").alias("error_count"),
        F.lit(True).alias("manual_review_required"), F.lit(REVIEW_NOTICE).alias("review_notice"),
    )


def report_metrics(reports: DataFrame, images: DataFrame, clusters: DataFrame, counts: DataFrame) -> DataFrame:
    """The dashboard's twin of `result_summary`: the raw count keeps an explicit zero."""
    img = _image_sums(images, _nullish(*[F.col(c) for c in _RAW]))
    outcome = ("new", "existing", "ignored", "uncertain", "failed")
    clu = clusters.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("reviewed")).alias("reviewed_clusters"),
        *[F.count_if(F.col("final_decision") == o).alias(f"{o}_clusters") for o in outcome])
    df = reports.join(img, "run_id", "left").join(clu, "run_id", "left").join(_counts_by_run(counts), "run_id", "left")
    of = lambda kind, status: F.coalesce(F.try_element_at(f"{kind}_counts", F.lit(status)), F.lit(0))
    return df.select(
        "run_id", _zero("input_files").alias("inputs"), _zero("unique_sources").alias("unique_sources"),
        F.coalesce("duplicate_sources_skipped", _zero("duplicate_images")).alias("duplicates"),
        _zero("raw_candidates").alias("raw_candidates"), _zero("kept").alias("kept"),
        _zero("filtered").alias("script_filtered"), of("proposal", "filtered").alias("filtered"),
        _zero("clusters").alias("clusters"), _zero("reviewed_clusters").alias("reviewed_clusters"),
        *[_zero(f"{o}_clusters").alias(f"{o}_clusters") for o in outcome],
        *[of("decision", o).alias(f"{o}_count") for o in outcome[:4]], of("proposal", "failed").alias("failed_proposals"),
        _zero("observations_added").alias("observations"), _zero("active_objects_total").alias("objects"),
    )


def error_digest(errors: DataFrame) -> DataFrame:
    """First occurrence of each message per run, numbered in report order.

    errors: run_id, section (0 report.error, 1 report.progress_error, 2 external_errors,
    3 images, 4 clusters), item, field, position, source, type, message.
    """
    where = F.struct("section", "item", "field", "position")
    first = (
        errors.filter(F.coalesce("message", F.lit("")) != "")
        .groupBy("run_id", "message")
        .agg(F.min(where).alias("w"), F.min_by(F.struct("source", "type"), where).alias("s"))
    )
    return first.select("run_id", "message", F.col("s.source").alias("source"),
                        F.col("s.type").alias("type"), "w.*")


def dashboard_errors(errors: DataFrame) -> DataFrame:
    """The dashboard form: `type: message` when typed, once per run."""
    text = F.when(F.coalesce("type", F.lit("")) != "", F.concat("type", F.lit(": "), "message")).otherwise(
        F.col("message"))
    return errors.filter(F.coalesce("message", F.lit("")) != "").select(
        "run_id", text.alias("text")).distinct()


def model_usage(predictions: DataFrame) -> DataFrame:
    """Calls, tokens, seconds and peak memory per run and stage."""
    return predictions.groupBy("run_id", "stage").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("generated_tokens").alias("generated_tokens"),
        F.round(F.sum("inference_seconds"), 3).alias("inference_seconds"),
        F.round(F.max("peak_memory_mib"), 2).alias("peak_memory_mib"),
    )


def cluster_decision_counts(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy(
        "run_id", F.coalesce(F.nullif("final_decision", F.lit("")), F.lit("pending")).alias("decision")
    ).agg(F.count(F.lit(1)).alias("n"))


def structural_checks(
    runs: DataFrame, images: DataFrame, proposals: DataFrame, clusters: DataFrame
) -> DataFrame:
    """Eight named checks per run, long form; an empty set passes all but the first.

    images: run_id, duplicate, status; proposals: run_id, prompt, kept, has_fingerprint,
    status; clusters: run_id, final_decision.
    """
    i = images.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col("duplicate") | F.col("status").isin("completed", "failed")).alias("c2"),
        F.bool_and(F.col("duplicate") | (F.col("status") != "processing")).alias("c7"),
    )
    kept = F.col("kept")
    p = proposals.groupBy("run_id").agg(
        F.bool_and(F.col("prompt") == CANDIDATE_SOURCE).alias("c3"),
        F.bool_and(~kept | F.col("has_fingerprint") | (F.col("status") == "failed")).alias("c4"),
        F.bool_and(~kept | F.col("status").isin("decided", "filtered", "failed")).alias("c5"),
        F.bool_and(F.col("status") != "pending").alias("c8"),
    )
    c = clusters.groupBy("run_id").agg(F.bool_and(F.col("final_decision").isNotNull()).alias("c6"))
    df = runs.select(F.col("id").alias("run_id")).join(i, "run_id", "left").join(
        p, "run_id", "left").join(c, "run_id", "left")
    ok = lambda name: F.coalesce(name, F.lit(True))
    values = [F.coalesce("n", F.lit(0)) > 0, *[ok(f"c{k}") for k in range(2, 9)]]
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), v.alias("ok")) for n, v in zip(CHECKS, values)])
    return df.select("run_id", F.explode(pairs).alias("x")).select("run_id", "x.check", "x.ok")


def pipeline_status(runs: DataFrame, checks: DataFrame) -> DataFrame:
    passed = checks.groupBy("run_id").agg(F.bool_and("ok").alias("_ok"))
    done = F.col("status") == "completed"
    return runs.select(F.col("id").alias("run_id"), "status").join(passed, "run_id", "left").select(
        "run_id", F.when(done & F.coalesce("_ok", F.lit(False)), "passed").when(done, "failed")
        .otherwise(F.col("status")).alias("pipeline_status"))


def coverage_gates(summary: DataFrame) -> DataFrame:
    """Demo gates over run summaries; a failing gate moves the status aside."""
    s = summary.select(
        "run_id", "status", (F.col("proposals_filtered") >= 1).alias("filtered_candidate_observed"),
        ((F.col("decisions_new") >= 2) & (F.col("active_objects_total") >= 2))
        .alias("at_least_two_new_object_archives"),
        (F.col("decisions_existing") >= 1).alias("same_object_observation_was_merged"),
        (F.col("duplicate_sources_skipped") >= 1).alias("exact_duplicate_image_was_skipped"),
        ((F.col("proposals_pending") == 0) & (F.col("proposals_failed") == 0))
        .alias("no_pending_or_failed_proposals"),
    )
    gates = (
        F.col("at_least_two_new_object_archives") & F.col("same_object_observation_was_merged")
        & F.col("exact_duplicate_image_was_skipped") & F.col("no_pending_or_failed_proposals")
    )
    good = (F.col("status") == "passed") & gates
    return s.withColumn("pipeline_status", F.when(~good, F.col("status"))).withColumn(
        "status", F.when(good, "passed").otherwise("failed"))


def library_health(
    manifest: DataFrame, runs: DataFrame, sources: DataFrame, proposals: DataFrame,
    objects: DataFrame, observations: DataFrame,
) -> DataFrame:
    """Health ladder per library. All tables carry library_id.

    manifest: library_id, root_is_file, database_is_link, has_database, readable,
    schema_version, directories (array), has_content, active.
    """
    latest = runs.groupBy("library_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max_by("started_at", F.struct("started_at", "id")).alias("latest_run_at"),
        F.bool_or(F.col("status") != "completed").alias("_r"),
    )
    src = sources.groupBy("library_id").agg(F.bool_or(F.col("status") != "completed").alias("_s"))
    prop = proposals.groupBy("library_id").agg(
        F.bool_or(F.col("status").isin("pending", "failed")).alias("_p"))
    obj = objects.groupBy("library_id").agg(F.count_if(F.col("status") == "active").alias("active_objects"))
    obs = observations.groupBy("library_id").agg(F.count(F.lit(1)).alias("observations"))
    df = manifest
    for part in (latest, src, prop, obj, obs):
        df = df.join(part, "library_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    missing = F.size(F.array_except(F.array(*[F.lit(d) for d in LIBRARY_DIRECTORIES]), "directories")) > 0
    supported = F.coalesce(F.col("schema_version").isin(LEGACY_SCHEMA_VERSION, SCHEMA_VERSION), F.lit(False))
    code = (
        F.when(F.col("active"), F.lit(None).cast("string"))
        .when(F.col("root_is_file"), "invalid_library_root")
        .when(F.col("database_is_link"), "database_symlink")
        .when(F.col("has_database") & (~F.col("readable") | ~supported), "database_unreadable")
        .when(F.col("has_database") & (flag("_r") | flag("_s") | flag("_p")), "incomplete_run")
        .when(F.col("has_database") & missing, "missing_asset_directories")
        .when(F.col("has_database") & (F.col("schema_version") < SCHEMA_VERSION), "legacy_read_only")
        .when(~F.col("has_database") & F.col("has_content"), "partial_without_database")
    )
    df = df.withColumn("issue_code", code)
    broken = ("invalid_library_root", "database_symlink", "database_unreadable")
    status = (
        F.when(F.col("active"), "running")
        .when(F.col("issue_code").isin(*broken), "unreadable")
        .when(F.col("issue_code").isNotNull(), "review_only")
        .when(F.col("has_database"), "ready").otherwise("empty")
    )
    shown = F.col("has_database") & ~F.coalesce(F.col("issue_code").isin(*broken), F.lit(False))
    return df.select(
        "library_id", status.alias("status"), status.isin("ready", "empty").alias("continuable"),
        "issue_code", *[F.when(shown, _zero(c)).otherwise(F.lit(0)).alias(c)
                        for c in ("active_objects", "observations", "runs")],
        F.when(shown, F.col("latest_run_at")).alias("latest_run_at"),
    )


def stage_metrics(images: DataFrame, clusters: DataFrame) -> DataFrame:
    """Dashboard numbers per run: images, kept candidates, cluster outcomes."""
    i = images.groupBy("run_id").agg(
        F.count_if(~F.coalesce("duplicate", F.lit(False)) & F.col("source_id").isNotNull()).alias("unique_images"),
        F.sum(F.coalesce("kept", F.lit(0))).cast("long").alias("kept"),
    )
    c = clusters.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("member_count").cast("long").alias("members"),
        F.count_if(F.col("source_count") > 1).alias("multi_view"),
        F.count_if(F.col("reviewed") | F.col("final_decision").isNotNull()).alias("reviewed"),
        F.count_if(F.col("final_decision").isin("new", "existing")).alias("formed"),
        F.count_if(F.col("final_decision").isin("ignored", "uncertain")).alias("filtered_or_open"),
    )
    names = ("unique_images", "kept", "clusters", "members", "multi_view", "reviewed", "formed",
             "filtered_or_open")
    return i.join(c, "run_id", "full_outer").select("run_id", *[_zero(n).alias(n) for n in names])
