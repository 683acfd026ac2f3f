"""From reviewed clusters to decisions, observations, objects and final statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sightledger.functions.identity import hashed_id, resolve_identity
from sightledger.functions.validators import codes
from sightledger.schema import CLUSTER_MEMBER_REASON, IGNORE_REASON_PREFIX, SOURCE_FAILURES
from sightledger.session import union_all


def resolve_clusters(reviews: DataFrame, evidence: DataFrame, run_id: str) -> DataFrame:
    """Decision per cluster; new clusters get the id of the object they create."""
    e = evidence.select(
        "cluster_id", F.col("result").alias("evidence_result"),
        F.col("matched_object_id").alias("evidence_object_id"),
        F.to_json(F.struct(*[c for c in evidence.columns if c != "cluster_id"])).alias("evidence"),
    )
    df = reviews.join(e, "cluster_id")
    outcome = resolve_identity(
        F.col("verdict"), F.col("identity_hypothesis"), F.col("matched_object_id"),
        F.col("evidence_result"), F.col("evidence_object_id"),
    )
    df = df.withColumn("_o", outcome)
    object_id = (
        F.when(F.col("_o.decision") == "new", hashed_id("obj", F.lit(run_id), F.col("cluster_id")))
        .when(F.col("_o.decision") == "existing", F.col("matched_object_id"))
    )
    return df.select(
        *reviews.columns, "evidence", F.col("_o.decision").alias("decision"),
        F.col("_o.reason_code").alias("reason_code"),
        F.coalesce("_o.reason", "short_reason").alias("decision_reason"),
        object_id.alias("object_id"),
    )


def cluster_member_decisions(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """One decision per member of every cluster that was not ignored.

    In a new cluster the member with the smallest id is `new` and all others join the
    same object. The first member comes from a partial aggregate, not from a window.
    """
    live = resolved.filter(F.col("decision").isin("new", "existing", "uncertain"))
    m = members.select("cluster_id", F.col("id").alias("proposal_id"), "source_id")
    first = m.groupBy("cluster_id").agg(F.min("proposal_id").alias("_first"))
    df = m.join(first.join(live, "cluster_id"), "cluster_id")
    joins = (F.col("decision") == "new") & (F.col("proposal_id") != F.col("_first"))
    decision = F.when(joins, "existing").otherwise(F.col("decision"))
    conf = F.when(F.col("decision") != "uncertain", F.col("object_summary.summary_confidence"))
    return df.select(
        hashed_id("dec", F.col("proposal_id")).alias("id"), "proposal_id", "cluster_id", "source_id",
        decision.alias("decision"),
        F.when(decision == "existing", F.col("object_id")).alias("matched_object_id"),
        F.coalesce(conf, F.lit(0.0)).alias("confidence"),
        F.when(joins, "cluster_member").otherwise(F.col("reason_code")).alias("reason_code"),
        F.when(joins, F.lit(CLUSTER_MEMBER_REASON)).otherwise(F.col("decision_reason")).alias("short_reason"),
        F.col("identity_hypothesis").alias("hypothesis"),
        F.col("matched_object_id").alias("hypothesis_object_id"),
        "evidence", "object_id", F.lit(1).alias("attempt"),
    )


def observations_of(decisions: DataFrame) -> DataFrame:
    """Accepted decisions add one observation each, on the proposal's own source."""
    return decisions.filter(F.col("object_id").isNotNull()).select(
        hashed_id("obs", F.col("proposal_id")).alias("id"), "object_id", "proposal_id",
        "source_id", "cluster_id",
    )


def object_changes(resolved: DataFrame, *keys: str) -> DataFrame:
    """New objects and summary replacements; within a batch, or each of ``keys``, the last cluster wins."""
    accepted = resolved.filter(F.col("decision").isin("new", "existing"))
    return accepted.groupBy(F.col("object_id").alias("id"), *keys).agg(
        F.max_by("object_summary", "position").alias("summary"),
        F.bool_or(F.col("decision") == "new").alias("created"),
    )


def filter_cluster(members: DataFrame, resolved: DataFrame) -> DataFrame:
    """Members of ignored clusters become filtered, carrying the reviewer's reason."""
    ignored = resolved.filter(F.col("decision") == "ignored")
    return members.join(ignored.select("cluster_id", "short_reason"), "cluster_id").select(
        F.col("id").alias("proposal_id"), "source_id", F.col("cluster_id").alias("target_id"),
        F.lit("filtered").alias("status"),
        F.concat(F.lit(IGNORE_REASON_PREFIX + ":"), F.trim("short_reason")).alias("filter_reason"),
    )


def commit_violations(
    members: DataFrame, decisions: DataFrame, observations: DataFrame, resolved: DataFrame,
    objects: DataFrame, sources: DataFrame, stored_proposals: DataFrame,
) -> DataFrame:
    """Clusters that must not be written, with the broken rules. All-or-nothing each."""
    m = members.select("cluster_id", F.col("id").alias("proposal_id"), "source_id")
    working = sources.filter(F.col("status") == "processing").select(
        F.col("id").alias("source_id"), F.lit(True).alias("_working")).distinct()
    stored = stored_proposals.select(F.col("id").alias("proposal_id"), F.lit(True).alias("_stored"))
    obs = observations.select(
        "proposal_id", F.col("source_id").alias("_obs_source"), F.col("object_id").alias("_obs_object"))
    # Everything keyed by proposal ends here, its own number in the cluster included: what goes on to the sources and
    # the clusters is a few marks a member.
    first = F.row_number().over(W.partitionBy("proposal_id", "cluster_id").orderBy("source_id")) == 1
    per_member = (
        m.join(decisions.select("proposal_id", "decision", "matched_object_id", F.lit(True).alias("_d")),
               "proposal_id", "left")
        .join(obs, "proposal_id", "left").join(stored, "proposal_id", "left")
        .select("cluster_id", "source_id", "matched_object_id", "_obs_object", "_d",
                (first & F.col("proposal_id").isNotNull()).alias("_first"),
                *[(F.col("decision") == w).alias(f"_{w}") for w in ("new", "existing", "uncertain")],
                (F.col("_obs_source") != F.col("source_id")).alias("_moved"),
                F.col("_stored").isNotNull().alias("_stored"))
        .join(working, "source_id", "left")
    )
    stats = per_member.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_first").alias("ids"),
        F.count("_d").alias("decided"), F.count("_obs_object").alias("observed"),
        F.count_if("_new").alias("n_new"), F.count_if("_existing").alias("n_existing"),
        F.count_if("_uncertain").alias("n_uncertain"),
        F.min("matched_object_id").alias("lo"), F.max("matched_object_id").alias("hi"),
        F.min("_obs_object").alias("olo"), F.max("_obs_object").alias("ohi"),
        F.bool_or("_moved").alias("moved"), F.bool_or(F.col("_working").isNull()).alias("closed"),
        F.bool_or("_stored").alias("repeated"),
    )
    active = objects.filter(F.col("status") == "active").select(
        F.col("id").alias("object_id"), F.lit(True).alias("_active"))
    want = resolved.filter(F.col("decision") != "ignored").select(
        "cluster_id", F.col("decision").alias("want"), "object_id")
    df = stats.join(want, "cluster_id").join(active, "object_id", "left")
    new, old, unsure = (F.col("want") == w for w in ("new", "existing", "uncertain"))
    other = (F.col("lo") != F.col("object_id")) | (F.col("hi") != F.col("object_id"))
    bad = codes(
        proposals_not_unique=F.col("ids") != F.col("n"),
        decisions_incomplete=F.col("decided") != F.col("n"),
        new_count=new & ((F.col("n_new") != 1) | (F.col("n_existing") != F.col("n") - 1)),
        existing_count=old & (F.col("n_existing") != F.col("n")),
        uncertain_count=unsure & (F.col("n_uncertain") != F.col("n")),
        wrong_object=(new | old) & other,
        object_not_active=old & F.col("_active").isNull(),
        observations_incomplete=(new | old) & (F.col("observed") != F.col("n")),
        observation_wrong_object=(new | old)
        & ((F.col("olo") != F.col("object_id")) | (F.col("ohi") != F.col("object_id"))),
        observation_not_allowed=unsure & (F.col("observed") > 0),
        observation_wrong_source=F.col("moved"),
        source_not_processing=F.col("closed"),
        proposal_already_stored=F.col("repeated"),
    )
    return df.select("cluster_id", bad.alias("violations")).filter(F.size("violations") > 0)


def referential_checks(
    proposals: DataFrame, sources: DataFrame, objects: DataFrame, observations: DataFrame,
    decisions: DataFrame,
) -> DataFrame:
    """Rows that break a reference: (rule, id). Anti joins only."""
    def ids(df, name):
        return df.select(F.col("id").alias(name))

    def broken(rule, df):
        return df.select(F.lit(rule).alias("rule"), "id")

    active = objects.filter(F.col("status") == "active")
    named = decisions.filter(F.col("matched_object_id").isNotNull()).withColumnRenamed(
        "matched_object_id", "object_id")
    open_sources = sources.filter(F.col("status") == "processing")
    pending = proposals.filter(F.col("status") == "pending")
    twice = decisions.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return union_all([
        broken("proposal_without_source", proposals.join(ids(sources, "source_id"), "source_id", "left_anti")),
        broken("observation_without_proposal", observations.join(ids(proposals, "proposal_id"), "proposal_id", "left_anti")),
        broken("observation_without_active_object", observations.join(ids(active, "object_id"), "object_id", "left_anti")),
        broken("decision_without_proposal", decisions.join(ids(proposals, "proposal_id"), "proposal_id", "left_anti")),
        broken("decision_without_active_object", named.join(ids(active, "object_id"), "object_id", "left_anti")),
        broken("pending_on_closed_source", pending.join(ids(open_sources, "source_id"), "source_id", "left_anti")),
        twice.select(F.lit("proposal_decided_twice").alias("rule"), F.col("proposal_id").alias("id")),
    ])


def fail_propagation(clusters: DataFrame, batch_errors: DataFrame, cluster_errors: DataFrame) -> DataFrame:
    """A failed batch fails itself and all later batches of its run; an apply error
    fails only its own cluster. Output: clusters plus error (null when fine)."""
    first = batch_errors.groupBy("run_id").agg(
        F.min(F.struct("batch_id", "error")).alias("_first"))
    own = cluster_errors.select("run_id", "cluster_id", F.col("error").alias("_own"))
    stopped = F.col("batch_id") >= F.col("_first.batch_id")
    return (
        clusters.join(first, "run_id", "left").join(own, ["run_id", "cluster_id"], "left")
        .withColumn("error", F.when(stopped, F.col("_first.error")).otherwise(F.col("_own")))
        .drop("_first", "_own")
    )


def fail_members(members: DataFrame, failed: DataFrame) -> DataFrame:
    """Only members still pending turn failed; decided and filtered ones stay."""
    bad = failed.filter(F.col("error").isNotNull()).select("run_id", "cluster_id", "error")
    hit = (F.col("status") == "pending") & F.col("error").isNotNull()
    return (
        members.join(bad, ["run_id", "cluster_id"], "left")
        .withColumn("error_message", F.when(hit, F.col("error")))
        .withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("error")
    )


def fail_fingerprints(proposals: DataFrame, errors: DataFrame) -> DataFrame:
    """One failed fingerprint fails every pending candidate of its source."""
    bad = errors.groupBy("source_id").agg(F.min_by("error", "id").alias("_error"))
    hit = (F.col("status") == "pending") & F.col("_error").isNotNull()
    return (
        proposals.join(bad, "source_id", "left")
        .withColumn("error_message", F.when(hit, F.col("_error")))
        .withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).drop("_error")
    )


def finalize_sources(sources: DataFrame, proposals: DataFrame) -> DataFrame:
    """Processing sources close: any pending or failed proposal fails the source."""
    state = proposals.groupBy("source_id").agg(
        F.bool_or(F.col("status") == "pending").alias("_pending"),
        F.bool_or(F.col("status") == "failed").alias("_failed"),
    ).withColumnRenamed("source_id", "id")
    pending, failed = (F.coalesce(c, F.lit(False)) for c in ("_pending", "_failed"))
    closes = F.col("status") == "processing"
    return (
        sources.join(state, "id", "left")
        .withColumn("final_status", F.when(~closes, F.col("status"))
                    .when(pending | failed, "failed").otherwise("completed"))
        .withColumn("final_error",
                    F.when(closes & pending, SOURCE_FAILURES["pending"])
                    .when(closes & failed, SOURCE_FAILURES["failed"]))
        .drop("_pending", "_failed")
    )


def complete_runs(runs: DataFrame, sources: DataFrame, proposals: DataFrame, external: DataFrame) -> DataFrame:
    """Running runs complete, with errors when anything of theirs is unfinished."""
    src = sources.groupBy("run_id").agg(F.count_if(F.col("status") != "completed").alias("_s"))
    prop = (
        proposals.filter(F.col("status").isin("pending", "failed")).groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(sources.select(F.col("id").alias("source_id"), "run_id"), "source_id")
        .groupBy("run_id").agg(F.sum("n").alias("_p"))
    )
    ext = external.groupBy("run_id").agg(F.sum("errors").alias("_e"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    df = (
        runs.filter(F.col("status") == "running").withColumnRenamed("id", "run_id")
        .join(src, "run_id", "left").join(prop, "run_id", "left").join(ext, "run_id", "left")
    )
    unfinished = (n("_s") > 0) | (n("_p") > 0) | (n("_e") > 0)
    return df.select(
        "run_id", n("_s").alias("incomplete_sources"), n("_p").alias("incomplete_proposals"),
        n("_e").alias("external_errors"),
        F.when(unfinished, "completed_with_errors").otherwise("completed").alias("final_status"),
    )


def cluster_source_results(
    members: DataFrame, resolved: DataFrame, decisions: DataFrame, observations: DataFrame
) -> DataFrame:
    """Cluster outcomes attributed back to every member's source."""
    d = decisions.select("proposal_id", F.col("decision").alias("_decision"))
    o = observations.select("proposal_id", F.col("object_id").alias("_object"))
    final = F.col("decision")
    return (
        members.select("cluster_id", F.col("id").alias("proposal_id"), "source_id")
        .join(resolved, "cluster_id").join(d, "proposal_id", "left").join(o, "proposal_id", "left")
        .select(
            "source_id", "proposal_id", "cluster_id",
            F.when(final == "ignored", "filtered").otherwise("decided").alias("status"),
            F.coalesce("_decision", final).alias("decision"), F.col("_object").alias("object_id"),
            F.col("verdict").alias("cluster_verdict"),
            F.col("identity_hypothesis").alias("hypothesis"),
            F.col("matched_object_id").alias("hypothesis_object_id"),
        )
    )
