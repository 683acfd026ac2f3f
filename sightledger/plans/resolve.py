"""End-to-end resolution: cluster, review batch by batch, decide, close."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from sightledger.functions.identity import hashed_id
from sightledger.operators import clustering as K, commit as CM, matching as M
from sightledger.operators.candidates import process_candidates
from sightledger.operators.review import embed, review_coverage, rule_review
from sightledger.params import Params
from sightledger.plans import maxima as MX
from sightledger.plans.maxima import Batches, Maxima, new_folder, only, together
from sightledger.session import materialize, shared_dir

Reviewer = Callable[[DataFrame, DataFrame], DataFrame]


# Frames of a run in which no cluster was accepted.
_OUTCOMES = "cluster_id string, batch_id long, final_decision string, object_id string, error string"
_OBSERVATIONS = "id string, object_id string, proposal_id string, source_id string, cluster_id string"
_FILTERED = "proposal_id string, source_id string, target_id string, status string, filter_reason string"
_DECISIONS = (
    "id string, proposal_id string, cluster_id string, source_id string, decision string, matched_object_id string, "
    "confidence double, reason_code string, short_reason string, hypothesis string, hypothesis_object_id string, "
    "evidence string, object_id string, attempt int"
)


@dataclass
class Resolution:
    clusters: DataFrame      # cluster_id, batch_id, final_decision, object_id, error
    members: DataFrame       # cluster_id, id, source_id
    decisions: DataFrame
    observations: DataFrame
    filtered: DataFrame
    objects: DataFrame       # id, version (0 = stored before), summary, status
    outcomes: DataFrame      # one row per proposal: its final status


def build_clusters(fingerprints: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(members, clusters with batch ids). fingerprints: id, source_id, score, vector, ..."""
    labelled = materialize(K.constrained_clusters(fingerprints, p.cluster_similarity, p))
    sized = labelled.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.countDistinct("source_id").alias("source_count"))
    return labelled, materialize(K.assign_review_batches(sized, p.max_clusters_per_batch))


def _window(sizes: dict[int, int], start: int, last: int, bound: int) -> int:
    """The last batch of those that go at once: as many as have members up to a bound."""
    end, rows = start, sizes[start]
    while end < last and rows + sizes[end + 1] <= bound:
        end += 1
        rows += sizes[end]
    return end


def _by_rule(reviews, reviewer: Reviewer):
    """Reviews of a batch, or why there are none."""
    try:
        return materialize(reviewer(*reviews)), None
    except Exception as error:  # whatever the reviewer's code raises fails its batch, not the run
        return None, f"reviewer_error:{type(error).__name__}"


class _Loop:
    """Tables of a review loop: one directory per batch each, in a folder that outlives the driver if it is named."""

    NAMES = ("decisions", "observations", "filtered", "outcomes", "changes", "views")

    def __init__(self, spark, folder: str, seeds: dict):
        self.tables = {n: Batches(spark, f"{folder}/{n}", seeds[n]) for n in self.NAMES}

    def put(self, batch_id: int, rows: dict[str, DataFrame]) -> None:
        # Independent small writes: their jobs run side by side.
        with ThreadPoolExecutor(len(rows)) as pool:
            list(pool.map(lambda item: self.tables[item[0]].put(item[1], batch_id), rows.items()))

    def of(self, name: str, batch_id: int) -> DataFrame:
        return self.tables[name].of(batch_id)

    def all(self, name: str) -> DataFrame:
        return self.tables[name].all()


def review_loop(
    members: DataFrame, clusters: DataFrame, fingerprints: DataFrame, history: DataFrame,
    objects: DataFrame, reviewer: Reviewer, p: Params, run_id: str, sources: DataFrame | None = None,
    stored: DataFrame | None = None, state: str | None = None, commits=None,
) -> Resolution:
    """Review batches in order. Each batch sees the objects and views all earlier batches
    left behind, and one snapshot for all of its clusters. A rejected batch, or one whose
    reviewer raises, fails itself and everything after it; a cluster that breaks a commit
    rule fails alone.

    What a batch needs of the past is kept up to date: the nearest objects of every waiting query follow the new
    views of each batch (``Maxima``), so no batch looks at all stored views again.

    A reviewer marked ``repeatable`` looks at the evidence only and may be asked again. Then many batches go at once:
    all are reviewed as if none of them added a view, the views that this would add are assumed, each for the batches
    after its own, and so on until nothing changes. The first batch is right at once, and every round makes at least
    one more right, so the end is what one batch after the other gives; rounds follow the longest chain of clusters
    that depend on each other, not the number of batches. Other reviewers are asked once per batch.

    ``sources`` (id, status) are the sources as they stand, all of them open without it; ``stored`` (id) are the
    proposals that earlier runs have stored. With ``state`` and ``commits`` the loop can be restarted: batches count
    once ``commits.write(last of them, tables)`` has returned, and a new call goes on after ``commits.batches()``.
    """
    spark = members.sparkSession
    shape = history.select("object_id", "observation_id", "vector", "local").schema
    # Versions go on from what is stored, so a later run always holds the higher number.
    version = F.col("version").cast("long") if "version" in objects.columns else F.lit(0).cast("long")
    seed = materialize(objects.select("id", version.alias("version"), "summary", "status"))
    base = seed.agg(F.max("version")).first()[0] or 0
    loop = _Loop(spark, state or new_folder(shared_dir(spark), "loop"), {
        "decisions": _DECISIONS, "observations": _OBSERVATIONS, "filtered": _FILTERED, "outcomes": _OUTCOMES,
        "changes": seed.schema, "views": shape})
    queries = members.join(clusters.select("cluster_id", F.col("batch_id").cast("long").alias("query_batch")), "cluster_id").join(
        fingerprints.select("id", "vector", "local"), "id").select(
        F.col("id").alias("query_id"), "query_batch", "cluster_id", "source_id", "vector", "local")
    maxima = Maxima(materialize(queries), M.active_fingerprints(history, seed), p)
    open_sources = sources if sources is not None else members.select(
        F.col("source_id").alias("id"), F.lit("processing").alias("status")).distinct()
    sizes = {r.batch_id: r.n for r in clusters.groupBy("batch_id").agg(F.sum("member_count").alias("n")).collect()}  # a row per batch
    last = max(sizes, default=0)
    finished = commits.batches() if commits else []
    for number in finished:
        for table in loop.tables.values():
            table.keep(number)
    start = max(finished, default=0) + 1
    if finished:
        views = loop.all("views")
        maxima.add(views, start - 1, views.count())
    failed, alone = None, not getattr(reviewer, "repeatable", False)
    bound = MX.WINDOW_ROWS
    while start <= last and failed is None:
        current = seed.unionByName(loop.all("changes"))
        nothing = current.limit(1).isEmpty()
        # The first object ever must be new, which is a rule for one batch.
        end = start if alone or nothing else _window(sizes, start, last, bound)
        rows = sum(sizes[b] for b in range(start, end + 1))
        small = rows <= MX.SENT_VIEWS

        def kept(df, small=small):
            """Batches of usual size lie in one partition, and nothing they are joined with moves."""
            return together(materialize(together(df, small)), small)

        batch = kept(clusters.filter(F.col("batch_id").between(start, end)))
        mine = maxima.of(start, end, rows).select(F.col("query_id").alias("id"), "cluster_id", "source_id", "vector", "local")
        newest = current.groupBy("id").agg(
            F.max_by("summary", "version").alias("summary"), F.max_by("status", "version").alias("status"))
        assumed, before, resolved = None, None, None
        while True:
            cluster_ev = kept(M.cluster_evidence(mine.select("cluster_id", "id"), maxima.evidence(start, end, rows, assumed)))
            reviews, why = _by_rule((batch.join(cluster_ev, "cluster_id"), newest.filter(F.col("status") == "active")), reviewer)
            if why is not None:
                break
            reviews = together(reviews, small)
            resolved = kept(CM.resolve_clusters(reviews, cluster_ev, run_id).join(
                batch.select("cluster_id", "position", "batch_id"), "cluster_id"))
            if start == end:
                break
            now = {r.cluster_id: r.object_id for r in resolved.select("cluster_id", "object_id").collect()}  # a window's clusters
            if now == before:
                break
            before = now
            assumed = mine.select(F.col("id").alias("query_id"), "cluster_id").join(
                resolved.filter("object_id is not null").select("cluster_id", "object_id"), "cluster_id").select(
                "query_id", "object_id", hashed_id("obs", F.col("query_id")).alias("observation_id"))
        if why is not None and start < end:
            alone = True  # one of these batches fails; which one is found batch by batch
            continue
        upto = end
        if why is None:
            named = reviews.select(F.col("matched_object_id").alias("id")).filter("id is not null")
            known = together(only(current, "id", named), small).groupBy("id").agg(F.max_by("status", "version").alias("status"))
            if start < end:
                made = resolved.filter("decision = 'new'").select(F.col("object_id").alias("id"), F.lit("active").alias("status"))
                known = known.unionByName(made)
            cards = known.filter(F.col("status") == "active").select(F.col("id").alias("object_id"))
            numbers = batch.select("cluster_id", "batch_id")
            given = reviews.join(numbers, "cluster_id", "left").withColumn("batch_id", F.coalesce("batch_id", F.lit(start)))
            verdicts = {r.batch_id: r for r in review_coverage(
                given, numbers, cards, numbers.select("batch_id").distinct(), nothing).collect()}  # a row per batch
            for b in range(start, end + 1):
                if b not in verdicts or not verdicts[b]["accepted"]:
                    why, upto = ",".join(verdicts[b]["violations"]) if b in verdicts else "no_response", b - 1
                    break
        else:
            upto = start - 1
        if why is not None:
            failed = (upto + 1, why)
        if upto < start:
            break
        resolved = resolved.filter(F.col("batch_id") <= upto)
        decided = kept(CM.cluster_member_decisions(mine, resolved))
        # A cluster that breaks a rule is not applied; the others of its batch are. One row per broken cluster.
        ids = decided.select(F.col("proposal_id").alias("id"))
        there = only(loop.all("decisions").select(F.col("proposal_id").alias("id")), "id", ids)
        if stored is not None:
            there = there.unionByName(only(stored.select("id"), "id", ids))
        state_of = only(open_sources, "id", mine.select(F.col("source_id").alias("id")))
        broken = {r.cluster_id: (r.violations, r.batch_id) for r in CM.commit_violations(
            mine, decided, CM.observations_of(decided), resolved, known, together(state_of, small), together(there, small)).join(
            batch.select("cluster_id", "batch_id"), "cluster_id").collect()}
        if broken and (least := min(b for _, b in broken.values())) < upto:
            upto, failed = least, None  # later batches were reviewed with views that are not there
            broken = {c: v for c, v in broken.items() if v[1] == least}
            bound = MX.SENT_VIEWS  # little is reviewed in vain if more clusters break
        else:
            bound = min(2 * bound, MX.WINDOW_ROWS)
        fine = F.col("batch_id") <= upto
        fine = fine & ~F.col("cluster_id").isin(list(broken)) if broken else fine
        resolved = resolved.filter(fine)
        decided = decided.join(resolved.select("cluster_id"), "cluster_id", "left_semi")
        seen = CM.observations_of(decided)
        outcome = resolved.select("cluster_id", "batch_id", F.col("decision").alias("final_decision"), "object_id", F.lit(None).cast("string").alias("error"))
        if broken:
            outcome = outcome.unionByName(spark.createDataFrame(
                [(c, b, "failed", None, ",".join(v)) for c, (v, b) in broken.items()], _OUTCOMES))
        loop.put(upto, {
            "decisions": decided, "observations": seen, "filtered": CM.filter_cluster(mine, resolved), "outcomes": outcome,
            "changes": CM.object_changes(resolved, "batch_id").select(
                "id", (F.lit(base) + F.col("batch_id")).cast("long").alias("version"), "summary", F.lit("active").alias("status")),
            "views": seen.select(F.col("id").alias("observation_id"), "object_id", "proposal_id").join(
                mine.select(F.col("id").alias("proposal_id"), "vector", "local"), "proposal_id")})
        if commits:
            commits.write(upto, {n: loop.of(n, upto) for n in loop.NAMES})
        if upto < last and failed is None:
            views = loop.of("views", upto)
            maxima.add(views, upto, views.count())
        start = upto + 1

    cluster_out = loop.all("outcomes")
    if failed:
        rest = clusters.filter(F.col("batch_id") >= failed[0]).select(
            "cluster_id", F.col("batch_id").cast("long").alias("batch_id"), F.lit("failed").alias("final_decision"),
            F.lit(None).cast("string").alias("object_id"), F.lit(failed[1]).alias("error"))
        cluster_out = cluster_out.unionByName(rest)
    d = loop.all("decisions")
    state_of = members.select("cluster_id", F.col("id").alias("proposal_id"), "source_id").join(cluster_out, "cluster_id")
    state_of = state_of.join(d.select("proposal_id", F.col("decision").alias("_d")), "proposal_id", "left")
    final = F.col("final_decision")
    status = F.when(final == "failed", "failed").when(final == "ignored", "filtered").otherwise("decided")
    out = state_of.select(
        "proposal_id", "source_id", "cluster_id", "batch_id", status.alias("status"),
        F.coalesce("_d", final).alias("decision"), "object_id", "error")
    return Resolution(cluster_out, members, d, loop.all("observations"), loop.all("filtered"),
                      seed.unionByName(loop.all("changes")), out)


def close_run(sources: DataFrame, outcomes: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Final source statuses, then final run statuses."""
    src = CM.finalize_sources(sources, outcomes)
    closed = src.select("id", "run_id", F.col("final_status").alias("status"))
    none = runs.select(F.col("id").alias("run_id"), F.lit(0).alias("errors"))
    return src, CM.complete_runs(runs, closed, outcomes, none)


def rule_reviewer(clusters: DataFrame, objects: DataFrame) -> DataFrame:
    return rule_review(clusters)


# It looks at the evidence only, so it may be asked again.
rule_reviewer.repeatable = True


def resolve_entities(
    fingerprints: DataFrame, history: DataFrame, objects: DataFrame, p: Params, run_id: str,
    reviewer: Reviewer = rule_reviewer,
) -> Resolution:
    """Fingerprinted candidates to decisions: cluster, then review in order."""
    fingerprints = materialize(fingerprints)
    members, clusters = build_clusters(fingerprints, p)
    return review_loop(members, clusters, fingerprints, history, objects, reviewer, p, run_id)


def resolve_candidates(
    candidates: DataFrame, load_embedder: Callable, history: DataFrame, objects: DataFrame,
    p: Params, run_id: str, reviewer: Reviewer = rule_reviewer,
) -> tuple[DataFrame, Resolution]:
    """Raw candidates to decisions: filter and suppress, embed the kept ones, resolve.

    ``load_embedder()`` runs once per task and returns a batch function that adds
    ``vector`` and ``local`` to id, source_id, score, bbox columns.
    """
    processed = materialize(process_candidates(candidates, p))
    kept = processed.filter(F.col("status") == "pending").select("id", "source_id", "score", "bbox.*")
    schema = "id string, source_id string, score double, vector array<float>, local array<array<float>>"
    return processed, resolve_entities(embed(kept, load_embedder, schema), history, objects, p, run_id, reviewer)
