"""Reviewer prompts, response acceptance and the user-function plug-ins."""

from __future__ import annotations

from functools import lru_cache
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from sightledger.functions.jsontext import extract_json_object
from sightledger.functions.validators import (
    codes, validate_review, validate_summary,
)
from sightledger.schema import REVIEW


def card_payload(objects: DataFrame) -> DataFrame:
    """One JSON card per active object: {"object_id", "summary"}."""
    return objects.filter(F.col("status") == "active").select(
        "id", "created_at",
        F.to_json(F.struct(F.col("id").alias("object_id"), "summary")).alias("card"),
    )


def cluster_payload(clusters: DataFrame, evidence: DataFrame) -> DataFrame:
    """Text block per cluster: its report plus the historical evidence, as JSON."""
    report = F.struct(
        "cluster_id",
        F.struct(*[c for c in evidence.columns if c != "cluster_id"]).alias("historical_visual_evidence"),
        "member_count", "source_count",
    )
    return clusters.join(evidence, "cluster_id").select(
        *clusters.columns,
        F.concat(F.lit("CLUSTER "), "cluster_id", F.lit(":\n"), F.to_json(report)).alias("block"),
    )


def review_prompt(payload: DataFrame) -> DataFrame:
    """Ordered prompt text per batch; a batch holds ``max_clusters_per_batch`` blocks."""
    return payload.groupBy("batch_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "block"))), lambda s: s["block"]
        ), "\n").alias("prompt"),
        F.array_sort(F.collect_list("cluster_id")).alias("cluster_ids"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Reviews per response text: batch_id, position, parsed review, parse error."""
    parsed = responses.withColumn("_x", extract_json_object("raw_text"))
    body = T.StructType([T.StructField("reviews", T.ArrayType(REVIEW))])
    known = F.from_json("_x.payload", body)
    keys = F.json_object_keys("_x.payload")
    bad_shape = F.col("_x.error").isNull() & (
        known["reviews"].isNull() | (F.size(F.array_except(keys, F.array(F.lit("reviews")))) > 0)
    )
    return parsed.select(
        "batch_id",
        F.coalesce("_x.error", F.when(bad_shape, "schema_mismatch")).alias("parse_error"),
        F.when(~bad_shape, known["reviews"]).alias("reviews"),
    )


@lru_cache(maxsize=1)
def _review_faults(application: str):
    """Broken rules of a review. The expression is large and made once per application: a loop asks for it per batch."""
    return F.concat(
        validate_review(F.col("verdict"), F.col("identity_hypothesis"),
                        F.col("matched_object_id"), F.col("object_summary").isNotNull()),
        F.when(F.col("object_summary").isNotNull(), validate_summary(F.col("object_summary")))
        .otherwise(F.array().cast("array<string>")),
    )


def review_coverage(
    reviews: DataFrame, expected: DataFrame, objects: DataFrame, batches: DataFrame, memory_empty: bool | None = None
) -> DataFrame:
    """Verdict per batch: all expected clusters exactly once, only supplied object ids.

    reviews: batch_id, cluster_id, verdict, identity_hypothesis, matched_object_id,
    object_summary; expected: batch_id, cluster_id; objects: object_id (supplied cards).
    One bad review rejects its whole batch. ``memory_empty`` says whether there is no object at all, for callers that
    supply only the cards which the reviews name.
    """
    seen = reviews.groupBy("batch_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = expected.select("batch_id", "cluster_id", F.lit(True).alias("wanted")).join(
        seen, ["batch_id", "cluster_id"], "full_outer"
    )
    cover = pairs.groupBy("batch_id").agg(
        F.bool_or(F.col("n").isNull()).alias("missing_cluster"),
        F.bool_or(F.col("wanted").isNull()).alias("unexpected_cluster"),
        F.bool_or(F.coalesce("n", F.lit(0)) > 1).alias("repeated_cluster"),
    )
    cards = objects.select(F.col("object_id").alias("matched_object_id"), F.lit(True).alias("_known")).distinct()
    empty = objects.limit(1).agg((F.count(F.lit(1)) == 0).alias("_empty"))
    if memory_empty is not None:
        empty = reviews.sparkSession.range(1).select(F.lit(memory_empty).alias("_empty"))
    faults = _review_faults(reviews.sparkSession.sparkContext.applicationId)
    # Most reviews name no object: they skip the join instead of meeting in one partition.
    named = reviews.filter(F.col("matched_object_id").isNotNull()).join(cards, "matched_object_id", "left")
    nameless = reviews.filter(F.col("matched_object_id").isNull()).withColumn("_known", F.lit(None).cast("boolean"))
    checked = (
        named.unionByName(nameless).crossJoin(F.broadcast(empty))  # one row
        .withColumn("_faulty", F.size(faults) > 0)
        .withColumn("_unknown", F.col("matched_object_id").isNotNull() & F.col("_known").isNull())
        .withColumn("_not_new", F.col("_empty") & (F.col("verdict") == "object")
                    & (F.col("identity_hypothesis") != "new"))
        .groupBy("batch_id").agg(
            F.bool_or("_faulty").alias("invalid_review"),
            F.bool_or("_unknown").alias("unknown_object"),
            F.bool_or("_not_new").alias("must_be_new"),
        )
    )
    flags = ["missing_cluster", "unexpected_cluster", "repeated_cluster",
             "invalid_review", "unknown_object", "must_be_new"]
    out = batches.select("batch_id").join(cover, "batch_id", "left").join(checked, "batch_id", "left")
    out = out.select("batch_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])
    bad = codes(**{c: F.col(c) for c in flags})
    return out.select("batch_id", bad.alias("violations"), (F.size(bad) == 0).alias("accepted"))


# --- user functions ---------------------------------------------------------

def score_batches(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """Candidate generation by a user function over Arrow batches."""
    return df.mapInPandas(fn, schema)


def embed(df: DataFrame, load: Callable, schema) -> DataFrame:
    """Vector extraction: ``load()`` runs once per task and returns a batch function."""
    def run(batches):
        model = load()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def guarded(df: DataFrame, load: Callable, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """Rows of a user function, or rows that say why there are none: the task lives on.

    ``load()`` runs once per task and returns a batch function. What it raises comes back as one row per input row
    with its ``keys``, ``error`` and ``error_kind``: ``load`` if the function could not be made, ``row`` if it failed
    on that row. A batch that fails is tried again in halves, down to the rows that fail, so its other rows are not lost
    and a few bad rows cost a few calls more, not one per row.
    """
    names = [f.name for f in T.StructType.fromDDL(schema)]

    def why(error: Exception) -> str:
        return f"{type(error).__name__}: {error}"

    def bad(rows: pd.DataFrame, text: str | list[str], kind: str) -> pd.DataFrame:
        out = pd.DataFrame({n: rows[n].to_numpy() if n in keys else [None] * len(rows) for n in names}, dtype="object")
        return out.assign(error=text, error_kind=kind)

    def run(batches):
        try:
            model, broken = load(), None
        except Exception as error:
            model, broken = None, why(error)
        for pdf in batches:
            if broken is not None:
                yield bad(pdf, broken, "load")
                continue
            # Parts go out as one frame, those of other types on their own.
            parts, lost, texts = {}, [], []

            def went(low: int, high: int, fails: bool = False) -> bool:
                """Whether these rows went through together; if not, their halves have been tried."""
                text = None
                if not fails or high - low == 1:
                    try:
                        out = model(pdf.iloc[low:high].copy())
                        out = out if list(out.columns) == names else out[names]
                        parts.setdefault(tuple(out.dtypes), []).append(out)
                        return True
                    except Exception as error:
                        text = why(error)
                if high - low == 1:
                    lost.append(low)
                    texts.append(text)
                else:
                    middle = (low + high) // 2
                    # If the first half is fine, the other one holds what failed.
                    went(middle, high, went(low, middle))
                return False

            if len(pdf):
                went(0, len(pdf))
            for same in parts.values():
                yield pd.concat(same, ignore_index=True).assign(error=None, error_kind=None)
            if lost:
                yield bad(pdf.iloc[lost], texts, "row")

    return df.mapInPandas(run, f"{schema}, error string, error_kind string")


def review(payload: DataFrame, fn: Callable[[str, list], str]) -> DataFrame:
    """One user-function call per batch of clusters: (batch_id, raw_text)."""
    def call(batches):
        for pdf in batches:
            yield pd.DataFrame({
                "batch_id": pdf["batch_id"],
                "raw_text": [fn(t, list(ids)) for t, ids in zip(pdf["prompt"], pdf["cluster_ids"])],
            })

    return review_prompt(payload).mapInPandas(call, "batch_id long, raw_text string")


def rule_review(clusters: DataFrame) -> DataFrame:
    """Reviewer made of expressions, for tests and dry runs.

    Follows the evidence: a match is `existing`, no match is `new`, ambiguous evidence is
    `uncertain`. Input: cluster_id, result, matched_object_id, member_count.
    """
    verdict = F.when(F.col("result") == "ambiguous", "uncertain").otherwise("object")
    hypothesis = (
        F.when(F.col("result") == "match", "existing")
        .when(F.col("result") == "no_match", "new").otherwise("uncertain")
    )
    empty = F.array().cast("array<string>")
    summary = F.when(verdict == "object", F.struct(
        F.concat(F.lit("object "), "cluster_id").alias("object_name_zh"),
        F.lit("object").alias("coarse_category"), F.lit("object").alias("fine_category"),
        F.format_string("seen in %d views", F.col("member_count")).alias("stable_description"),
        empty.alias("stable_identity_features"), empty.alias("brand_or_markings"),
        F.from_json(F.lit("[]"), "array<struct<part:string,color:array<string>,material:array<string>>>")
        .alias("part_appearance"),
        F.lit(0.8).alias("summary_confidence"),
    ))
    return clusters.select(
        "cluster_id", verdict.alias("verdict"), hypothesis.alias("identity_hypothesis"),
        F.when(F.col("result") == "match", F.col("matched_object_id")).alias("matched_object_id"),
        F.lit("rule").alias("short_reason"), summary.alias("object_summary"),
    )


