"""Ledger-shaped views over the driver tables. No caching, no sampling, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightledger.functions.masks import rect_runs
from sightledger.functions.vectors import slices
from sightledger.session import spread

CANVAS = 100


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as a stream, whether it is one file or a folder of part files.

        A stream's plain path has to be a folder; a pattern that matches nothing but the table may be either.
        """
        return self.spark.readStream.schema(self.table(name).schema).parquet(f"{self.dir}/{name}.parque[t]")

    def assets(self) -> DataFrame:
        """Documents as files: the text is the content."""
        return self.table("documents").select(
            F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
            F.col("text").cast("binary").alias("content"),
            F.col("n_chars").alias("size_bytes"), "doc_id",
        )

    def boxes(self) -> DataFrame:
        """Line items as scored rectangles on a square canvas, 16 orders per image."""
        i = lambda c: F.col(c).cast("int")
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_shipdate")
        return spread(lines).select(
            F.concat(F.lit("img_"), F.floor(F.col("l_orderkey") / 16).cast("string")).alias("source_id"),
            F.concat_ws("-", *[F.col(c).cast("string") for c in (
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                i("l_quantity").cast("string"), F.date_format("l_shipdate", "yyyyMMdd")).alias("raw_candidate_id"),
            (F.lit(0.8) + F.col("l_discount") * 2).alias("score"),
            (F.col("l_partkey") % 90).cast("int").alias("x0"),
            (F.col("l_suppkey") % 80).cast("int").alias("y0"),
            ((F.col("l_partkey") % 90).cast("int") + 1 + i("l_quantity") % 40).alias("x1"),
            ((F.col("l_suppkey") % 80).cast("int") + 1 + i("l_quantity") % 30).alias("y1"),
        )

    def candidates(self) -> DataFrame:
        b = self.boxes()
        d = lambda c: F.col(c).cast("double")
        return b.select(
            "source_id", "raw_candidate_id", "score",
            F.lit(CANVAS).alias("image_w"), F.lit(CANVAS).alias("image_h"),
            F.struct(d("x0").alias("x_min"), d("y0").alias("y_min"),
                     d("x1").alias("x_max"), d("y1").alias("y_max")).alias("bbox"),
            rect_runs(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), CANVAS, CANVAS).alias("runs"),
        )

    def fingerprints(self) -> DataFrame:
        """Embeddings as fingerprints: 100 sources, four local slices per vector."""
        return self.table("embeddings").select(
            F.concat(F.lit("prop_"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("id"),
            F.concat(F.lit("src_"), (F.col("vec_id") % 100).cast("string")).alias("source_id"),
            (F.lit(0.5) + (F.col("vec_id") % 50) / 100).alias("score"),
            F.col("embedding").alias("vector"), "vec_id", "label",
        )

    def history(self) -> DataFrame:
        return self.fingerprints().filter(F.col("vec_id") % 5 == 0).select(
            F.concat(F.lit("obj_"), F.col("label").cast("string")).alias("object_id"),
            F.concat(F.lit("obs_"), F.substring("id", 6, 9)).alias("observation_id"),
            "vector", slices("vector", 4, 16).alias("local"),
        )

    def queries(self) -> DataFrame:
        return self.fingerprints().filter(F.col("vec_id") % 5 != 0).select(
            F.col("id").alias("query_id"), "source_id", "vector", slices("vector", 4, 16).alias("local"))

    # --- six ledger tables ---

    def runs(self) -> DataFrame:
        k = F.col("c_custkey")
        status = F.element_at(F.array(*map(F.lit, ("completed", "running", "completed_with_errors", "failed", "completed"))),
                              (k % 5 + 1).cast("int"))
        started = F.timestamp_micros((F.lit(1704067200) + (k % 997) * 60) * 1000000)
        return self.table("customer").select(
            F.concat(F.lit("run_"), k.cast("string")).alias("id"), status.alias("status"),
            started.alias("started_at"),
            F.when(status != "running", F.timestamp_micros(
                F.unix_micros(started) + (k % 13) * 1250000)).alias("completed_at"),
        )

    def source_images(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
        )
        return self.table("orders").select(
            F.concat(F.lit("src_"), F.col("o_orderkey").cast("string")).alias("id"),
            F.concat(F.lit("run_"), F.col("o_custkey").cast("string")).alias("run_id"),
            F.concat(F.lit("sources/"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("relative_path"),
            status.alias("status"), F.col("o_orderdate").alias("created_at"),
        )

    def _line_id(self, prefix: str):
        return F.concat_ws("_", F.lit(prefix), *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])

    def proposals(self) -> DataFrame:
        r, s = F.col("l_returnflag"), F.col("l_linestatus")
        status = (
            F.when(r == "A", "decided").when(r == "R", "filtered").when(s == "O", "pending").otherwise("failed")
        )
        n = F.col("l_linenumber") % 4
        reason = (
            F.when(n == 0, "low_confidence").when(n == 1, F.concat(F.lit("duplicate_mask:"), self._line_id("prop")))
            .when(n == 2, "qwen_cluster_ignore:background: wall").otherwise("candidate_limit")
        )
        return self.table("lineitem").select(
            self._line_id("prop").alias("id"),
            F.concat(F.lit("src_"), F.col("l_orderkey").cast("string")).alias("source_id"),
            (F.lit(0.8) + F.col("l_discount") * 2).alias("score"), status.alias("status"),
            F.when(r == "R", reason).alias("filter_reason"),
            F.concat(F.lit("clu_"), F.col("l_partkey").cast("string")).alias("target_id"),
            F.col("l_shipdate").alias("created_at"),
            F.when(F.col("l_linenumber") != 7, F.lit("automatic_point_grid")).otherwise("manual").alias("prompt"),
        )

    def objects(self) -> DataFrame:
        summary = F.struct(
            F.col("p_name").alias("object_name_zh"), F.col("p_type").alias("coarse_category"),
            F.col("p_brand").alias("fine_category"),
            F.concat_ws(" ", "p_brand", "p_name").alias("stable_description"),
            F.split("p_name", " ").alias("stable_identity_features"),
            F.array("p_brand").alias("brand_or_markings"),
            F.array(F.struct(F.lit("body").alias("part"), F.array(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("color"),
                             F.array("p_type").alias("material"))).alias("part_appearance"),
            (F.col("p_size") / 50).alias("summary_confidence"),
        )
        return self.table("part").select(
            F.concat(F.lit("obj_"), F.col("p_partkey").cast("string")).alias("id"), summary.alias("summary"),
            F.when(F.col("p_size") % 5 == 0, "archived").otherwise("active").alias("status"),
            F.timestamp_micros((F.lit(1704067200) + F.col("p_size").cast("long") * 86400) * 1000000).alias("created_at"),
        )

    def _accepted(self):
        return F.element_at(F.array(F.lit("new"), F.lit("existing"), F.lit("uncertain")),
                            (F.col("l_suppkey") % 3 + 1).cast("int"))

    def decisions(self) -> DataFrame:
        decision = self._accepted()
        return self.table("lineitem").filter(F.col("l_returnflag") == "A").select(
            self._line_id("dec").alias("id"), self._line_id("prop").alias("proposal_id"),
            decision.alias("decision"),
            F.when(decision == "existing", F.concat(F.lit("obj_"), F.col("l_partkey").cast("string")))
            .alias("matched_object_id"),
            F.when(decision == "uncertain", 0.0).otherwise(F.col("l_quantity") / 50).alias("confidence"),
            F.when(decision == "new", "new_object").when(decision == "existing", "visual_instance_match")
            .otherwise("insufficient_evidence").alias("reason_code"),
            decision.alias("hypothesis"), F.col("l_linenumber").alias("attempt"),
        )

    def observations(self) -> DataFrame:
        return self.table("lineitem").filter(
            (F.col("l_returnflag") == "A") & (self._accepted() != "uncertain")
        ).select(
            self._line_id("obs").alias("id"),
            F.concat(F.lit("obj_"), F.col("l_partkey").cast("string")).alias("object_id"),
            self._line_id("prop").alias("proposal_id"),
            F.concat(F.lit("src_"), F.col("l_orderkey").cast("string")).alias("source_id"),
            F.col("l_shipdate").alias("created_at"),
        )

    # --- events ---

    def events(self) -> DataFrame:
        """Events per user as progress events; stage and status follow the event type."""
        k = F.get_json_object("props", "$.k").cast("int")
        t = F.col("event_type")
        stage = (
            F.when(t == "view", "input_registration").when(t == "click", "sam3")
            .when(t == "signup", "dinov3").when(t == "purchase", "cluster_review").otherwise("")
        )
        return self.table("events").select(
            F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), "event_id",
            F.col("ts").alias("timestamp_utc"),
            F.when(t == "error", "cli_completed").otherwise("progress").alias("event"),
            stage.alias("stage"),
            F.when(t == "error", F.when(k % 2 == 0, "passed").otherwise("failed")).otherwise("running").alias("status"),
            k.alias("current"), F.when(t == "signup", 0).otherwise(100).alias("total"),
            F.lit(None).cast("double").alias("overall_percent"),
            F.when(t == "view", "").otherwise(t).alias("message"),
            F.round("value", 3).alias("elapsed_seconds"),
        )

    def clusters(self) -> DataFrame:
        """Cluster rows of reports: one per supplier and run region."""
        k = F.col("c_custkey")
        final = F.element_at(F.array(*map(F.lit, ("new", "existing", "ignored", "uncertain", "failed", ""))),
                             (k % 6 + 1).cast("int"))
        return self.table("customer").select(
            F.concat(F.lit("run_"), F.col("c_nationkey").cast("string")).alias("run_id"),
            F.concat(F.lit("clu_"), k.cast("string")).alias("cluster_id"),
            (k % 7 + 1).cast("int").alias("member_count"), (k % 3 + 1).cast("int").alias("source_count"),
            (k % 4 != 0).alias("reviewed"), F.nullif(final, F.lit("")).alias("final_decision"),
            F.when(final == "failed", F.concat(F.lit("batch failed "), (k % 10).cast("string"))).alias("error"),
        )

    def report_images(self) -> DataFrame:
        """Image rows of reports: one per order, run = customer nation."""
        k = F.col("o_orderkey")
        c = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"),
            F.concat(F.lit("run_"), F.col("c_nationkey").cast("string")).alias("run_id"))
        return self.table("orders").join(c, "o_custkey").select(
            "run_id", F.concat(F.lit("src_"), k.cast("string")).alias("source_id"),
            k.alias("item"), (k % 11 == 0).alias("duplicate"),
            F.when(k % 3 == 0, 0).when(k % 3 == 1, (k % 256).cast("int")).alias("raw_candidates"),
            F.when(k % 2 == 0, (k % 100).cast("int")).alias("grid_points"),
            (k % 50).cast("int").alias("above_confidence_threshold_candidates"),
            F.when(k % 5 != 0, (k % 24).cast("int")).alias("kept"),
            (k % 17).cast("int").alias("filtered"),
            F.when(k % 13 == 0, F.concat(F.lit("image broken "), (k % 4).cast("string"))).alias("error"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing")
            .otherwise("failed").alias("status"),
        )

    def reports(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            F.concat(F.lit("run_"), n.cast("string")).alias("run_id"),
            F.when(n % 3 == 0, "passed").when(n % 3 == 1, "failed").otherwise("completed_with_errors").alias("status"),
            F.when(n % 2 == 0, n.cast("long")).alias("duplicate_sources_skipped"),
            (n * 3).cast("long").alias("observations_added"), (n + 1).cast("long").alias("active_objects_total"),
            F.when(n % 4 == 0, "report broken").alias("error"),
        )
