"""The engine's tables, derived by Spark from the given parquet tables.

The base tables of the schema are written as Parquet once per session, as a deployment would hold
them; the queries read those files."""

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from checks import sqltext
from holdfast import constants as K
from holdfast.functions.lookups import lookup
from holdfast.functions.rounding import half_up
from holdfast.operators import evaluation, features, registry, scoring
from holdfast.plans.strata import stratified_split
from holdfast.sources.tables import work_dir


# tables written in this process: (application, input folder, table)
_WRITTEN: dict[tuple[str, str, str], str] = {}


def stored(build):
    """A table that is derived once per session, written to the shared folder and read from there."""
    name = build.__name__

    def read(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            path = f"{work_dir(self.spark)}/tables/{key[0]}/{uuid.uuid4().hex}/{name}"
            build(self).write.parquet(path)
            _WRITTEN[key] = path
        return self.spark.read.parquet(_WRITTEN[key])

    read.__name__, read.__doc__ = name, build.__doc__
    prop = cached_property(read)
    prop.__set_name__(None, name)
    return prop


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def now(self) -> Column:
        return F.lit(sqltext.NOW).cast("timestamp_ntz")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        text = text.replace("{STR}", "string").replace(
            "{AGE}", "datediff((select max(o_orderdate) from {orders}), o.last_dt)")
        return self.spark.sql(text, **frames)

    @stored
    def rc(self) -> DataFrame:
        return self._sql(sqltext.RAW_CUSTOMERS, customer=self.given("customer"), orders=self.given("orders"))

    @stored
    def pc(self) -> DataFrame:
        return features.build_processed(self.rc)

    @cached_property
    def base(self) -> DataFrame:
        """Scorecard scores without the retention columns."""
        scored = self._sql(sqltext.SCORECARD, t_rc=self.rc)
        age = F.make_dt_interval(F.expr("cast(substr(customer_id, 6) as bigint) % 21").cast("int"))
        at = F.lit("2024-01-30 23:00:00").cast("timestamp_ntz") - age
        return scored.withColumn("model_version", F.lit("scorecard_v1")).withColumn("predicted_at", at)

    @stored
    def cp(self) -> DataFrame:
        return scoring.backfill(self.base, self.now).drop("monthly_charges")

    @stored
    def h(self) -> DataFrame:
        return self._sql(sqltext.HISTORY, events=self.given("events"))

    @cached_property
    def messy(self) -> DataFrame:
        return self._sql(sqltext.MESSY, t_rc=self.rc)

    @cached_property
    def holes(self) -> DataFrame:
        return self._sql(sqltext.HOLES, t_rc=self.rc)

    @cached_property
    def features(self) -> DataFrame:
        """Customers with label and model inputs."""
        return features.with_churn_label(features.model_features(self.rc)).select(
            "customer_id", "churn_label", *[F.col(f"`{f}`") for f in K.MODEL_FEATURES])

    @stored
    def split(self) -> DataFrame:
        return stratified_split(self.pc.select("customer_id", "churn_label"), "churn_label", "customer_id")

    @property
    def split_features(self) -> DataFrame:
        # both sides grow with the customers; their size is estimated from compressed files and would pass for a broadcast
        return self.features.join(self.split.select("customer_id", "split").hint("shuffle_merge"), "customer_id")

    @cached_property
    def models(self) -> list[scoring.LinearScorer]:
        return [scoring.LinearScorer(*m[:4]) for m in sqltext.MODELS]

    @cached_property
    def card(self) -> scoring.LinearScorer:
        return self.models[4]

    @cached_property
    def scored(self) -> DataFrame:
        """Scores of all models for all customers, in long form."""
        return scoring.score_models(self.features, self.models, ["customer_id", "churn_label"])

    @cached_property
    def test(self) -> DataFrame:
        """The same for the test part."""
        return scoring.score_models(self.features.join(self.split.where("split = 'test'"), "customer_id", "left_semi"), self.models, ["customer_id", "churn_label"])

    @stored
    def reg(self) -> DataFrame:
        """Model registry: measured metrics of the scorecards, the best one active."""
        by = ["model_id", "model_name", "model_version"]
        trained = {i + 1: m[4] for i, m in enumerate(sqltext.MODELS)}
        rows = evaluation.evaluate(self.test, by).select(
            F.col("model_id").cast("long").alias("id"), "model_name", "model_version", "accuracy", F.col("auc").alias("auc_score"),
            F.col("f1").alias("f1_score"), lookup(F.col("model_id"), trained).cast("timestamp_ntz").alias("trained_at"),
        )
        return registry.activate_best(rows)

    @stored
    def runs(self) -> DataFrame:
        """Run log: one run per day of events, failed on days with more errors than on average."""
        daily = self.given("events").groupBy(F.to_date("ts").alias("d")).agg(
            F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
        mean = daily.agg(F.avg("errors")).scalar()
        return daily.select(
            F.row_number().over(W.orderBy("d")).cast("long").alias("id"), F.lit("daily_pipeline").alias("pipeline_name"),
            F.when(F.col("errors") > mean, "failed").otherwise("success").alias("status"), F.col("n").alias("rows_processed"),
            (F.col("n") / 1000.0).alias("duration_seconds"), F.concat(F.col("errors").cast("string"), F.lit(" error events")).alias("details"),
            F.col("d").cast("timestamp_ntz").alias("run_at"))

    @stored
    def alerts(self) -> DataFrame:
        bad = self.given("events").where("event_type = 'error' and value > 100")
        return bad.select(
            F.col("event_id").alias("id"), F.lit("event_value").alias("alert_type"), F.when(F.col("value") > 200, "critical").otherwise("warning").alias("severity"),
            F.format_string("event %d of user %d", "event_id", "user_id").alias("message"), F.col("ts").alias("created_at"))

    @stored
    def snaps(self) -> DataFrame:
        """Score snapshots: the mean archived score of each day."""
        return self.h.groupBy(F.to_date("archived_at").cast("timestamp_ntz").alias("snapshot_at")).agg(
            half_up(F.avg("churn_probability"), 6).alias("mean_score"))

    @cached_property
    def folder(self) -> str:
        """A fresh folder in the shared work directory."""
        return f"{work_dir(self.spark)}/checks/{uuid.uuid4().hex}"

    @property
    def known_cp(self) -> DataFrame:
        """The already scored part: predictions of the customers that occur in the history."""
        return self.cp.join(self.h.select("customer_id"), "customer_id", "left_semi")

    @property
    def known_rc(self) -> DataFrame:
        """The already loaded part of the customers."""
        return self.rc.join(self.h.select("customer_id"), "customer_id", "left_semi")
