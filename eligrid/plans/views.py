"""Spark views of the domain tables over one driver data folder."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eligrid.operators import decision, mining, predicate_index, profiles, rulebase, scheme_totals
from eligrid.plans import derive
from eligrid.session import checkpoint, within_limit, written_table


# Profiles of one task at most, on average: the number of tasks follows the number of profiles.
TASK_PROFILES = 5000


class Views:
    """Lazy domain tables; one instance per session and data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}
        self._plans: dict[str, DataFrame] = {}
        self._built: dict[str, predicate_index.Index | None] = {}
        self._grown: Views | None = None
        self._tasks: int | None = None

    def _keep(self, name: str, build) -> DataFrame:
        """Rule-base tables are small and read by every query: written out once."""
        if name not in self._kept:
            self._kept[name] = checkpoint(build())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self) -> DataFrame:
        """The table that the rule base derives from."""
        return self.table("part")

    def profiles_raw(self) -> DataFrame:
        exprs = [f"{e} AS {c}" for c, e in derive.PROFILE_EXPRESSIONS.items()]
        extra = [f"{e} AS `{c}`" for c, e in derive.EXTRA_EXPRESSIONS.items()]
        customers = self.table("customer").selectExpr("c_custkey AS profile_id", *exprs, *extra)
        enrolled = (
            self.table("orders")
            .where(derive.ENROLLMENT_FILTER)
            .selectExpr("o_custkey AS profile_id", f"{derive.ENROLLMENT_SCHEME} AS scheme")
            .groupBy("profile_id")
            .agg(F.array_sort(F.collect_set("scheme")).alias("schemes_active_enrollments"))
        )
        return customers.join(enrolled, "profile_id", "left").withColumn(
            "schemes_active_enrollments",
            F.coalesce("schemes_active_enrollments", F.array().cast("array<string>")),
        )

    def profiles(self) -> DataFrame:
        """Normalised profiles with derived annual income."""
        return profiles.derive_annual_income(profiles.normalise(self.profiles_raw()))

    def profile_cells(self) -> DataFrame:
        """Profiles as cells, spread by profile id.

        One shuffle of the narrow rows: it evens out the evaluation, and every later
        grouping by profile (and scheme) finds its rows already together. A profile costs far more
        than its bytes show, so the number of tasks is given and not left to sizes.
        """
        if "cells" not in self._plans:
            dealt = self.profiles_raw().repartition(self.profile_tasks(), "profile_id")
            ready = profiles.derive_annual_income(profiles.normalise(dealt))
            self._plans["cells"] = profiles.with_cells(ready, {k: f"`{k}`" for k in derive.EXTRA_EXPRESSIONS})
        return self._plans["cells"]

    def profile_tasks(self) -> int:
        """Tasks for work on profiles: the more profiles, the more tasks, and none gets longer."""
        if self._tasks is None:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            # One more than other shuffles have: an equal number counts as done by the join before it, whose tasks are merged by size.
            self._tasks = max(parts, -(-self.table("customer").count() // TASK_PROFILES)) + 1
        return self._tasks

    def schemes(self) -> DataFrame:
        return self._keep(
            "schemes", lambda: self.spark.sql(derive.SCHEMES_SQL, part=self.parts())
        )

    def rules_raw(self) -> DataFrame:
        return self._keep(
            "rules", lambda: self.spark.sql(derive.RULES_RAW_SQL, part=self.parts())
        )

    def rules(self) -> DataFrame:
        return rulebase.load_ready(self.rules_raw())

    def queue(self) -> DataFrame:
        return self.rules_raw().where("in_review_queue").select("rule_id")

    def flags(self) -> DataFrame:
        """Ambiguity flags: up to two per rule."""
        both = F.filter(
            F.array(
                F.struct(F.lit(0).alias("pos"), F.col("flag_code").alias("type_code"), F.col("flag_severity").alias("severity")),
                F.struct(F.lit(1).alias("pos"), F.col("flag2_code").alias("type_code"), F.col("flag2_severity").alias("severity")),
            ),
            lambda x: x["severity"].isNotNull(),
        )
        return self.rules_raw().select("scheme_id", "rule_id", "field", "ord", F.inline(both)).withColumn(
            "ambiguity_id", F.concat(F.lit("AMB-"), F.lpad(F.col("type_code").cast("string"), 3, "0"))
        )

    def bound_rules(self) -> DataFrame:
        def build() -> DataFrame:
            active = rulebase.active_rules(self.rules(), self.schemes(), self.queue())
            return rulebase.bind(active, self.flags())

        return self._keep("bound", build)

    def nested_rules(self) -> DataFrame:
        def build() -> DataFrame:
            excluded = rulebase.exclusions(self.rules(), self.queue())
            return rulebase.nest(self.schemes(), self.bound_rules(), excluded)

        return self._keep("nested", build)

    def relationships(self) -> DataFrame:
        return self._keep(
            "relationships",
            lambda: self.spark.sql(derive.RELATIONSHIPS_SQL, part=self.parts()),
        )

    def feed(self) -> DataFrame:
        return self.spark.sql(derive.FEED_SQL, orders=self.table("orders")).withColumn(
            "summary", F.coalesce("summary_raw", "title")
        ).drop("summary_raw")

    def typed_rules(self) -> DataFrame:
        """Loaded rules with the condition type their field implies."""
        return rulebase.with_condition_type(self.rules())

    def clauses(self) -> DataFrame:
        """Prose per part; the narrow rows are spread first, as a file of few row groups is read by few tasks."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        narrow = self.parts().select("p_partkey", "p_name", "p_size", "p_retailprice").repartition(parts, "p_partkey")
        return self.spark.sql(derive.CLAUSES_SQL, part=narrow)

    def mined(self) -> DataFrame:
        if "mined" not in self._plans:
            self._plans["mined"] = mining.extract_rules(self.clauses())
        return self._plans["mined"]

    def index(self) -> predicate_index.Index | None:
        """The index of the rule base's predicates; built once, None where it would be too large."""
        if "index" not in self._built:
            self._built["index"] = predicate_index.build(self.nested_rules())
        return self._built["index"]

    def determinations(self) -> DataFrame:
        """Lazy; the plan is built once per folder, the data never kept."""
        if "determinations" not in self._plans:
            nested, index = self.nested_rules(), self.index()
            if index is None or not within_limit(nested):
                self._plans["determinations"] = decision.determinations(self.profile_cells(), nested)
            else:
                placed = decision.placed(self.profile_cells(), index.states)
                self._plans["determinations"] = predicate_index.whole_determinations(placed, nested, index)
        return self._plans["determinations"]

    def coded(self, *carried: str) -> DataFrame | None:
        """Statuses, counters and a code per rule of all pairs; None where determinations come from the nested rules."""
        nested, index = self.nested_rules(), self.index()
        if index is None or not within_limit(nested):
            return None
        return predicate_index.details(decision.placed(self.profile_cells(), index.states), index, *carried)

    def decided(self) -> DataFrame:
        """Statuses, counters and scores of all pairs, over the predicate index; lazy, like `determinations`."""
        if "decided" not in self._plans:
            self._plans["decided"] = predicate_index.determinations(self.profile_cells(), self.nested_rules(), index=self.index())
        return self._plans["decided"]

    def grown(self) -> "Views":
        """The same profiles over a rule base that grows with `part`: a scheme per six parts, a rule per part and type."""
        if self._grown is None:
            self._grown = GrownViews(self.spark, self.folder)
        return self._grown


class GrownViews(Views):
    def parts(self) -> DataFrame:
        return self.table("part").selectExpr(*derive.GROWN_PART)

    def totals(self) -> DataFrame | None:
        """Totals per scheme and status over all profiles; None where the predicates are too many for it."""
        return scheme_totals.totals(self.profile_cells(), self.schemes(), _CountedRules(self.spark, self.folder).bound_rules())


class _CountedRules(GrownViews):
    """The grown rule base without the texts that no decision reads."""

    RAW = (
        "scheme_id", "rule_id", "ord", "rule_type", "field", "operator", "value_kind", "value_text", "value_min", "value_max", "values_kind", "values_text",
        "audit_status", "state_scope", "supersedes_rule_id", "flag_severity", "flag_code", "flag2_severity", "flag2_code", "in_review_queue",
    )

    def _keep(self, name: str, build) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = build() if name == "bound" else written_table(build(), name)
        return self._kept[name]

    def rules_raw(self) -> DataFrame:
        return self._keep("rules", lambda: self.spark.sql(derive.RULES_RAW_SQL, part=self.parts()).select(*self.RAW))


@lru_cache(maxsize=8)
def _views(app: str, folder: str) -> Views:
    return Views(SparkSession.active(), folder)


def views(spark: SparkSession, folder: str) -> Views:
    return _views(spark.sparkContext.applicationId, folder)
