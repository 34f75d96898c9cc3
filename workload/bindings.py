"""Logical tables of the metrics model as views over the driver's parquet tables.

The mapping is fixed and covers whole tables; ``oracle.py`` states the same views as SQL.
"""

from __future__ import annotations

from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.calendar import (
    eligible_day_factors,
    reserved_capacity,
    team_calendars,
)
from plumbline.operators.cross_team import deduplicate_items
from plumbline.operators.history import history_coverage, usable_revisions
from plumbline.operators.load import accountable_items, load_findings
from plumbline.operators.skew import attach, spread
from plumbline.plans.run_outputs import RunOutputs, run_outputs
from plumbline.session import configure

# The flagship sprint, and the sprint the revision history is read against.
SPRINT = ("1998-01-05", "1998-01-17")
LOAD_AS_OF = "1998-01-06 02:00:00"
HISTORY = ("2024-01-08", "2024-01-20")
ORGANIZATION = "org"

_MONEY = "decimal(18,4)"
# Tables whose rows are worked on one by one before anything is aggregated.
_FACTS = ("lineitem", "documents")


class Tables:
    """Lazily built logical tables for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    @cache
    def read(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in _FACTS else table

    # -- team dimension -------------------------------------------------------

    @cached_property
    def settings(self) -> DataFrame:
        """One row per nation, varied by region."""
        region = F.col("n_regionkey")
        dates = "array<date>"
        return self.read("nation").select(
            F.col("n_nationkey").cast("string").alias("team_id"),
            F.when(region == 4, F.array(F.lit("current_status")))
            .otherwise(F.array(F.lit("current_status"), F.lit("allocation")))
            .alias("capabilities"),
            F.lit("hours").alias("unit"),
            F.lit("leaf_task").alias("accounting_level"),
            F.when(region == 0, "America/Sao_Paulo")
            .when(region == 1, "America/New_York")
            .when(region == 2, "Asia/Tokyo")
            .otherwise("UTC")
            .alias("timezone"),
            F.when(region == 0, F.array(*[F.lit(d) for d in range(6)]))
            .otherwise(F.array(*[F.lit(d) for d in range(5)]))
            .alias("working_days"),
            F.when(region == 1, F.array(F.lit("1998-01-08")))
            .otherwise(F.array())
            .cast(dates)
            .alias("holidays"),
            F.when(region == 3, F.array(F.lit("1998-01-12")))
            .otherwise(F.array())
            .cast(dates)
            .alias("team_days_off"),
            F.when(region == 2, "include_full").otherwise("exclude").alias("current_day_policy"),
            F.when(region == 3, F.lit("0.50")).otherwise("0.60").cast("decimal(9,4)").alias("below"),
            F.when(region == 3, F.lit("0.80")).otherwise("0.90").cast("decimal(9,4)").alias("within"),
            F.when(region == 3, F.lit("1.00"))
            .otherwise("1.10")
            .cast("decimal(9,4)")
            .alias("attention"),
            F.lit("Microsoft.VSTS.Scheduling.RemainingWork").alias("remaining_field"),
            F.when(region == 0, "Microsoft.VSTS.Scheduling.OriginalEstimate").alias(
                "original_estimate_field"
            ),
            F.lit(None).cast("string").alias("completed_work_field"),
            F.lit("Points").alias("story_points_field"),
            F.when(region != 1, "tag:blocked").alias("impediment_source"),
            F.array().cast("array<string>").alias("blocked_states"),
            F.when(region == 3, F.array(F.lit("capacity")))
            .otherwise(F.array())
            .cast("array<string>")
            .alias("partial_sources"),
            F.array(F.concat_ws("\\", F.lit("area"), "n_regionkey")).alias("area_paths"),
            (region != 2).alias("include_descendants"),
        )

    @cached_property
    def windows(self) -> DataFrame:
        """The flagship sprint at local midnights, per team."""
        zone = F.col("timezone")
        return self.settings.select(
            "team_id",
            F.to_utc_timestamp(F.lit(SPRINT[0]).cast("timestamp"), zone).alias("window_start"),
            F.to_utc_timestamp(F.lit(SPRINT[1]).cast("timestamp"), zone).alias("window_end"),
            "timezone",
            F.lit(LOAD_AS_OF).cast("timestamp").alias("as_of"),
        )

    @cached_property
    def calendars(self) -> DataFrame:
        return team_calendars(self.settings, self.windows)

    @cached_property
    def capacities(self) -> DataFrame:
        factors = eligible_day_factors(self.calendars, self.people, self.days_off)
        return reserved_capacity(self.calendars, self.reservations, factors)

    # -- work items -----------------------------------------------------------

    @cached_property
    def _supplier_team(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").alias("l_suppkey"),
            F.col("s_nationkey").cast("string").alias("team_id"),
        )

    @cached_property
    def raw_children(self) -> DataFrame:
        """Child items as they arrive, duplicates included."""
        line = attach(self.read("lineitem"), self._supplier_team, "l_suppkey", "inner")
        state = F.concat("l_linestatus", "l_returnflag")
        quantity = F.col("l_quantity").cast(_MONEY)
        return line.select(
            F.lit(ORGANIZATION).alias("organization"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
            "team_id",
            F.lit("Task").alias("item_type"),
            state.alias("state"),
            F.when(F.col("l_linestatus") == "F", "completed")
            .when(state == "ON", "in_progress")
            .when(state == "OR", "proposed")
            .alias("state_category"),
            F.col("l_suppkey").cast("string").alias("assigned_to"),
            F.when(F.col("l_discount") == 0, F.lit(None))
            .when(F.col("l_tax") == 0, -quantity)
            .otherwise(quantity)
            .cast(_MONEY)
            .alias("remaining"),
            F.lit("hours").alias("remaining_unit"),
            F.when(F.col("l_discount") != 0, F.col("l_returnflag") == "R").alias("blocked"),
            F.col("l_shipdate").cast("date").alias("target_date"),
            F.array("team_id").alias("team_memberships"),
            "l_partkey",
            "l_suppkey",
            "l_shipdate",
            "l_extendedprice",
        )

    ARRIVAL = ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")

    @cached_property
    def tagged_children(self) -> DataFrame:
        """Child items as they arrive, with tags of the source."""
        line = attach(self.read("lineitem"), self._supplier_team, "l_suppkey", "inner")
        return line.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"),
            "team_id",
            F.concat("l_linestatus", "l_returnflag").alias("state"),
            F.when(F.col("l_tax") > 0.03, "a; BLOCKED").when(F.col("l_tax") > 0.01, "a").alias("tags"),
        )

    @cached_property
    def children(self) -> DataFrame:
        return deduplicate_items(self.raw_children, self.ARRIVAL).drop(*self.ARRIVAL)

    @cached_property
    def parents(self) -> DataFrame:
        """One backlog item per order; no supplier, so nobody is assigned."""
        status = F.col("o_orderstatus")
        return self.read("orders").select(
            F.lit(ORGANIZATION).alias("organization"),
            (F.col("o_orderkey") * 10).alias("item_id"),
            F.pmod("o_custkey", F.lit(25)).cast("string").alias("team_id"),
            F.lit("Product Backlog Item").alias("item_type"),
            status.alias("state"),
            F.when(status == "F", "completed")
            .when(status == "O", "in_progress")
            .when(status == "P", "proposed")
            .alias("state_category"),
            F.lit(None).cast("string").alias("assigned_to"),
            F.when(status != "P", F.floor(F.col("o_totalprice") / 1000))
            .cast(_MONEY)
            .alias("remaining"),
            F.lit("hours").alias("remaining_unit"),
            F.lit(None).cast("boolean").alias("blocked"),
            F.date_add(F.col("o_orderdate").cast("date"), 30).alias("target_date"),
            F.array(F.pmod("o_custkey", F.lit(25)).cast("string")).alias("team_memberships"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.children.drop("overlapping").unionByName(self.parents)

    @cached_property
    def relations(self) -> DataFrame:
        return self.read("lineitem").select(
            F.lit(ORGANIZATION).alias("organization"),
            (F.col("l_orderkey") * 10).alias("parent_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child_id"),
            F.lit("hierarchy").alias("relation"),
        )

    @cached_property
    def accountable(self) -> DataFrame:
        return accountable_items(self.items, self.relations, self.settings)

    @cached_property
    def sprint_accountable(self) -> DataFrame:
        """Accountable items due in the flagship sprint; parents are excluded first."""
        return accountable_items(
            self.items.where(self.in_sprint), self.relations, self.settings
        )

    @property
    def in_sprint(self) -> Column:
        """Whether an item is due in the flagship sprint."""
        due = F.col("target_date")
        first, end = (F.lit(day).cast("date") for day in SPRINT)
        return F.coalesce((due >= first) & (due < end), F.lit(False))

    @cached_property
    def outputs(self) -> RunOutputs:
        """What every team's run produced; the first use computes and stores it."""
        return run_outputs(
            self.accountable, self.in_sprint, self.people, self.settings, self.reservations,
            self.capacities, self.evidence,
        )

    # -- people and capacity --------------------------------------------------

    @cached_property
    def people(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_nationkey").cast("string").alias("team_id"),
            F.col("s_suppkey").cast("string").alias("person_id"),
            F.col("s_name").alias("display_name"),
        )

    @cached_property
    def reservations(self) -> DataFrame:
        """One reservation per supplier, and a review hour for the well funded ones.

        Suppliers above 9000 reserve in days, which no team accepts.
        """
        balance = F.col("s_acctbal")
        base = self.read("supplier").select(
            F.col("s_nationkey").cast("string").alias("team_id"),
            F.col("s_suppkey").cast("string").alias("person_id"),
            F.explode(
                F.array_compact(
                    F.array(
                        F.struct(
                            F.lit("build").alias("activity"),
                            F.when(balance >= 0, F.floor(balance / 1000))
                            .cast(_MONEY)
                            .alias("per_day"),
                        ),
                        F.when(
                            balance >= 5000,
                            F.struct(
                                F.lit("review").alias("activity"),
                                F.lit(1).cast(_MONEY).alias("per_day"),
                            ),
                        ),
                    )
                )
            ).alias("r"),
            F.when(balance > 9000, "days").otherwise("hours").alias("unit"),
        )
        return base.select("team_id", "person_id", "r.activity", "r.per_day", "unit")

    @cached_property
    def days_off(self) -> DataFrame:
        """Error events are personal days off; large signups are team-wide ones."""
        event = self.read("events")
        start = F.date_sub(F.col("ts").cast("date"), 9496)
        share = (F.least(F.col("value").cast(_MONEY), F.lit(100)) / 100).cast("decimal(5,4)")
        team = F.col("s_nationkey").cast("string")
        personal = event.where("event_type = 'error'").join(
            self.read("supplier"), F.col("user_id") == F.col("s_suppkey")
        ).select(
            team.alias("team_id"),
            F.col("user_id").cast("string").alias("person_id"),
            start.alias("start"),
            F.date_add(start, 1).alias("end"),
            share.alias("fraction"),
        )
        whole_team = event.where("event_type = 'signup' and value >= 200").select(
            F.pmod("user_id", F.lit(25)).cast("string").alias("team_id"),
            F.lit(None).cast("string").alias("person_id"),
            start.alias("start"),
            F.date_add(start, 1).alias("end"),
            F.when(F.col("value") < 300, F.lit("0.5000")).cast("decimal(5,4)").alias("fraction"),
        )
        return personal.unionByName(whole_team)

    # -- revision history -----------------------------------------------------

    @cached_property
    def revisions(self) -> DataFrame:
        """Events of a user are the revisions of one item."""
        kind = F.col("event_type")
        even = F.pmod(F.get_json_object("props", "$.k").cast("bigint"), F.lit(2)) == 0
        return self.read("events").select(
            F.lit(ORGANIZATION).alias("organization"),
            F.col("user_id").alias("item_id"),
            F.pmod("user_id", F.lit(25)).cast("string").alias("team_id"),
            F.col("event_id").alias("revision"),
            F.col("ts").cast("timestamp").alias("changed_at"),
            kind.alias("state"),
            F.when(kind == "signup", "proposed")
            .when(kind.isin("view", "click"), "in_progress")
            .when(kind == "purchase", "completed")
            .alias("state_category"),
            F.when(even, "S1").otherwise("S2").alias("iteration_path"),
            F.col("value").cast(_MONEY).alias("story_points"),
        )

    @cached_property
    def history_windows(self) -> DataFrame:
        """Read every team against sprint S1 or S2; region 3 commits a day and a half late."""
        region = F.col("n_regionkey")
        start = F.lit(HISTORY[0]).cast("timestamp")
        late = F.lit("2024-01-09 12:00:00").cast("timestamp")
        end = F.lit(HISTORY[1]).cast("timestamp")
        return self.read("nation").select(
            F.col("n_nationkey").cast("string").alias("team_id"),
            F.when(region == 4, "S2").otherwise("S1").alias("iteration_path"),
            F.when(region == 3, late).otherwise(start).alias("commitment_at"),
            start.alias("since"),
            end.alias("until"),
            end.alias("as_of"),
        )

    @cached_property
    def requested_items(self) -> DataFrame:
        """Items whose history was asked for; region 0 asks for one that has none."""
        users = self.revisions.select("organization", "item_id", "team_id").distinct()
        absent = self.read("nation").where("n_regionkey = 0").select(
            F.lit(ORGANIZATION).alias("organization"),
            (-1 - F.col("n_nationkey")).cast("bigint").alias("item_id"),
            F.col("n_nationkey").cast("string").alias("team_id"),
        )
        return users.unionByName(absent)

    @cached_property
    def history_items(self) -> DataFrame:
        """The requested items with their creation, out of one scan."""
        users = self.read("events").groupBy("user_id").agg(
            F.min("ts").cast("timestamp").alias("created_at")
        )
        absent = self.read("nation").where("n_regionkey = 0")
        return users.select(
            F.lit(ORGANIZATION).alias("organization"),
            F.col("user_id").alias("item_id"),
            F.pmod("user_id", F.lit(25)).cast("string").alias("team_id"),
            "created_at",
        ).unionByName(
            absent.select(
                F.lit(ORGANIZATION).alias("organization"),
                (-1 - F.col("n_nationkey")).cast("bigint").alias("item_id"),
                F.col("n_nationkey").cast("string").alias("team_id"),
                F.lit(None).cast("timestamp").alias("created_at"),
            )
        )

    @cached_property
    def coverage(self) -> DataFrame:
        return history_coverage(self.requested_items, self.revisions)

    @cached_property
    def usable(self) -> DataFrame:
        return usable_revisions(self.revisions, self.coverage)

    @cached_property
    def usable_windows(self) -> DataFrame:
        ready = self.coverage.where("is_usable").select("team_id")
        return self.history_windows.join(ready, "team_id", "left_semi")

    @cached_property
    def created(self) -> DataFrame:
        """First event of every user."""
        return (
            self.read("events")
            .groupBy("user_id")
            .agg(F.min("ts").cast("timestamp").alias("created_at"))
            .select(
                F.lit(ORGANIZATION).alias("organization"),
                F.col("user_id").alias("item_id"),
                "created_at",
            )
        )

    # -- planning -------------------------------------------------------------

    @cached_property
    def planning_items(self) -> DataFrame:
        """Children and parents with dates, sprint and area."""
        orders = self.read("orders").select(
            (F.col("o_orderkey") * 10).alias("parent_id"),
            F.col("o_orderdate").cast("date").alias("start_date"),
        )
        regions = self.read("nation").select(
            F.col("n_nationkey").cast("string").alias("team_id"),
            F.col("n_regionkey").cast("string").alias("region"),
        )
        month = F.date_format("target_date", "yyyy-MM")
        fields = [
            "organization", "item_id", "team_id", "item_type", "state_category", "assigned_to",
            "remaining", "start_date", "target_date", "area_path", "iteration_path",
        ]
        # What is constant or told by the arrival is put back after it was shuffled.
        told = ("item_type", "assigned_to", "remaining_unit", "blocked", "target_date")
        arrived = deduplicate_items(self.raw_children.drop(*told), self.ARRIVAL).withColumns(
            {
                "parent_id": F.col("item_id") - F.pmod("item_id", F.lit(10)),
                "target_date": F.col("l_shipdate").cast("date"),
            }
        )
        children = attach(arrived.join(orders, "parent_id", "left"), regions, "team_id")
        children = (
            children.withColumns(
                {
                    "item_type": F.lit("Task"),
                    "assigned_to": F.col("l_suppkey").cast("string"),
                }
            )
            .withColumns(
                {
                    "area_path": F.concat_ws(
                        "\\", F.lit("area"), "region", F.substring("state", 1, 1)
                    ),
                    "iteration_path": F.concat_ws("-", F.lit("it"), month),
                }
            )
        )
        parents = self.parents.withColumns(
            {
                "start_date": F.date_sub("target_date", 30),
                "area_path": F.concat_ws(
                    "\\", F.lit("area"), F.pmod(F.col("team_id").cast("int") + 1, F.lit(7))
                ),
                "iteration_path": F.concat_ws("-", F.lit("it"), month),
            }
        )
        # Rules read items and, for their dates, the items' children.
        return children.select(*fields).unionByName(parents.select(*fields))

    @cached_property
    def rule_overrides(self) -> DataFrame:
        """Rule settings that differ from the defaults, by region."""

        def override(rule_id, enabled, severity, tolerance, exceptions=()):
            return F.struct(
                F.lit(rule_id).alias("rule_id"),
                F.lit(enabled).alias("enabled"),
                F.lit(severity).alias("severity"),
                F.lit(tolerance).alias("tolerance_days"),
                F.array(*[F.lit(e) for e in exceptions]).cast("array<string>").alias("exceptions"),
            )

        by_region = {
            0: [override("story_without_task", True, "high", 0),
                override("area_or_iteration_mismatch", True, "info", 0)],
            1: [override("missing_estimate", True, "info", 0),
                override("area_or_iteration_mismatch", True, "attention", 0)],
            2: [override("overdue_open_item", False, "info", 0),
                override("area_or_iteration_mismatch", True, "info", 0)],
            3: [override("overdue_open_item", True, "critical", 30),
                override("inverted_dates", True, "attention", 0, ("10", "21"))],
            4: [override("missing_required_fields", True, "info", 0,
                         ("require:assigned_to", "require:remaining"))],
        }
        chosen = F.when(F.col("n_regionkey") == 0, F.array(*by_region[0]))
        for region, rules in list(by_region.items())[1:]:
            chosen = chosen.when(F.col("n_regionkey") == region, F.array(*rules))
        return self.read("nation").select(
            F.col("n_nationkey").cast("string").alias("team_id"), F.inline(chosen)
        )

    @cached_property
    def closed_iterations(self) -> DataFrame:
        """Every team's sprints up to May 1997."""
        due = self.raw_children.select("team_id", "target_date").unionByName(
            self.parents.select("team_id", "target_date")
        )
        month = F.date_format("target_date", "yyyy-MM")
        return (
            due.where("target_date < date '1997-06-01'")
            .select("team_id", F.concat_ws("-", F.lit("it"), month).alias("iteration_path"))
            .distinct()
        )

    # -- people across teams --------------------------------------------------

    @cached_property
    def shared_people(self) -> DataFrame:
        """Every supplier in its own team and, with the funds for it, in a second one."""
        second = self.read("supplier").where("s_acctbal >= 3000").select(
            F.pmod(F.col("s_nationkey") + 7, F.lit(25)).cast("string").alias("team_id"),
            F.col("s_suppkey").cast("string").alias("person_id"),
            F.col("s_name").alias("display_name"),
        )
        return self.people.unionByName(second)

    @cached_property
    def shared_reservations(self) -> DataFrame:
        second = self.read("supplier").where("s_acctbal >= 3000").select(
            F.pmod(F.col("s_nationkey") + 7, F.lit(25)).cast("string").alias("team_id"),
            F.col("s_suppkey").cast("string").alias("person_id"),
            F.lit("support").alias("activity"),
            F.lit(2).cast(_MONEY).alias("per_day"),
            F.lit("hours").alias("unit"),
        )
        return self.reservations.unionByName(second)

    @cached_property
    def declared_availability(self) -> DataFrame:
        """Eight hours a day, in days for the best funded, undeclared for the least."""
        return self.read("supplier").where("s_acctbal >= 1000").select(
            F.col("s_suppkey").cast("string").alias("person_id"),
            F.lit(8).cast(_MONEY).alias("per_day"),
            F.when(F.col("s_acctbal") > 9500, "days").otherwise("hours").alias("availability_unit"),
        )

    # -- landed JSON ----------------------------------------------------------

    @cached_property
    def item_payloads(self) -> DataFrame:
        """One work item payload per line, in the shapes a source may answer with."""
        line = attach(self.read("lineitem"), self._supplier_team, "l_suppkey", "inner")
        identifier = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
        quantity = F.col("l_quantity").cast("int").cast("string")
        body = F.to_json(
            F.struct(
                F.when(flag != "A", F.concat(F.lit(" "), status, flag)).alias("System.State"),
                F.lit("Task").alias("System.WorkItemType"),
                F.concat(F.lit("part "), "l_partkey").alias("System.Title"),
                F.when(flag == "N", F.concat(F.lit("Supplier <sup"), "l_suppkey", F.lit("@org>")))
                .when(flag == "R", F.concat(F.lit("SUP"), "l_suppkey", F.lit("@ORG")))
                .alias("System.AssignedTo"),
                F.when(F.col("l_tax") > 0, F.when(flag == "R", "x; Blocked").otherwise("x")).alias(
                    "System.Tags"
                ),
                (F.col("l_orderkey") * 10).cast("string").alias("System.Parent"),
                F.when(F.col("l_discount") == 0, "n/a")
                .otherwise(quantity)
                .alias("Microsoft.VSTS.Scheduling.RemainingWork"),
                F.when(F.col("l_tax") > 0.02, quantity).alias(
                    "Microsoft.VSTS.Scheduling.OriginalEstimate"
                ),
                F.when(status == "F", F.date_format("l_shipdate", iso)).alias(
                    "Microsoft.VSTS.Scheduling.TargetDate"
                ),
                F.date_format("l_shipdate", "yyyy-MM-dd").alias("Microsoft.VSTS.Scheduling.DueDate"),
            )
        )
        whole, text = F.col("body"), F.col("record")
        record = (
            F.when(F.col("l_tax") == 0.08, F.concat(F.lit('{"fields":'), whole, F.lit("}")))
            .when(
                status == "F",
                F.concat(F.lit('{"id":'), identifier, F.lit(',"fields":'), whole, F.lit("}")),
            )
            .otherwise(
                F.concat(
                    F.lit('{"workItemId":"'), identifier, F.lit('",'),
                    F.substr(whole, F.lit(2)),
                )
            )
        )
        payload = (
            F.when(flag == "N", F.concat(F.lit('{"value":['), text, F.lit(",7]}")))
            .when(flag == "A", F.concat(F.lit("["), text, F.lit("]")))
            .otherwise(text)
        )
        # Staged, so that the code that renders the body stands once and not once per shape.
        return line.withColumn("body", body).withColumn("record", record).select(
            F.lit(ORGANIZATION).alias("organization"),
            "team_id",
            F.struct(*self.ARRIVAL).alias("arrival"),
            F.col("l_tax").alias("tax"),
            payload.alias("payload"),
        )

    @cached_property
    def link_payloads(self) -> DataFrame:
        flag = F.col("l_returnflag")
        link = F.struct(
            F.when(flag != "R", "System.LinkTypes.Hierarchy-Forward").alias("rel"),
            F.when(
                flag != "A", F.struct((F.col("l_orderkey") * 10).cast("string").alias("id"))
            ).alias("source"),
            F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).alias("target"),
        )
        return attach(self.read("lineitem"), self._supplier_team, "l_suppkey", "inner").select(
            F.lit(ORGANIZATION).alias("organization"),
            "team_id",
            F.to_json(F.struct(F.array(link).alias("workItemRelations"))).alias("payload"),
        )

    @cached_property
    def capacity_payloads(self) -> DataFrame:
        """One capacity payload per supplier; overdrawn ones come without an identity."""
        balance = F.col("s_acctbal")
        name = F.col("s_name")
        start = F.date_add(F.lit("1998-01-05").cast("date"), F.floor(F.abs(balance) / 1000).cast("int"))
        member = F.struct(
            F.when(balance >= 2000, F.concat(F.lit("p"), "s_suppkey")).alias("id"),
            F.when(balance >= 0, F.concat(F.lit("sup"), "s_suppkey", F.lit("@org"))).alias(
                "uniqueName"
            ),
            name.alias("displayName"),
        )
        activity = F.struct(
            F.lit("build").alias("name"),
            F.when(balance < 9000, F.floor(balance / 1000)).alias("capacityPerDay"),
        )
        off = F.struct(
            F.when(balance > 9500, "soon").otherwise(start.cast("string")).alias("start"),
            start.cast("string").alias("end"),
        )
        entry = F.struct(
            member.alias("teamMember"),
            F.when(balance >= 1000, F.array(activity)).alias("activities"),
            F.array(off).alias("daysOff"),
        )
        whole_team = F.struct(
            F.date_add(F.lit("1998-01-05").cast("date"), F.col("s_nationkey")).cast("string").alias("start"),
            F.date_add(F.lit("1998-01-05").cast("date"), F.col("s_nationkey")).cast("string").alias("end"),
        )
        payload = F.struct(
            F.array(entry).alias("teamMembers"),
            F.when(balance < 5000, F.array(whole_team)).alias("teamDaysOff"),
        )
        return self.read("supplier").select(
            F.col("s_nationkey").cast("string").alias("team_id"),
            F.col("s_suppkey").alias("arrival"),
            F.to_json(payload).alias("payload"),
        )

    @cached_property
    def iteration_payloads(self) -> DataFrame:
        """Three sprints per customer-as-team: one dated, one undated, one shifted by balance."""
        shifted = F.date_add(
            F.lit("1998-01-05").cast("date"), F.floor(F.col("c_acctbal") / 500).cast("int")
        )
        payload = F.concat(
            F.lit('{"iterations":[{"id":"a","path":"P1","attributes":{"startDate":"1997-12-22T00:00:00Z",'
                  '"finishDate":"1998-01-04T00:00:00Z"}},{"name":"P2"},{"id":"c","path":"P3","start":"'),
            shifted.cast("string"),
            F.lit('","finish":"'),
            F.date_add(shifted, 13).cast("string"),
            F.lit('"}]}'),
        )
        return self.read("customer").select(
            F.col("c_custkey").cast("string").alias("team_id"),
            F.col("c_custkey").alias("arrival"),
            payload.alias("payload"),
        )

    @cached_property
    def iteration_teams(self) -> DataFrame:
        segment = F.col("c_mktsegment")
        return self.read("customer").select(
            F.col("c_custkey").cast("string").alias("team_id"),
            F.when(segment == "BUILDING", "America/Sao_Paulo")
            .when(segment == "MACHINERY", "America/New_York")
            .otherwise("UTC")
            .alias("timezone"),
            F.lit(LOAD_AS_OF).cast("timestamp").alias("as_of"),
            F.when(segment == "AUTOMOBILE", "P2").when(segment == "FURNITURE", "P9").alias(
                "wanted_path"
            ),
        )

    @cached_property
    def revision_payloads(self) -> DataFrame:
        """One revision per event; errors come with an unusable instant."""
        kind = F.col("event_type")
        instant = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        fields = F.to_json(
            F.struct(
                F.when(kind == "error", "n/a").otherwise(instant).alias("System.ChangedDate"),
                kind.alias("System.State"),
                F.concat(F.lit("S"), F.length("props")).alias("System.IterationPath"),
                F.struct(F.concat(F.lit("u"), "user_id").alias("uniqueName")).alias(
                    "System.AssignedTo"
                ),
                F.col("value").cast("string").alias("Points"),
            )
        )
        number = F.when(kind == "signup", F.lit('"revision":')).otherwise(F.lit('"rev":'))
        return self.read("events").select(
            F.lit(ORGANIZATION).alias("organization"),
            F.pmod("user_id", F.lit(25)).cast("string").alias("team_id"),
            F.col("user_id").alias("item_id"),
            F.concat(
                F.lit('{"value":[{'), number, F.col("event_id").cast("string"),
                F.lit(',"fields":'), fields, F.lit("}]}"),
            ).alias("payload"),
        )

    @cached_property
    def state_map(self) -> DataFrame:
        """Known states of every team; errors stay unmapped."""
        states = F.array(
            *[
                F.struct(F.lit(state).alias("state"), F.lit(category).alias("state_category"))
                for state, category in (
                    ("signup", "proposed"), ("view", "in_progress"), ("click", "in_progress"),
                    ("purchase", "completed"), ("ON", "in_progress"), ("OR", "proposed"),
                    ("FN", "completed"), ("FR", "completed"), ("FA", "completed"),
                )
            ]
        )
        return self.read("nation").select(
            F.col("n_nationkey").cast("string").alias("team_id"), F.inline(states)
        )

    @cached_property
    def type_definitions(self) -> DataFrame:
        """Two item types per customer-as-team."""
        segment = F.col("c_mktsegment")
        task = F.concat(
            F.lit('{"states":[{"name":"To Do","category":"Proposed"},{"name":"Doing","category":"'),
            F.when(segment == "BUILDING", "Paused").otherwise("InProgress"),
            F.lit('"},{"name":"Done","category":"COMPLETED"}],"fields":[{"referenceName":'
                  '"Microsoft.VSTS.Scheduling.RemainingWork"},{"referenceName":"Other"}]}'),
        )
        story = F.concat(
            F.lit('{"states":[{"name":"Doing","category":"'),
            F.when(segment == "MACHINERY", "Resolved").otherwise("Unheard"),
            F.lit('"},{"category":"Proposed"}],"fields":['),
            F.when(F.col("c_acctbal") > 0,
                   F.lit('{"referenceName":"Microsoft.VSTS.Scheduling.StoryPoints"}')).otherwise(""),
            F.lit("]}"),
        )
        return self.read("customer").select(
            F.col("c_custkey").cast("string").alias("team_id"),
            F.posexplode(F.array(task, story)).alias("type_order", "payload"),
        )

    @cached_property
    def team_setting_payloads(self) -> DataFrame:
        segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
        flag = F.when(balance > 5000, "true").otherwise("false")
        first = F.concat(F.lit('{"value":"area"'),
                         F.when(segment != "BUILDING", F.lit(',"includeChildren":true')).otherwise(""),
                         F.lit("}"))
        second = F.concat(F.lit('{"path":"area-'), segment, F.lit('"'),
                          F.when(segment != "BUILDING", F.concat(F.lit(',"includeChildren":'), flag))
                          .otherwise(""), F.lit("}"))
        areas = F.when(segment == "FURNITURE", F.lit("")).otherwise(
            F.concat(F.lit('"areas":['), first, F.lit(","), second, F.lit("],"))
        )
        return self.read("customer").select(
            F.col("c_custkey").cast("string").alias("team_id"),
            F.concat(
                F.lit("{"), areas,
                F.lit('"workingDays":[1,2,3,4,5,9,'), F.pmod("c_nationkey", F.lit(7)).cast("string"),
                F.lit('],"bugsBehavior":'), F.pmod("c_nationkey", F.lit(4)).cast("string"), F.lit("}"),
            ).alias("payload"),
        )

    @cached_property
    def setting_layers(self) -> DataFrame:
        """Settings leaves per customer-as-team; stronger layers exist for some of them."""
        balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")

        def leaf(layer, key, value):
            return F.struct(F.lit(layer).alias("layer"), F.lit(key).alias("key"), value.alias("value"))

        rows = F.array_compact(
            F.array(
                leaf("default", "allocation.unit", F.lit("hours")),
                leaf("default", "calendar.timezone", F.lit("UTC")),
                leaf("profile", "capabilities", F.lit("current_status,allocation")),
                leaf("team", "calendar.timezone", segment),
                F.when(balance > 2000, leaf("local", "allocation.unit", F.lit("days"))),
                F.when(balance > 4000, leaf("run_all", "capabilities", F.lit("current_status"))),
                F.when(balance > 6000, leaf("run", "capabilities", F.lit("flow_history"))),
            )
        )
        return self.read("customer").select(
            F.col("c_custkey").cast("string").alias("team_id"), F.inline(rows)
        )

    # -- forecast -------------------------------------------------------------

    @cached_property
    def weekly_orders(self) -> DataFrame:
        """Completed orders per Monday week and customer group, zero weeks included."""
        done = self.read("orders").where("o_orderstatus = 'F'").select(
            F.pmod("o_custkey", F.lit(25)).cast("string").alias("team_id"),
            F.date_trunc("week", "o_orderdate").cast("date").alias("week"),
        )
        counts = done.groupBy("team_id", "week").agg(F.count(F.lit(1)).alias("completed"))
        first, last = (done.agg(bound("week")).scalar() for bound in (F.min, F.max))
        weeks = F.sequence(first, last, F.expr("interval 7 days"))
        spine = counts.select("team_id").distinct().select(
            "team_id", F.explode(weeks).alias("week")
        )
        return spine.join(counts, ["team_id", "week"], "left").select(
            "team_id", "week", F.coalesce("completed", F.lit(0)).cast("bigint").alias("completed")
        )

    @cached_property
    def open_scope(self) -> DataFrame:
        """Open orders per customer group."""
        return (
            self.read("orders")
            .groupBy(F.pmod("o_custkey", F.lit(25)).cast("string").alias("team_id"))
            .agg(F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("scope"))
        )

    # -- reports, claims and runs ---------------------------------------------

    @cached_property
    def findings(self) -> DataFrame:
        """Load findings of every team; negative work is severe, unmapped states are minor."""
        found = load_findings(self.accountable, self.settings)
        return found.withColumn(
            "severity",
            F.when(F.col("rule_id") == "negative_remaining_work", "critical")
            .when(F.col("rule_id") == "unmapped_state", "unheard")
            .otherwise("attention"),
        )

    @cached_property
    def decision_logs(self) -> list[DataFrame]:
        """Two decision logs out of conversations: what users said, then everything."""
        talk = self.read("conversations").select(
            F.concat(F.lit("d"), "conv_id").alias("id"),
            F.col("turn").alias("position"),
            F.col("role").alias("status"),
            F.col("text").alias("statement"),
        )
        first = talk.where("status = 'user'").withColumn("log_order", F.lit(0))
        return [first, talk.withColumn("log_order", F.lit(1))]

    @cached_property
    def replay_pair(self) -> tuple[DataFrame, DataFrame]:
        """Stored and recomputed quantities per supplier; returned untaxed lines moved."""
        line = self.read("lineitem")
        base = line.select(
            F.col("l_suppkey").cast("string").alias("run_id"),
            F.col("l_orderkey").alias("item_id"),
            F.col("l_quantity").cast("bigint").alias("value"),
        )
        moved = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0.08) & (
            F.col("l_discount") == 0.1), 1).otherwise(0)
        again = line.select(
            F.col("l_suppkey").cast("string").alias("run_id"),
            F.col("l_orderkey").alias("item_id"),
            (F.col("l_quantity").cast("bigint") + moved).alias("value"),
        )
        return base, again

    @cached_property
    def claims(self) -> DataFrame:
        """Every document is a claim about the run its source numbers."""
        lang, size = F.col("lang"), F.col("n_chars")
        cited = F.when(lang == "en", F.array(F.lit("known_remaining_work"))).when(
            lang == "de",
            F.array(
                F.lit("open_items_count"),
                F.concat(F.lit("evidence/items/"), F.col("doc_id") * 10, F.lit(".json")),
            ),
        ).when(lang == "es", F.array(F.lit("velocity"))).otherwise(F.array())
        return self.read("documents").select(
            F.substr("source", F.lit(4)).alias("run_id"),
            F.when(size % 2 == 0, "action").otherwise("hypothesis").alias("kind"),
            F.col("doc_id").alias("position"),
            F.col("text").alias("statement"),
            cited.cast("array<string>").alias("references"),
            F.when(size % 3 > 0, "to be confirmed").alias("condition"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """Open parents are the evidence of their team's run."""
        return self.parents.where("state_category = 'in_progress'").select(
            F.col("team_id").alias("run_id"), "item_id"
        )

    @cached_property
    def runs(self) -> DataFrame:
        """One run per user and day with events; a day with an error is partial."""
        day = F.to_date("ts")
        failed = F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)) == 1
        return (
            self.read("events")
            .groupBy("user_id", day.alias("day"))
            .agg(F.max("ts").cast("timestamp").alias("as_of"), failed.alias("failed"))
            .select(
                F.concat_ws("-", F.date_format("day", "yyyyMMdd"), "user_id").alias("run_id"),
                F.col("user_id").cast("string").alias("team_id"),
                "as_of",
                F.when(F.col("failed"), "partial").otherwise("complete").alias("state"),
                F.when(F.col("failed"), F.array(F.lit("work_items")))
                .otherwise(F.array())
                .cast("array<string>")
                .alias("partial_reasons"),
                "day",
            )
        )

    @cached_property
    def run_values(self) -> DataFrame:
        """What each run measured: its events."""
        return self.read("events").select(
            F.concat_ws("-", F.date_format("ts", "yyyyMMdd"), "user_id").alias("run_id"),
            F.col("event_type").alias("metric_id"),
            F.col("event_id").alias("item_id"),
            F.col("value").cast(_MONEY).cast("string").alias("value"),
        )
