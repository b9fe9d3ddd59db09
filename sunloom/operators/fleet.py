"""Dashboards over the fleet: status counts, star joins, access scope, listings and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom import config
from sunloom.functions.grading import category_order


def all_of(*conditions: Column | None) -> Column:
    """AND of the conditions that were given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def placed(df: DataFrame, inverters: DataFrame, blocks: DataFrame, plants: DataFrame) -> DataFrame:
    """Add device, block and plant to rows that carry inverter_id; rows of unknown devices drop out.

    The dimensions are joined to each other first, so the large side is joined once. No hint: the optimiser
    broadcasts a dimension that measures small and shuffles one that does not.
    """
    places = inverters.join(blocks, "block_id").join(plants, "plant_id")
    return df.join(places, "inverter_id")


def alert_feed(alerts: DataFrame, inverters: DataFrame, blocks: DataFrame, plants: DataFrame, people: DataFrame,
               plant_id=None, kind: str | None = None, acknowledged: bool | None = None) -> DataFrame:
    """Alerts with their place and the name of who acknowledged them, filtered by what is given."""
    wanted = all_of(None if kind is None else F.col("type") == kind,
                    None if acknowledged is None else F.col("acknowledged") == acknowledged)
    scope = plants if plant_id is None else plants.where(F.col("plant_id") == plant_id)
    names = people.select(F.col("operator_id").alias("acknowledged_by"), F.col("name").alias("acknowledged_by_name"))
    return placed(alerts.where(wanted), inverters, blocks, scope).join(names, "acknowledged_by", "left")


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0, cap: int | None = None) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset(offset).limit(limit if cap is None else min(limit, cap))


def grid(devices: DataFrame, by: str = "severity") -> DataFrame:
    """All devices in the order a dashboard shows them: worst grade first, by id, or latest data first (`last_us`)."""
    newest, device = F.desc_nulls_last("last_us"), F.col("inverter_id")
    orders = {"severity": [category_order(F.col("current_category")).desc(), newest, device], "id": [device], "updated": [newest, device]}
    return devices.orderBy(*orders[by])


def status_counts(inverters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals by health; offline also counts devices that are graded but not online."""
    grade, online = F.col("current_category"), F.col("is_online")
    return inverters.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(grade.isin("A", "B")).alias("healthy"),
        F.count_if(grade == "C").alias("warning"), F.count_if(grade.isin("D", "E")).alias("critical"),
        F.count_if((grade == "offline") | ~online).alias("offline"))


def category_columns(inverters: DataFrame, by: list[str] | None = None, category: str = "current_category") -> DataFrame:
    """Devices per grade as columns, zero where a grade is missing."""
    return inverters.groupBy(*(by or [])).agg(
        *[F.count_if(F.col(category) == c).alias(c) for c in config.CATEGORIES])


def plant_summary(plants: DataFrame, blocks: DataFrame, inverters: DataFrame, admins: DataFrame) -> DataFrame:
    """Blocks and devices per plant, zero for empty plants, and who created the plant."""
    per_block = inverters.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    counts = (blocks.join(per_block, "block_id", "left").groupBy("plant_id")
              .agg(F.count("block_id").alias("block_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("inverter_count")))
    creators = admins.select(F.col("admin_id").alias("created_by"), F.col("name").alias("created_by_name"))
    return (plants.join(counts, "plant_id", "left").fillna(0, ["block_count", "inverter_count"])
            .join(creators, "created_by", "left"))


def block_counts(blocks: DataFrame, inverters: DataFrame) -> DataFrame:
    per_block = inverters.groupBy("block_id").agg(F.count(F.lit(1)).alias("inverter_count"))
    return blocks.join(per_block, "block_id", "left").fillna(0, ["inverter_count"])


def nested_plants(plants: DataFrame, blocks: DataFrame, inverters: DataFrame) -> DataFrame:
    """One row per plant in service with its ordered blocks and their device counts."""
    counted = block_counts(blocks, inverters)
    item = F.struct("block_name", "block_id", "inverter_count")
    lists = counted.groupBy("plant_id").agg(F.sort_array(F.collect_list(item)).alias("blocks"))
    return (plants.where(F.col("status") != "decommissioned").join(lists, "plant_id", "left")
            .withColumn("blocks", F.coalesce("blocks", F.array().cast(lists.schema["blocks"].dataType))))


def scoped(df: DataFrame, access: DataFrame, operator: Column | None = None) -> DataFrame:
    """Rows whose plant the operator may see; a semi join, so nothing is duplicated."""
    allowed = access if operator is None else access.where(operator)
    return df.join(allowed, "plant_id", "left_semi")


def operator_directory(operators: DataFrame, access: DataFrame, plants: DataFrame) -> DataFrame:
    """Operators with their plants as ordered text; operators without access keep NULL."""
    per = (access.join(plants, "plant_id").groupBy("operator_id").agg(
        F.sort_array(F.collect_list("plant_name")).alias("names"),
        F.sort_array(F.collect_list("plant_id")).alias("ids")))
    per = per.select("operator_id", F.array_join("names", ", ").alias("plant_names"),
                     F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("plant_ids"))
    return operators.join(per, "operator_id", "left")


def needs_attention(inverters: DataFrame, limit: int = 20) -> DataFrame:
    """Devices graded D or E, worst first."""
    return (inverters.where(F.col("current_category").isin("D", "E"))
            .orderBy(category_order(F.col("current_category")).desc(), "inverter_id").limit(limit))


def named_audit(logs: DataFrame, admins: DataFrame, operators: DataFrame) -> DataFrame:
    """Log rows with the acting person's name, looked up in the table their role points to."""
    people = (admins.select(F.lit("admin").alias("user_role"), F.col("admin_id").alias("user_id"), "name")
              .unionByName(operators.select(F.lit("operator").alias("user_role"),
                                            F.col("operator_id").alias("user_id"), "name")))
    return logs.join(people.withColumnRenamed("name", "user_name"), ["user_id", "user_role"], "left")


def principals(admins: DataFrame, operators: DataFrame, access: DataFrame) -> DataFrame:
    """Admins and operators in one list with role and, for operators, assigned plants."""
    plants = access.groupBy("operator_id").agg(F.sort_array(F.collect_list("plant_id")).alias("ids"))
    people = operators.join(plants, "operator_id", "left").select(
        F.col("operator_id").alias("id"), "name", F.lit("operator").alias("role"), "is_active",
        F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("assigned_plants"))
    return people.unionByName(admins.select(F.col("admin_id").alias("id"), "name", F.lit("admin").alias("role")),
                              allowMissingColumns=True)


def threshold_bands(thresholds_json: Column, one_row: DataFrame) -> DataFrame:
    """Rows (band, low, high) from the stored thresholds document."""
    bands = F.explode(F.from_json(thresholds_json, "map<string,array<int>>")).alias("band", "range")
    return one_row.select(bands).select("band", F.element_at("range", 1).alias("low"),
                                        F.element_at("range", 2).alias("high"))


def banded(df: DataFrame, score: Column, thresholds_json: str = config.THRESHOLDS_JSON) -> DataFrame:
    """Grade a score with a threshold document: rows in no band get NULL, bands are tried A to E.

    The document holds one range per grade, so it is read as a map in the row itself: no join is needed.
    """
    ranges = F.from_json(F.lit(thresholds_json), "map<string,array<int>>")
    hits = F.filter(F.map_entries(ranges), lambda e: score.between(F.get(e["value"], F.lit(0)), F.get(e["value"], F.lit(1))))
    return df.withColumn("band", F.array_min(F.transform(hits, lambda e: e["key"])))


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key over the stored and the incoming rows, merged as an aggregation."""
    rest = [c for c in current.columns if c not in keys]
    both = current.unionByName(changes.select(*current.columns))
    newest = F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("row")
    return both.groupBy(*keys).agg(newest).select(*keys, "row.*")


def stale_devices(readings: DataFrame, inverters: DataFrame, as_of: Column, minutes: int = config.STALE_MINUTES) -> DataFrame:
    """Every device with its last data time and whether it has been silent for longer than `minutes`."""
    last = readings.groupBy("inverter_id").agg(F.max("ts").alias("last_data_at"))
    quiet = F.unix_micros(as_of) - F.unix_micros("last_data_at") > minutes * 60_000_000
    return inverters.join(last, "inverter_id", "left").withColumn("is_stale", F.coalesce(quiet, F.lit(True)))


def silent_blocks(devices: DataFrame) -> DataFrame:
    """Blocks whose devices are all stale."""
    return devices.groupBy("block_id").agg(F.count(F.lit(1)).alias("devices"), F.every("is_stale").alias("all_stale"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key; Spark keeps only k per partition before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
