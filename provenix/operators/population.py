"""Denominators: enumeration, completeness, eligibility, disagreement, permission timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCOPE = ["tenant_id", "boundary_ref", "population_ref"]


def enumerate_window(items: DataFrame) -> DataFrame:
    """One population for each scope and window of an export: ids in (time, id) order, their number, first and last time."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("authoritative_time", "destination_record_id"))), lambda x: x["destination_record_id"])
    return items.groupBy(*SCOPE).agg(ids.alias("record_identifiers"), F.count(F.lit(1)).alias("count"), F.min("authoritative_time").alias("ts_min"), F.max("authoritative_time").alias("ts_max"))


def page_completeness(log: DataFrame) -> DataFrame:
    """By query: complete, or the first reason why not. Rows must add up to a total that never changes, over a chain of pages that ends once."""
    got = log.groupBy("query_id").agg(
        F.sum("n_records").alias("n_records"), F.max("total_size").alias("total_size"), F.count_distinct("total_size").alias("n_totals"), F.bool_or("failed").alias("failed"),
        F.count_if(F.col("next_url").isNull()).alias("n_ends"), (F.count("next_url") - F.count_distinct("next_url")).alias("n_repeated"),
    )
    reason = (
        F.when(F.col("failed"), "page_failed").when(F.col("n_repeated") > 0, "next_link_repeated").when(F.col("n_ends") != 1, "next_link_absent")
        .when(F.col("n_totals") > 1, "total_changed").when(F.col("n_records") != F.col("total_size"), "rows_differ_from_total").otherwise("complete")
    )
    return got.select("query_id", "n_records", "total_size", reason.alias("state"))


def confirm(actions: DataFrame, destination: DataFrame) -> DataFrame:
    """Actions with the digest of the record the destination holds for them; none is ``unmatched_without_evidence``."""
    got = actions.join(destination, ["tenant_id", "boundary_ref", "destination_record_id", "action_id"], "left")
    return got.withColumn("state", F.when(F.col("destination_record_digest").isNull(), "unmatched_without_evidence").otherwise("confirmed"))


def eligibility(populations: DataFrame, as_of: str, lag_s: str = "settlement_lag_s") -> DataFrame:
    due = F.col("window_end") + F.make_dt_interval(secs=F.col(lag_s))
    return populations.withColumn("eligible_at", due).withColumn("pending", F.lit(as_of).cast("timestamp") < F.col("eligible_at"))


def alerts(populations: DataFrame) -> DataFrame:
    codes = F.array_compact(F.array(
        F.when(F.col("result_cap_hit"), "result_cap_hit"), F.when(~F.col("pagination_complete"), "pagination_incomplete"), F.when(F.col("observed_lag_s") > F.col("settlement_lag_s"), "settlement_lag_exceeded")
    ))
    return populations.withColumn("alerts", codes)


def disagreements(enumerations: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Pairs (earlier, later) of enumerations of the same family, destination and window, with the sorted names of fields that differ."""
    key = ["tenant_id", "action_family", "destination_system", "window_start", "window_end"]
    a = enumerations.select(*key, F.col("enumeration_id").alias("earlier"), *(F.col(f).alias(f"a_{f}") for f in fields), F.col("retrieved_at").alias("a_at"))
    b = enumerations.select(*key, F.col("enumeration_id").alias("later"), *(F.col(f).alias(f"b_{f}") for f in fields), F.col("retrieved_at").alias("b_at"))
    differ = F.array_sort(F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f) for f in fields))))
    return a.join(b, key).where("a_at < b_at or (a_at = b_at and earlier < later)").select(*key, "earlier", "later", differ.alias("fields")).where(F.size("fields") > 0)


def integrity(populations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): ids present, none empty, none twice, as many as signed. Refused rows carry their first reason."""
    ids = F.col("record_identifiers")
    reason = (
        F.when(ids.isNull(), "digest_only").when(F.size(ids) != F.col("signed_count"), "count_differs").when(F.exists(ids, lambda x: x == ""), "empty_identifier")
        .when(F.size(F.array_distinct(ids)) != F.size(ids), "repeated_identifier")
    )
    marked = populations.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def identifier_digest(items: DataFrame) -> DataFrame:
    """(SCOPE, count, identifier_digest) of items(SCOPE, destination_record_id): a digest of the set of identifiers, in whatever order they come.

    Identifiers are ordered by their SHA-256 and cut into chunks by its first two bytes; a population's digest is that of its chunks' digests in order. A population of any size is spread over its
    chunks, and what is gathered of it at the end is 65536 digests at most. Repeated identifiers count each.
    """
    keys, h = SCOPE, F.sha2("destination_record_id", 256)
    chunks = items.select(*keys, h.alias("h")).groupBy(*keys, F.substring("h", 1, 4).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "d"))), lambda x: x["d"]), "")
    return chunks.groupBy(*keys).agg(F.sum("n").alias("count"), F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("identifier_digest"))


def digest_audit(populations: DataFrame, items: DataFrame) -> DataFrame:
    """Digest-only populations against the identifiers that the destination still enumerates: confirmed, count_differs, digest_differs, or not_enumerated."""
    own = identifier_digest(items).select(*SCOPE, F.col("count").alias("_n"), F.col("identifier_digest").alias("_d"))
    state = F.when(F.col("_n").isNull(), "not_enumerated").when(F.col("_n") != F.col("signed_count"), "count_differs").when(F.col("_d") != F.col("identifier_digest"), "digest_differs").otherwise("confirmed")
    return populations.where("identifier_digest is not null").join(own, SCOPE, "left").withColumn("state", state).drop("_n", "_d")


def observation_audit(populations: DataFrame) -> DataFrame:
    """Codes for retrieval times: equal to the source time, after settlement, not after it was observed."""
    codes = F.array_compact(F.array(
        F.when(F.col("retrieved_at") != F.col("source_time"), "retrieved_at_differs"), F.when(F.col("source_time") < F.col("eligible_at"), "before_settlement"), F.when(F.col("source_time") > F.col("observed_at"), "after_observation")
    ))
    return populations.withColumn("codes", codes)


def next_positions(stored: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """Positions for a batch of appends: after the stream's last one, in the given order; a new stream begins at 1."""
    last = stored.groupBy("tenant_id", "stream_id").agg(F.max("sequence").alias("last_sequence"), F.max_by("record_digest", "sequence").alias("last_digest"))
    w = Window.partitionBy("tenant_id", "stream_id").orderBy(order)
    joined = batch.join(last, ["tenant_id", "stream_id"], "left")
    return joined.withColumn("sequence", F.coalesce("last_sequence", F.lit(0)) + F.row_number().over(w)).withColumn("prev_digest", F.coalesce(F.lag("record_digest").over(w), "last_digest")).drop("last_sequence", "last_digest")


def unknown_intervals(checks: DataFrame) -> DataFrame:
    """For each check that is not clean and follows a clean one: the whole interval since that clean check is unknown."""
    w = Window.partitionBy("scope").orderBy("checked_at", "check_id").rowsBetween(Window.unboundedPreceding, -1)
    clean = F.last(F.when(F.col("outcome") == "confirmed-clean", F.col("checked_at")), ignorenulls=True).over(w)
    top = F.when(F.col("outcome") == "confirmed-clean", "c1").when(F.col("outcome") == "confirmed-granted", "c5")
    timed = checks.withColumn("unknown_from", clean).withColumn("max_class", top)
    hit = (F.col("outcome") != "confirmed-clean") & (F.col("unknown_from") < F.col("checked_at"))
    return timed.select("scope", "check_id", "outcome", "max_class", F.when(hit, F.col("unknown_from")).alias("unknown_from"), F.when(hit, F.col("checked_at")).alias("unknown_to"))


def to_revisit(attested: DataFrame, unknown: DataFrame) -> DataFrame:
    """Issued windows that an unknown interval of their scope overlaps."""
    return attested.join(unknown.where("unknown_from is not null"), "scope").where("unknown_from < window_end and window_start < unknown_to").select("scope", "window_start", "window_end").distinct()


def isolation_profile(attributed: DataFrame, human_actors: DataFrame) -> DataFrame:
    """By population: records without an actor, records by an actor that people use too; either means class c5."""
    people = human_actors.select("actor").distinct().withColumn("human", F.lit(True))
    got = attributed.join(people, "actor", "left").groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("actor").isNull()).alias("n_unattributed"), F.count_if(F.coalesce("human", F.lit(False))).alias("n_shared"))
    return got.withColumn("max_class", F.when((F.col("n_unattributed") > 0) | (F.col("n_shared") > 0), "c5").otherwise("c1"))


def binding(populations: DataFrame, boundaries: DataFrame, families: DataFrame, history: DataFrame) -> DataFrame:
    """Populations joined to their boundary, family and qualification rows; what is missing is named."""
    b = boundaries.select("tenant_id", "boundary_ref", F.col("window_start").alias("b_start"), F.col("window_end").alias("b_end"))
    f = families.select("boundary_ref", "action_family", "destination_system").distinct().withColumn("declared", F.lit(True))
    q = history.groupBy("tenant_id", "action_family", "destination_system").agg(F.count(F.lit(1)).alias("n_qualifications"))
    got = populations.join(b, ["tenant_id", "boundary_ref"], "left").join(f, ["boundary_ref", "action_family", "destination_system"], "left").join(q, ["tenant_id", "action_family", "destination_system"], "left")
    reason = (
        F.when(F.col("b_start").isNull(), "boundary_missing").when((F.col("window_start") < F.col("b_start")) | (F.col("window_end") > F.col("b_end")), "window_outside_boundary")
        .when(F.col("declared").isNull(), "family_undeclared").when(F.col("n_qualifications").isNull(), "unqualified").otherwise("bound")
    )
    return got.withColumn("state", reason).drop("b_start", "b_end", "declared", "n_qualifications")


def write(populations: DataFrame, path: str) -> DataFrame:
    """Files populations that stand up to ``integrity`` as two tables below path: their headers, and one row for each identifier, in order; returns what was refused.

    Both are partitioned by tenant and dealt by population, so that a reconciliation of some tenants reads those only. Writing the same populations again replaces their tenants' files.
    """
    good, refused = integrity(populations)
    put = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id")
    put(good.drop("record_identifiers")).parquet(f"{path}/populations")
    items = good.select(*SCOPE, F.posexplode("record_identifiers").alias("pos", "destination_record_id"))
    put(items.repartition("tenant_id", "population_ref", F.pmod("pos", F.lit(64)))).parquet(f"{path}/population_items")
    return refused
