"""Reconciliation: every enumerated record gets one of six statuses from exact identities.

Every side is aggregated by its own key before it meets the population, so no join multiplies rows, and one record with very
many receipts is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.sources.shared import stored

STATUSES = ("matched", "unmatched_with_evidence", "unmatched_without_evidence", "duplicate", "ambiguous", "out_of_scope")
SCOPE = ["tenant_id", "boundary_ref"]
ITEM = [*SCOPE, "population_ref", "destination_record_id"]


def in_scope_receipts(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts whose destination record a population of the same scope enumerates, with that population."""
    return receipts.join(items.select(*ITEM), [*SCOPE, "destination_record_id"])


def receipt_facts(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """By enumerated record: how many receipts, and the action of a single one."""
    return in_scope_receipts(items, receipts).groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n_receipts"), F.min("action_id").alias("receipt_action"))


def confirmation_facts(items: DataFrame, confirmations: DataFrame) -> DataFrame:
    joined = confirmations.join(items.select(*ITEM, F.col("destination_system").alias("own_system")), [*SCOPE, "destination_record_id"])
    return joined.groupBy(*ITEM).agg(
        F.count(F.lit(1)).alias("n_confirmations"), F.min("action_id").alias("confirmation_action"), F.min("record_id").alias("confirmation_record"),
        F.min("destination_record_digest").alias("content"), F.bool_or(F.col("destination_system") != F.col("own_system")).alias("other_system"),
    )


def spanning_actions(items: DataFrame, receipts: DataFrame) -> DataFrame:
    """(population, action, n_records): actions whose receipts name more than one record of one population."""
    return (
        in_scope_receipts(items, receipts).groupBy(*SCOPE, "population_ref", "action_id").agg(F.count_distinct("destination_record_id").alias("n_records")).where("n_records > 1")
    )


def duplicate_records(items: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Records whose single confirmation, in their own destination, has the content of another record of the population."""
    single = confirmation_facts(items, confirmations).where("n_confirmations = 1 and not other_system")
    twins = single.groupBy(*SCOPE, "population_ref", "content").agg(F.count(F.lit(1)).alias("n_twins")).where("n_twins > 1")
    return single.join(twins, [*SCOPE, "population_ref", "content"]).select(*ITEM, "content", "n_twins")


def evidence_by_action(items: DataFrame, receipts: DataFrame, confirmations: DataFrame, timed: bool = False) -> DataFrame:
    """By enumerated record and action: how many receipts and confirmations, and what the confirmations say; n_r is null for a record without either. Both sides are
    one table here, counted by record and action before it meets the populations. n_copies: how often the population names the record.

    timed: with the confirmed_at of confirmations, and ingest_time and clock_skew_ms of receipts.
    """
    record = ["destination_record_id", *SCOPE]  # what tells most rows apart comes first: sorts are decided by it
    own = {"record_id": "string", "destination_record_digest": "string", "destination_system": "string"} | ({"authoritative_time": "timestamp"} if timed else {})
    theirs = {"ingest_time": "timestamp", "clock_skew_ms": "long"} if timed else {}
    none = lambda cols: [F.lit(None).cast(t).alias(c) for c, t in cols.items()]
    r = receipts.select(*record, "action_id", F.lit(1).alias("r"), *none(own), *(F.col(c).cast(t) for c, t in theirs.items()))
    c = confirmations.select(*record, "action_id", F.lit(0).alias("r"), *own, *none(theirs))
    times = [F.max(F.when(F.col("record_id").isNotNull(), F.col("authoritative_time"))).alias("confirmed_at"), *(F.max(x).alias(x) for x in theirs)] if timed else []
    each = r.unionByName(c).groupBy(*record, "action_id").agg(
        F.sum("r").alias("n_r"), (F.count(F.lit(1)) - F.sum("r")).alias("n_c"), F.min("record_id").alias("confirmation_record"), F.min("destination_record_digest").alias("content"),
        F.min("destination_system").alias("low_system"), F.max("destination_system").alias("high_system"), *times,
    )
    wanted = items.select(*record, "population_ref", "action_family", F.col("destination_system").alias("own_system")).repartition(*record)
    wanted = wanted.withColumn("n_copies", F.count(F.lit(1)).over(Window.partitionBy(*record, "population_ref")))
    return wanted.join(each, record, "left").withColumn("other_system", (F.col("low_system") != F.col("own_system")) | (F.col("high_system") != F.col("own_system"))).drop("low_system", "high_system", "own_system")


def evidenced(items: DataFrame, receipts: DataFrame, confirmations: DataFrame, proposals: DataFrame, timed: bool = True) -> DataFrame:
    """``classify`` with what it saw on the way: confirmed_at of a named confirmation, ingest_time and clock_skew_ms of the receipt that names the action.

    The rows are dealt by record (evidence and populations), by content, by action (proposals, and records one action spans), and by record again; no input is read twice, and contents
    travel once.
    """
    by_action = proposals.groupBy("action_id", *SCOPE).agg(F.count(F.lit(1)).alias("n_proposals"), F.min("action_family").alias("low"), F.max("action_family").alias("high"))
    by_action = by_action.withColumnRenamed("action_id", "dealt")
    named, seen, got = evidence_by_action(items, receipts, confirmations, timed), F.col("n_r").isNotNull(), F.col("n_r") > 0
    item = ["destination_record_id", *SCOPE, "population_ref"]
    whole = Window.partitionBy(*item)
    # the row that holds a record's single confirmation stands for its content
    single = (F.col("n_c") == 1) & (F.sum("n_c").over(whole) == 1) & ~F.coalesce(F.bool_or("other_system").over(whole), F.lit(False)) & F.col("content").isNotNull()
    twin_of = F.when(F.col("single"), F.col("content")).otherwise(F.col("destination_record_id"))
    twins = F.count_if("single").over(Window.partitionBy(F.xxhash64(twin_of), twin_of, *SCOPE, "population_ref"))
    named = named.withColumn("single", F.coalesce(single, F.lit(False))).withColumn("twin", F.col("single") & (twins > 1)).drop("content", "single")
    # a record without evidence has no action to be dealt by
    named = named.withColumn("dealt", F.when(seen, F.col("action_id")).otherwise(F.concat(F.lit("\0"), "destination_record_id"))).repartition("dealt", *SCOPE)
    spans = seen & (F.sum(got.cast("int")).over(Window.partitionBy("dealt", *SCOPE, "population_ref", seen)) > 1)
    named = named.withColumn("spans", spans).join(by_action, ["dealt", *SCOPE], "left")
    proposed, known = F.when(seen, F.col("n_proposals")), F.col("action_id").isNotNull()
    times = [F.max("confirmed_at").alias("confirmed_at"), *(F.max(F.when(got & known, F.col(x))).alias(x) for x in ("ingest_time", "clock_skew_ms"))] if timed else []
    told = ["n_copies", "n_r", "n_c", "action_id", "confirmation_record", "other_system", "twin", "spans", *(["confirmed_at", "ingest_time", "clock_skew_ms"] if timed else [])]
    named = named.select(
        *item, *told, proposed.alias("proposed"), (seen & ((F.col("low") != F.col("action_family")) | (F.col("high") != F.col("action_family")))).alias("other_family"),
        (got & (F.col("n_c") > 0) & known & (proposed == 1) & (F.col("low") == F.col("action_family"))).alias("agrees"),
    )
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    facts = named.repartition(*item).groupBy(*item).agg(
        F.coalesce(F.sum("n_r"), F.lit(0)).alias("nr"), F.coalesce(F.sum("n_c"), F.lit(0)).alias("nc"), F.min(F.when(got, F.col("action_id"))).alias("receipt_action"), F.min("confirmation_record").alias("confirmation_record"),
        F.coalesce(F.max("proposed"), F.lit(0)).alias("most_proposals"), F.max("n_copies").alias("n_copies"), *(any_of(c) for c in ("other_system", "other_family", "spans", "twin", "agrees")), *times,
    )
    nr, nc = F.col("nr"), F.col("nc")
    status = (
        F.when(F.col("other_system") | F.col("other_family"), "out_of_scope").when((nr > 1) | (nc > 1) | (F.col("most_proposals") > 1) | F.col("spans"), "ambiguous").when(F.col("twin"), "duplicate")
        .when((nr == 1) & (nc == 1) & F.col("agrees"), "matched").when(nr > 0, "unmatched_with_evidence").otherwise("unmatched_without_evidence")
    )
    own, held = (nr == 1) & (F.col("status") != "ambiguous"), F.col("status").isin("duplicate", "matched")
    kept = [F.when(held, F.col("confirmed_at")).alias("confirmed_at"), *(F.when(own, F.col(x)).alias(x) for x in ("ingest_time", "clock_skew_ms"))] if timed else []
    return facts.withColumn("status", status).withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(n_copies as int))"))).select(
        *ITEM, "status", F.when(own, F.col("receipt_action")).alias("action_id"), F.when(held, F.col("confirmation_record")).alias("confirmation_record_id"), *kept
    )


def classify(items: DataFrame, receipts: DataFrame, confirmations: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row for each enumerated record: status, action_id, confirmation_record_id.

    Order of decision: out of scope, ambiguous, duplicate, matched, unmatched with evidence, unmatched without. The action is
    kept only where exactly one receipt names it and the record is not ambiguous; the confirmation only for duplicates and matches.
    """
    return evidenced(items, receipts, confirmations, proposals, timed=False)


def out_of_scope(items: DataFrame, receipts: DataFrame, confirmations: DataFrame, proposals: DataFrame) -> DataFrame:
    """(scope, population_ref, out_of_scope): how many of a population's records ``classify`` calls out of scope, where nothing else of the classification is asked for. A population without any has no row.

    Confirmations and proposals that agree with all records of their scope take no part: only what differs from one of them is moved.
    """
    record = ["destination_record_id", *SCOPE]
    kinds = items.groupBy(*SCOPE, "action_family", "destination_system").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    kinds = kinds.groupBy(*SCOPE).agg(F.collect_set("action_family").alias("families"), F.collect_set("destination_system").alias("systems"))
    kinds = stored(kinds, "kinds")  # a row a scope, of a size that Spark then knows
    elsewhere = confirmations.join(kinds, SCOPE).where("exists(systems, x -> x <> destination_system)").select(*record, F.col("destination_system").alias("_system"), F.lit(None).cast("string").alias("_family"))
    odd = proposals.join(kinds, SCOPE).where("exists(families, x -> x <> action_family)").select("action_id", *SCOPE, F.col("action_family").alias("_family")).distinct()
    named = receipts.select(*record, "action_id").unionByName(confirmations.select(*record, "action_id")).join(odd.hint("shuffle_hash"), ["action_id", *SCOPE])
    signs = elsewhere.unionByName(named.select(*record, F.lit(None).cast("string").alias("_system"), "_family")).groupBy(*record).agg(
        F.min("_system").alias("low_system"), F.max("_system").alias("high_system"), F.min("_family").alias("low"), F.max("_family").alias("high")
    )
    own = items.select(*ITEM, "action_family", "destination_system").join(signs.hint("shuffle_hash"), record)
    differs = " or ".join(f"coalesce({a} <> {b}, false)" for a, b in (("low_system", "destination_system"), ("high_system", "destination_system"), ("low", "action_family"), ("high", "action_family")))
    # a record that the population names twice counts twice, also where only one of the two differs
    each = own.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.expr(differs)).alias("out")).where("out")
    return each.groupBy(*SCOPE, "population_ref").agg(F.sum("n").alias("out_of_scope"))


def counts(results: DataFrame, *keys: str) -> DataFrame:
    """Six counts by key, zeros included."""
    return results.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("n"))


def roll_up(results: DataFrame) -> DataFrame:
    """The six counts by population, boundary, tenant and in all; a null key stands for all of its values."""
    return results.rollup("tenant_id", "boundary_ref", "population_ref").agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count(F.lit(1)).alias("n"))


def conservation(results: DataFrame, populations: DataFrame) -> DataFrame:
    """Signed count against the number of results, by population; a population without results counts 0."""
    got = results.groupBy(*SCOPE, "population_ref").agg(F.count(F.lit(1)).alias("n_results"))
    return populations.join(got, [*SCOPE, "population_ref"], "left").select(*SCOPE, "population_ref", "signed_count", F.coalesce("n_results", F.lit(0)).alias("n_results")).withColumn("conserved", F.col("signed_count") == F.col("n_results"))


def replay_difference(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that only one of two result tables has, each as often as it is missing from the other."""
    cols = stored.columns
    return stored.exceptAll(rebuilt.select(*cols)).withColumn("side", F.lit("stored")).unionByName(rebuilt.select(*cols).exceptAll(stored).withColumn("side", F.lit("rebuilt")))


def unmatched_rate(results: DataFrame, populations: DataFrame, trailing: int = 6) -> DataFrame:
    """Share of unmatched records in ten-thousandths, and its mean over the tenant's ``trailing`` earlier windows (whole numbers, truncated)."""
    rate = counts(results, *SCOPE, "population_ref").withColumn("rate", F.expr("10000 * (unmatched_with_evidence + unmatched_without_evidence) div n"))
    before = Window.partitionBy(*SCOPE).orderBy("window_start", "population_ref").rowsBetween(-trailing, -1)
    joined = rate.join(populations.select(*SCOPE, "population_ref", "window_start"), [*SCOPE, "population_ref"])
    total, n = F.sum("rate").over(before), F.count("rate").over(before)
    return joined.select(*SCOPE, "population_ref", "rate", F.when(n > 0, F.floor(total / n)).cast("long").alias("trailing_rate"))
