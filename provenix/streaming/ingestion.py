"""The ingest stream: every submitted text is validated, its collector and key are checked at its own source time, and it is classified against the ledger.

Validation and the two registry checks are part of the streaming plan (stream-static temporal joins); each micro-batch then ends in three tables, written
under the batch's epoch: the ledger, the integrity conflicts that the tenant sees, and the refusals. A batch that runs again replaces its own rows, and
its epoch is committed after all three, so a reader of committed epochs sees either all or nothing of a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenix.operators import ingest, validate
from provenix.sources.shared import drop, folder, keep, scratch

#: What a record's text is read as; a text that isn't a record has nulls and is refused by its codes.
ENVELOPE = (
    "record_id string, record_type string, tenant_id string, boundary_ref string, stream_id string, sequence bigint, prev_digest string, clocks struct<source_time: string>, "
    "source struct<collector_id: string, version: string, implementation: string>, signature struct<key_id: string>"
)
TABLES = ("ledger", "conflicts", "refusals")
#: Tenants of a micro-batch, up to which the ledger's other tenants are not read.
TENANTS = 1000


def read_records(submissions: DataFrame) -> DataFrame:
    """submissions(submission_id, wire, sig_ok) with what the ledger knows of a record."""
    r = F.from_json("wire", ENVELOPE)
    return submissions.withColumn("_r", r).select(
        *submissions.columns, *(F.col(f"_r.{k}").alias(k) for k in ("record_id", "record_type", "tenant_id", "boundary_ref", "stream_id", "sequence", "prev_digest")),
        F.to_timestamp("_r.clocks.source_time").alias("source_time"), F.col("_r.source.collector_id").alias("collector_id"), F.col("_r.source.version").alias("collector_version"),
        F.col("_r.source.implementation").alias("implementation"), F.col("_r.signature.key_id").alias("key_id"), F.concat(F.lit("sha256:"), F.sha2("wire", 256)).alias("wire_digest"),
    )


def checked(submissions: DataFrame, collectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds codes (all that is wrong with the text), stage and reason: the first check that refuses the record, null if none does.

    In order: record, origin (customers may only send what is signed as evidence), collector, key, position. Works on batch and streaming input alike; the registries are
    aggregated by their key first, so that no submission meets more than one row of each.
    """
    text = submissions.withColumn("codes", validate.codes(F.col("wire")))
    both = ingest.key_state(ingest.authenticate(read_records(text), collectors), keys)
    signer = F.create_map(*(F.lit(x) for kv in validate.SIGNERS.items() for x in kv))
    checks: list[tuple[str, Column, Column]] = [
        ("record", F.size("codes") > 0, F.element_at("codes", 1)),
        ("origin", ~F.element_at(signer, F.col("record_type")).eqNullSafe("evidence"), F.lit("not_customer_evidence")),
        ("collector", F.coalesce("collector_id", F.lit("")) == "", F.lit("collector_missing")), ("collector", F.col("auth") != "ok", F.col("auth")),
        ("key", F.coalesce("key_id", F.lit("")) == "", F.lit("key_missing")), ("key", F.col("key_state") != "ok", F.col("key_state")),
        ("position", (F.col("sequence") == 1) != F.col("prev_digest").isNull(), F.lit("position_domain")),
    ]
    stage, reason = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, bad, why in checks:
        stage, reason = stage.when(bad, F.lit(name)), reason.when(bad, why)
    return both.withColumns({"stage": stage, "reason": reason}).drop("auth", "key_state")


def _held(spark: SparkSession, path: str, schema: StructType, epoch: int, batch: DataFrame) -> DataFrame:
    """The ledger's rows of other epochs; if the batch is of few tenants, of theirs only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    # the schema is given: a tenant's folder name "001" is not the number 1
    held = spark.read.schema(StructType(schema.fields).add("epoch", "long")).parquet(path).where(F.col("epoch") != epoch)  # a batch that runs again does not meet itself
    tenants = [r[0] for r in batch.select("tenant_id").distinct().limit(TENANTS + 1).collect()]
    return held.where(F.col("tenant_id").isin(tenants)) if len(tenants) <= TENANTS else held


def _with_rival(conflicts: DataFrame, held: DataFrame) -> DataFrame:
    """Beside each conflict, the accepted record that it meets: for a fork the one at its position, for a substitution the one of its id."""
    at = held.select(*ingest.POSITION, F.struct(F.col("record_id").alias("id"), F.col("wire_digest").alias("digest")).alias("_at"))
    of = held.select(*ingest.IDENTITY, F.struct(F.col("record_id").alias("id"), F.col("wire_digest").alias("digest")).alias("_of"))
    both = conflicts.join(at, ingest.POSITION, "left").join(of, ingest.IDENTITY, "left")
    rival = F.when(F.col("outcome") == "fork", F.col("_at")).otherwise(F.col("_of"))
    return both.withColumns({"existing_record_id": rival["id"], "existing_digest": rival["digest"]}).drop("_at", "_of")


def write_batch(batch: DataFrame, epoch: int, root: str) -> None:
    """Classifies the checked submissions of one micro-batch and writes the three tables, then the commit of its epoch."""
    spark = batch.sparkSession
    at = folder(spark, "batch")
    batch = keep(batch, f"{at}/checked")
    sound = batch.where("stage is null").drop("codes", "stage", "reason")
    held = _held(spark, f"{root}/ledger", sound.schema, epoch, sound)
    against = keep(ingest.classify_against_ledger(sound, held), f"{at}/against")
    fresh, known = against.where("outcome = 'accept'").drop("outcome"), against.where("outcome <> 'accept'")
    with scratch(spark):  # both parts are stored, so the ledger may change while they are read
        done = ingest.classify_in_order(fresh).unionByName(known)
        accepted = done.where("outcome = 'accept'").drop("outcome")
        conflicts = _with_rival(done.where("outcome in ('fork', 'content_substitution')"), held.drop("epoch").unionByName(accepted))
        replays = done.where("outcome = 'replay'").drop("outcome").withColumns({"codes": F.array().cast("array<string>"), "stage": F.lit("replay"), "reason": F.lit("replay")})
        refusals = batch.where("stage is not null").unionByName(replays)
        for name, rows, by in (("ledger", accepted, ["tenant_id", "epoch"]), ("conflicts", conflicts, ["epoch"]), ("refusals", refusals, ["epoch"])):
            rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{root}/{name}")
    spark.range(1).select(F.lit(epoch).alias("epoch"), F.lit(True).alias("done")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{root}/commits")
    drop(spark, at)


def run(submissions: DataFrame, collectors: DataFrame, keys: DataFrame, root: str, checkpoint: str) -> None:
    """Takes in what the stream of submissions(submission_id, wire, sig_ok) holds now.

    submission_id is the order of arrival in a batch; sig_ok tells whether the signature verifies. Each submission ends in exactly one table: ledger, conflicts (fork,
    content_substitution, with the record they meet), or refusals (with stage and reason; a replay is one).
    """
    checked(submissions, collectors, keys).writeStream.foreachBatch(lambda batch, epoch: write_batch(batch, epoch, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's rows of the epochs that are whole. The few epochs are a small table of their own."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{table}").join(spark.read.parquet(f"{root}/commits").select("epoch").distinct(), "epoch", "left_semi")
