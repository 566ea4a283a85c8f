"""Readers and sinks of evidence: JSON lines with quarantine, tenant-partitioned Parquet, integrity events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from provenix.operators import validate

#: The column type of each kind of body member; objects and what may be anything stay JSON text.
TYPES = {"s": "string", "e": "string", "d": "string", "t": "timestamp", "n": "bigint", "p": "bigint", "b": "boolean", "o": "string", "j": "string", "l": "array<string>"}
LEDGER = ("tenant_id", "record_id", "stream_id", "sequence", "source_time")
#: Members that a body may have beside those it must have.
OPTIONAL = {"PopulationRecord": "record_identifiers array<string>, identifier_digest string", "ActionProposal": "parameters string"}


def body_schema(record_type: str) -> str:
    """The columns of a type's body, from the same table that validation reads."""
    own = ", ".join(f"{name} {TYPES[kind]}" for name, kind, _, _ in validate.members_of(record_type))
    return f"{own}, {OPTIONAL[record_type]}" if record_type in OPTIONAL else own


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) records of JSON-lines files; a bad line keeps its text and its codes."""
    return validate.split(spark.read.text(path).withColumnRenamed("value", "wire"))


def typed_view(records: DataFrame, record_type: str, wire: str = "wire") -> DataFrame:
    """Records of one type: ledger columns and the members of its body. Those that are named like a ledger column have the prefix body_."""
    body = F.from_json(F.get_json_object(wire, "$.body"), body_schema(record_type))
    own = validate.projection(wire)
    return records.where(F.get_json_object(wire, "$.record_type") == record_type).select(*(own[k].alias(k) for k in ("tenant_id", "record_id", "stream_id", "sequence", "source_time")), body.alias("b")).select("tenant_id", "record_id", "stream_id", "sequence", "source_time", *(F.col(f"b.{f.name}").alias(f"body_{f.name}" if f.name in LEDGER else f.name) for f in StructType.fromDDL(body_schema(record_type))))


def append(records: DataFrame, path: str) -> None:
    """Adds records to a ledger table, one folder a tenant, each sorted so that scans by stream can skip."""
    records.sortWithinPartitions("tenant_id", "stream_id", "sequence").write.partitionBy("tenant_id").mode("append").parquet(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_events(conflicts: DataFrame, path: str) -> None:
    """Rejected forks and substitutions, append-only."""
    conflicts.where(F.col("outcome").isin("fork", "content_substitution")).write.mode("append").parquet(path)
