"""Event envelopes: parsing, validation, routing, dead letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.jsontext import object_map
from eventloom.functions.once import once

# Fields of an envelope, the required ones first; event types; versions; required payload fields.
REQUIRED = ("event_id", "tenant_id", "event_type", "event_timestamp", "source_service", "payload_version", "trace_id", "correlation_id", "idempotency_key")
OPTIONAL = ("causation_id", "schema_ref")
EVENT_TYPES = {
    "orders": ("order.created", "order.updated"),
    "payments": ("payment.authorized", "payment.captured", "payment.failed"),
    "users": ("user.activity", "user.signed_up", "user.churn_signal"),
    "products": ("product.upserted", "product.inventory_changed"),
    "system": ("system.health", "system.alert"),
}
VERSIONS = (1, 2)
PAYLOAD_REQUIRED = {
    "orders": ("order_id", "customer_id", "product_id", "quantity", "unit_price"),
    "payments": ("payment_id", "order_id", "customer_id", "amount", "status"),
    "users": ("user_id", "action"),
    "products": ("product_id", "sku", "name", "category", "price"),
    "system": ("service_name", "status"),
}
REASONS = ("malformed_json", "missing_required_fields", "invalid_event_timestamp", "blank_tenant_id", "unknown_event_type", "unsupported_payload_version", "missing_required_payload_fields")
# The identifying payload field by which a domain's events are keyed.
BUSINESS_KEY = {"orders": "order_id", "payments": "payment_id", "users": "user_id", "products": "product_id", "system": "service_name"}

_ENV = T.StructType([T.StructField(n, T.StringType()) for n in REQUIRED + OPTIONAL])


def parse(records: DataFrame, value: str = "value") -> DataFrame:
    """Envelopes from JSON text or bytes; every record stays, with flags.

    Adds the envelope's fields (event_timestamp as a timestamp, payload as its JSON
    text), raw_value, is_malformed (not a JSON object), missing_fields, has_bad_timestamp
    and is_structurally_valid. An absent correlation_id is the trace_id, an absent
    idempotency_key the event_id; ids are trimmed. A null value is malformed.
    """
    raw = F.col(value).cast("string")
    env = F.from_json(raw, _ENV)
    rest = [F.col(c) for c in records.columns if c != value]
    parsed = once(records, raw_value=raw, _e=env, is_malformed=object_map(raw).isNull(), _p=F.get_json_object(raw, "$.payload"))
    text = lambda n: F.when(~F.col("is_malformed"), F.trim(F.col(f"_e.{n}")))
    ts = text("event_timestamp")
    filled = {"correlation_id": F.coalesce(text("correlation_id"), text("trace_id")), "idempotency_key": F.coalesce(text("idempotency_key"), text("event_id"))}
    missing = F.array_compact(F.array(*[F.when(filled.get(n, text(n)).isNull(), F.lit(n)) for n in REQUIRED], F.when(F.col("_p").isNull(), F.lit("payload"))))
    fields = F.struct(
        "raw_value",
        "is_malformed",
        *[filled.get(n, text(n)).alias(n) for n in REQUIRED + OPTIONAL if n not in ("event_timestamp", "payload_version")],
        F.try_to_timestamp(ts).alias("event_timestamp"),
        text("payload_version").try_cast("int").alias("payload_version"),
        F.when(~F.col("is_malformed"), F.col("_p")).alias("payload"),
        F.when(~F.col("is_malformed"), missing).otherwise(F.array().cast("array<string>")).alias("missing_fields"),
        F.coalesce(ts.isNotNull() & F.try_to_timestamp(ts).isNull(), F.lit(False)).alias("has_bad_timestamp"),
    )
    out = parsed.select(*rest, F.inline(F.array(fields)))
    return out.withColumn("is_structurally_valid", ~F.col("is_malformed") & (F.size("missing_fields") == 0) & ~F.col("has_bad_timestamp"))


def domain(event_type: str | Column = "event_type") -> Column:
    """The domain of a known event type, else null."""
    c = F.col(event_type) if isinstance(event_type, str) else event_type
    return reduce(lambda rest, d: F.when(c.isin(*d[1]), d[0]).otherwise(rest), EVENT_TYPES.items(), F.lit(None).cast("string"))


def validate(parsed: DataFrame, versions: tuple[int, ...] = VERSIONS) -> DataFrame:
    """Adds domain, missing_payload_fields, reason (the first that applies, in the order of REASONS) and is_valid."""
    with_domain = once(parsed.withColumn("domain", domain()), _m=object_map("payload"))
    absent = lambda d: F.array_compact(F.array(*[F.when(F.element_at("_m", n).isNull(), F.lit(n)) for n in PAYLOAD_REQUIRED[d]]))
    missing = reduce(lambda rest, d: F.when(F.col("domain") == d, absent(d)).otherwise(rest), PAYLOAD_REQUIRED, F.array().cast("array<string>"))
    flagged = with_domain.withColumn("missing_payload_fields", missing)
    tests = (
        F.col("is_malformed"),
        F.size("missing_fields") > 0,
        F.col("has_bad_timestamp"),
        F.trim("tenant_id") == "",
        F.col("domain").isNull(),
        ~F.coalesce(F.col("payload_version").isin(*versions), F.lit(False)),
        F.size("missing_payload_fields") > 0,
    )
    reason = F.coalesce(*[F.when(t, F.lit(r)) for t, r in zip(tests, REASONS)])
    return once(flagged.drop("_m"), reason=reason, is_valid=reason.isNull())


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid)."""
    return validated.filter("is_valid"), validated.filter("not is_valid")


def partition_key() -> Column:
    """tenant:business id, or the event id where the payload names none."""
    business = reduce(lambda rest, d: F.when(domain() == d[0], F.get_json_object("payload", f"$.{d[1]}")).otherwise(rest), BUSINESS_KEY.items(), F.lit(None).cast("string"))
    return F.concat_ws(":", F.lower(F.trim("tenant_id")), F.coalesce(F.nullif(business, F.lit("")), F.col("event_id")))


def idempotent_id(tenant: Column, event_type: Column, source: Column, key: Column) -> Column:
    """A deterministic event id."""
    return F.concat(F.lit("idem_"), F.substring(F.sha2(F.concat_ws("|", tenant, event_type, source, key), 256), 1, 32))


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def dead_letters(rejected: DataFrame, written_at: Column | None = None, default_reason: str = "late_rejected") -> DataFrame:
    """(key, value) records for the dead-letter topic; the value keeps the original text and where it came from.

    Columns that ``rejected`` lacks (topic, partition, offset) are null in the letter.
    The key is the tenant, or ``unknown``.
    """
    body = F.to_json(
        F.struct(
            F.col("event_id").alias("original_event_id"),
            "tenant_id",
            "event_type",
            _or_null(rejected, "source_service").alias("source_service"),
            F.coalesce("reason", F.lit(default_reason)).alias("rejection_reason"),
            _or_null(rejected, "topic").alias("original_topic"),
            _or_null(rejected, "partition", "int").alias("original_partition"),
            _or_null(rejected, "offset", "bigint").alias("original_offset"),
            "raw_value",
            F.coalesce(written_at if written_at is not None else F.current_timestamp()).cast("string").alias("dlq_written_at"),
        )
    )
    return rejected.select(F.coalesce(F.nullif(F.trim("tenant_id"), F.lit("")), F.lit("unknown")).alias("key"), body.alias("value"))


def inspect_dead_letters(letters: DataFrame, event_id: str | Column | None = None, limit: int | None = None) -> DataFrame:
    """reason, stage and original envelope of dead letters (key, value) in any of their shapes.

    A letter of the stream names its reason and holds the original text. A letter of the
    services is itself an envelope whose payload.message is JSON with error, failed_stage
    and original_event, or whose payload has the original_event; a message that is no
    JSON is the reason. Anything else is its own original, the reason unknown.
    ``event_id`` selects letters of one event, ``limit`` bounds how many are read.
    """
    flat = F.from_json("value", "rejection_reason string, raw_value string")
    message = F.get_json_object("value", "$.payload.message")
    inner = lambda f: F.get_json_object(message, f"$.{f}")
    shaped = once(letters, _s=flat, _m=message, _error=inner("error"), _stage=inner("failed_stage"), _original=F.coalesce(inner("original_event"), F.get_json_object("value", "$.payload.original_event")))
    out = shaped.select(
        "key",
        F.coalesce(F.col("_s.rejection_reason"), "_error", "_m", F.lit("unknown")).alias("reason"),
        F.when(F.col("_s.raw_value").isNotNull(), "stream").otherwise(F.col("_stage")).alias("failed_stage"),
        F.coalesce(F.col("_s.raw_value"), "_original", "value").alias("original"),
    )
    if event_id is not None:
        out = out.filter(F.get_json_object("original", "$.event_id") == event_id)
    return out if limit is None else out.limit(limit)


def replay(originals: DataFrame, at: Column) -> DataFrame:
    """Original envelopes to send again: (topic, key, value) and the fields of the new envelope.

    The new envelope is the old one with a new event_id and idempotency_key, the given
    time, and the old id as causation; payload, version, trace and the rest are kept. A
    letter whose original is no JSON object, or has no event_id, can't be sent again.
    """
    rows = once(originals, _e=F.from_json("original", _ENV), _ok=object_map("original").isNotNull(), payload=F.get_json_object("original", "$.payload"))
    old = {n: F.trim(F.col(f"_e.{n}")) for n in REQUIRED + OPTIONAL}
    new_id = F.concat(F.lit("replay_"), F.substring(F.sha2(old["event_id"], 256), 1, 24))
    changed = {"event_id": new_id, "idempotency_key": new_id, "causation_id": old["event_id"], "event_timestamp": at, "payload_version": old["payload_version"].try_cast("int"), "correlation_id": F.coalesce(old["correlation_id"], old["trace_id"])}
    sent = rows.filter(F.col("_ok") & old["event_id"].isNotNull()).select(*[(changed.get(n, old[n])).alias(n) for n in REQUIRED + OPTIONAL], "payload")
    stamped = F.date_format(F.col("event_timestamp").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp")
    head = F.to_json(F.struct(*[stamped if n == "event_timestamp" else F.col(n) for n in REQUIRED + OPTIONAL]))
    value = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), _json_value("payload"), F.lit("}"))
    topic = F.concat(F.coalesce(domain(), F.lit("unrouted")), F.lit(".events"))
    return sent.select(topic.alias("topic"), partition_key().alias("key"), value.alias("value"), *REQUIRED, *OPTIONAL, "payload")


def _json_value(text: str) -> Column:
    """Extracted JSON as a value to splice into JSON: objects and arrays as they are, anything else as a string, null as null."""
    c = F.col(text)
    return F.when(c.isNull(), "null").when(c.rlike(r"^\s*[\[{]"), c).otherwise(F.substring(F.to_json(F.array(c)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2))
