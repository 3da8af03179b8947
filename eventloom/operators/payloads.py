"""Payload contracts by domain: types, ranges, lengths and defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import object_map
from eventloom.functions.once import once
from eventloom.operators.drift import raw_type


@dataclass(frozen=True)
class Field:
    """``kind`` is string, number, integer or boolean. A field is required, or may be null (``optional``), or has a default."""

    name: str
    kind: str = "string"
    required: bool = False
    default: object = None
    low: float | None = None
    high: float | None = None
    length: int | None = None

    @property
    def optional(self) -> bool:
        return not self.required and self.default is None


def _must(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n, required=True) for n in names)


def _may(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n) for n in names)


# Fields, types, ranges and defaults of the payloads.
CONTRACTS: dict[str, tuple[Field, ...]] = {
    "orders": (
        *_must("order_id", "customer_id", "product_id"), Field("quantity", "integer", True, low=1), Field("unit_price", "number", True, low=0), Field("discount_amount", "number", default=0, low=0), Field("currency", default="USD", length=3),
        Field("status", default="created"), Field("channel", default="web"), *_may("marketing_campaign_id", "region"),
    ),
    "payments": (
        *_must("payment_id", "order_id", "customer_id"), Field("amount", "number", True, low=0), Field("currency", default="USD", length=3), *_must("status"), Field("payment_method", default="card"), *_may("failure_code"), Field("risk_score", "number", low=0, high=1),
    ),
    "users": (*_must("user_id", "action"), *_may("session_id", "page", "referrer"), Field("duration_seconds", "integer", default=0, low=0), *_may("plan", "marketing_campaign_id")),
    "products": (*_must("product_id", "sku", "name", "category"), Field("price", "number", True, low=0), Field("inventory_delta", "integer", default=0), Field("active", "boolean", default=True)),
    "system": (
        *_must("service_name", "status"), Field("latency_ms", "number", low=0), Field("error_count", "integer", default=0, low=0), Field("throughput_per_minute", "number", low=0), Field("kafka_lag", "integer", low=0), Field("cache_hit_rate", "number", low=0, high=1), *_may("message"),
    ),
}


def _problem(f: Field) -> Column:
    """Which rule of a field a payload ``_p`` (map of variants) breaks first: missing, null, type, range or length."""
    v = F.element_at("_p", f.name)
    kind, text = raw_type(F.schema_of_variant(v)), F.try_variant_get(v, "$", "string")
    number = text.try_cast("double")
    is_number = number.isNotNull() & kind.isin("number", "string")
    right = {
        "string": kind == "string",
        "number": is_number,
        "integer": is_number & (number == F.floor(number)),
        "boolean": (kind == "boolean") | (F.lower(text).isin("true", "false")),
    }[f.kind]
    rules = [(v.isNull(), "missing" if f.required else None), (kind == "null", None if f.optional else "null"), (~F.coalesce(right, F.lit(False)), "type")]
    if f.low is not None:
        rules.append((number < f.low, "range"))
    if f.high is not None:
        rules.append((number > f.high, "range"))
    if f.length is not None:
        rules.append((F.length(text) != f.length, "length"))
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(test, F.lit(name).cast("string")).otherwise(out)
    return out


def checked(events: DataFrame) -> DataFrame:
    """Adds violations, sorted ``field:rule`` of the contract of each event's ``domain``, and is_conforming.

    A payload that is no JSON object has the violation ``payload:type``; an unknown
    domain isn't judged (null).
    """
    rows = once(events, _p=object_map("payload", "variant"))
    per = F.lit(None).cast("array<string>")
    for domain, fields in CONTRACTS.items():
        found = F.array_compact(F.array(*[F.concat(F.lit(f"{f.name}:"), _problem(f)) for f in sorted(fields, key=lambda f: f.name)]))
        per = F.when(F.col("domain") == domain, F.when(F.col("_p").isNull(), F.array(F.lit("payload:type"))).otherwise(found)).otherwise(per)
    return once(rows, violations=per).drop("_p").withColumn("is_conforming", F.size("violations") == 0)


def with_defaults(events: DataFrame, domain: str) -> DataFrame:
    """Typed columns of one domain's conforming payloads, defaults in place of absent fields."""
    types = {"string": "string", "number": "double", "integer": "bigint", "boolean": "boolean"}
    rows = once(events.filter((F.col("domain") == domain) & F.col("is_conforming")), _p=object_map("payload"))
    value = lambda f: F.element_at("_p", f.name).try_cast(types[f.kind])
    typed = [(value(f) if f.default is None else F.coalesce(value(f), F.lit(f.default).cast(types[f.kind]))).alias(f.name) for f in CONTRACTS[domain]]
    return rows.select("tenant_id", "event_id", "event_timestamp", *typed)
