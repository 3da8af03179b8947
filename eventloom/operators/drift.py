"""Payload schemas that drift between files: one typed table, and every change per file.

Each payload becomes a map from path to value with its raw JSON type. What the files
show is aggregated as statistics (file, version, missing, extra, retyped) before
anything is joined, so the later steps see patterns, not records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import object_map
from eventloom.functions.once import once
from eventloom.session import cut_lineage

# The first word of event_type and the domain it belongs to.
DOMAINS = {"order": "orders", "payment": "payments", "user": "users", "product": "products", "system": "system"}
# The notations of schema_ref; group 1 is the domain, group 2 the version.
REF_PATTERNS = (
    r"^contracts/([a-z]+)-payload/v(\d+)\.json$",
    r"^urn:contract:([a-z]+):(\d+)$",
    r"^([a-z]+)/v(\d+)$",
)
#: A contract is configuration; a larger one is refused rather than broadcast.
MAX_CONTRACT_ROWS = 10_000


def domain_of(word: Column) -> Column:
    """The domain named by an event type's first word or by a reference, singular or plural."""
    named = F.lower(F.trim(word))
    return reduce(lambda rest, d: F.when(named.isin(d[0], d[1]), d[1]).otherwise(rest), DOMAINS.items(), F.lit(None).cast("string"))


def raw_type(variant_schema: Column) -> Column:
    """string, number, boolean, null, array or object, from ``schema_of_variant``."""
    s = variant_schema
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def path_values(payload: Column) -> Column:
    """array<struct<name, kind, value>> of a JSON object's top-level fields; null for
    anything that isn't a valid JSON object. Nested values stay JSON text.

    Of fields with the same name each is listed.
    """
    fields = F.map_entries(object_map(payload, "variant"))
    return F.transform(
        fields,
        lambda e: F.struct(e["key"].alias("name"), raw_type(F.schema_of_variant(e["value"])).alias("kind"), e["value"].try_cast("string").alias("value")),
    )


def signature(kind: Column, value: Column) -> Column:
    """What values of one field have in common: letters as they are, digits as #; whether a number has decimals."""
    return F.when(kind == "string", F.concat(F.lit("s:"), F.regexp_replace(F.lower(value), r"\d+", "#"))).when(
        kind == "number", F.when(value.rlike(r"[.eE]"), "n:dec").otherwise("n:int")
    ).when(kind == "boolean", "b")


def records(raw_events: DataFrame) -> DataFrame:
    """landing_file, domain, version, schema_ref and fields of each payload that is a valid JSON object."""
    rows = raw_events.select(
        "landing_file",
        domain_of(F.split_part(F.col("event_type"), F.lit("."), F.lit(1))).alias("domain"),
        F.col("payload_version").alias("version"),
        "schema_ref",
        "payload",
    )
    return once(rows, fields=path_values(F.col("payload"))).drop("payload").filter("fields is not null")


def checked(contract: DataFrame) -> DataFrame:
    """The contract, if it is small enough to go to every task: the payloads of a domain and
    version are far too many to be gathered by that key."""
    if contract.limit(MAX_CONTRACT_ROWS + 1).count() > MAX_CONTRACT_ROWS:
        raise ValueError(f"a contract of more than {MAX_CONTRACT_ROWS} rows")
    return contract


def contract_sets(contract: DataFrame) -> DataFrame:
    """One row per (domain, version): its fields with types, the required ones, and all names the domain has in any version."""
    rows = contract.select(
        F.col("domain_name").alias("domain"), F.col("payload_version").alias("version"), F.col("field_name").alias("name"), F.col("json_type").alias("kind"), "is_required"
    ).dropna()
    names = rows.groupBy("domain").agg(F.collect_set("name").alias("all_names"))
    sets = rows.groupBy("domain", "version").agg(
        F.map_from_entries(F.collect_set(F.struct("name", "kind"))).alias("types"),
        F.sort_array(F.collect_set(F.when(F.col("is_required"), F.col("name")))).alias("required"),
    )
    return sets.join(names, "domain")


def _ref(schema_ref: Column) -> tuple[Column, Column]:
    ref = F.lower(F.trim(schema_ref))
    part = lambda g: F.coalesce(*[F.nullif(F.regexp_extract(ref, p, g), F.lit("")) for p in REF_PATTERNS])
    return domain_of(part(1)), part(2).try_cast("int")


_PATTERN = (
    "landing_file string, domain string, version int, known boolean, ref_differs boolean, missing array<string>, "
    "extra array<struct<name:string,kind:string,sig:string,elsewhere:boolean>>, retyped array<string>"
)
_MARK = "\u0001"


def observed(raw_events: DataFrame, contract: DataFrame) -> DataFrame:
    """Path-type statistics of one pass over the payloads: (what, n).

    A ``what`` that begins with p is a pattern of departures of a file, as JSON: missing
    (required names that are absent), extra (fields not listed, with signature), retyped
    (listed names whose non-null value has another type), ref_differs (schema_ref names
    another domain or version; one in no known notation names neither). Records without
    any departure have none. One that begins with s is a signature under which a
    required field's values of the right type stand somewhere: domain, name, signature.
    Both are counted before the shuffle, so only distinct ones move.
    """
    ref_domain, ref_version = _ref(F.col("schema_ref"))
    differs = (~ref_domain.eqNullSafe(F.col("domain")) | ~ref_version.eqNullSafe(F.col("version"))) & ref_domain.isNotNull()
    names = F.transform("fields", lambda f: f["name"])
    listed = lambda f: F.map_contains_key("types", f["name"])
    nothing = F.array().cast("array<string>")
    required = contract.filter("is_required").select(F.col("domain_name").alias("domain"), F.col("field_name").alias("name"), F.col("json_type").alias("kind")).distinct()
    signed = required.groupBy("domain").agg(F.map_from_entries(F.collect_set(F.struct("name", "kind"))).alias("signed"))
    rows = records(raw_events).join(F.broadcast(contract_sets(contract)), ["domain", "version"], "left").join(F.broadcast(signed), "domain", "left")
    flagged = rows.select(
        "landing_file",
        "domain",
        "version",
        F.col("types").isNotNull().alias("known"),
        F.coalesce(differs, F.lit(False)).alias("ref_differs"),
        F.coalesce(F.array_except("required", names), nothing).alias("missing"),
        F.transform(
            F.filter("fields", lambda f: ~listed(f)),
            lambda f: F.struct(f["name"].alias("name"), f["kind"].alias("kind"), signature(f["kind"], f["value"]).alias("sig"), F.array_contains("all_names", f["name"]).alias("elsewhere")),
        ).alias("extra"),
        F.coalesce(F.transform(F.filter("fields", lambda f: listed(f) & (f["kind"] != "null") & (f["kind"] != F.element_at("types", f["name"]))), lambda f: f["name"]), nothing).alias("retyped"),
        F.transform(
            F.filter("fields", lambda f: F.element_at("signed", f["name"]) == f["kind"]), lambda f: F.concat_ws(_MARK, F.lit("s"), "domain", f["name"], signature(f["kind"], f["value"]))
        ).alias("sigs"),
    )
    # the flags are computed once a row, though the test and the text both use them
    once_flagged = flagged.select("sigs", F.inline(F.array(F.struct(*[c for c in flagged.columns if c != "sigs"]))))
    departs = ~F.col("known") | F.col("ref_differs") | (F.size("missing") > 0) | (F.size("extra") > 0) | (F.size("retyped") > 0)
    pattern = F.when(departs, F.concat(F.lit("p"), F.to_json(F.struct(*[c for c in flagged.columns if c != "sigs"]))))
    tags = F.concat(F.coalesce("sigs", nothing), F.array_compact(F.array(pattern)))
    return once_flagged.select(F.explode(tags).alias("what")).groupBy("what").agg(F.count("*").alias("n"))


def changes(raw_events: DataFrame, contract: DataFrame) -> DataFrame:
    """(landing_file, field_name, change, n_records): every change a file shows.

    change is added, removed, renamed, retyped, unknown_version or ref_mismatch. An
    extra field stands in for a missing one if its value has the signature of that
    field's values elsewhere, or the right type and a similar name; names the contract
    lists for another version never do. Of several pairs in a record the one with more
    evidence wins, then the first by name; each name is used once. A null payload_version or an event type
    of no known domain counts as an unknown version.
    """
    contract = checked(contract)
    seen = cut_lineage(observed(raw_events, contract))  # distinct patterns and signatures, read several times below; the payloads are parsed once for them
    departed = seen.filter(F.col("what").startswith("p")).select(F.from_json(F.substring("what", 2, 1 << 30), _PATTERN).alias("p"), "n").select("p.*", "n")
    report = lambda df, field, change: df.select("landing_file", field.alias("field_name"), F.lit(change).alias("change"), "n")

    kinds = contract.select(F.col("domain_name").alias("domain"), F.col("payload_version").alias("version"), F.col("field_name").alias("missing_name"), F.col("json_type").alias("missing_kind"))
    file_pattern = ["landing_file", "domain", "version", "ref_differs", "missing", "extra", "retyped"]
    open_ = departed.filter("known and (size(missing) > 0 or size(extra) > 0)").withColumn("pattern", F.xxhash64(F.to_json(F.struct(*file_pattern))))
    pairs = (
        open_.filter("size(missing) > 0 and size(extra) > 0")
        .select("pattern", "domain", "version", "extra", F.explode("missing").alias("missing_name"))
        .select("pattern", "domain", "version", "missing_name", F.explode("extra").alias("e"))
        .filter("not e.elsewhere")
        .join(kinds, ["domain", "version", "missing_name"])
        .filter("e.kind = missing_kind")
    )
    plain = F.lower(F.regexp_replace("e.name", "[^A-Za-z]", ""))
    words = F.filter(F.split("missing_name", "_"), lambda w: F.length(w) >= 3)
    similar = F.exists(words, lambda w: F.contains(plain, w))
    part = lambda i: F.split_part(F.col("what"), F.lit(_MARK), F.lit(i))
    sigs = seen.filter(F.col("what").startswith("s")).select(part(2).alias("domain"), part(3).alias("missing_name"), part(4).alias("sig"), F.lit(1).alias("seen"))
    scored = pairs.withColumn("sig", F.col("e.sig")).join(sigs, ["domain", "missing_name", "sig"], "left")
    scored = scored.withColumn("score", 2 * F.coalesce("seen", F.lit(0)) + similar.cast("int")).filter("score > 0")
    # mutual first choice: best extra of each missing name and best missing name of each extra
    choice = F.struct((-F.col("score")).alias("s"), F.col("missing_name").alias("m"), F.col("e.name").alias("x"))
    matched = (
        scored.select("pattern", choice.alias("c"))
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_set("c")).alias("cs"))
        # pairs of one record, at most its missing times its extra fields; taken in order unless a side is used
        .select(
            "pattern",
            F.aggregate(
                "cs",
                F.array().cast("array<struct<m:string,x:string>>"),
                lambda got, c: F.when(F.exists(got, lambda g: (g["m"] == c["m"]) | (g["x"] == c["x"])), got).otherwise(F.concat(got, F.array(F.struct(c["m"].alias("m"), c["x"].alias("x"))))),
            ).alias("renames"),
        )
    )
    none = F.array().cast("array<struct<m:string,x:string>>")
    settled = open_.join(matched, "pattern", "left").withColumn("renames", F.coalesce("renames", none))
    per_field = settled.select(
        "landing_file",
        "n",
        F.explode(
            F.concat(
                F.transform("renames", lambda r: F.struct(r["m"].alias("field_name"), F.lit("renamed").alias("change"))),
                F.transform(F.array_except("missing", F.transform("renames", lambda r: r["m"])), lambda m: F.struct(m.alias("field_name"), F.lit("removed").alias("change"))),
                F.transform(F.array_except(F.transform("extra", lambda e: e["name"]), F.transform("renames", lambda r: r["x"])), lambda x: F.struct(x.alias("field_name"), F.lit("added").alias("change"))),
            )
        ).alias("c"),
    ).select("landing_file", "c.field_name", "c.change", "n")
    found = (
        per_field.unionByName(report(departed.select("landing_file", "n", F.explode("retyped").alias("name")), F.col("name"), "retyped"))
        .unionByName(report(departed.filter("not known"), F.lit("payload_version"), "unknown_version"))
        .unionByName(report(departed.filter("ref_differs"), F.lit("schema_ref"), "ref_mismatch"))
    )
    return found.groupBy("landing_file", "field_name", "change").agg(F.sum("n").alias("n_records"))


SQL_TYPES = {"string": "string", "number": "double", "boolean": "boolean"}


def contract_columns(contract: DataFrame) -> dict[str, str]:
    """Every field of the contract with its type; a field listed under several types is a string."""
    rows = contract.groupBy("field_name").agg(F.collect_set("json_type").alias("kinds")).limit(MAX_CONTRACT_ROWS + 1).collect()
    if len(rows) > MAX_CONTRACT_ROWS:
        raise ValueError(f"a contract of more than {MAX_CONTRACT_ROWS} fields")
    return {r.field_name: r.kinds[0] if len(r.kinds) == 1 else "string" for r in sorted(rows, key=lambda r: r.field_name)}


def typed_table(raw_events: DataFrame, contract: DataFrame) -> DataFrame:
    """All payloads as one table: event keys, a typed column ``f_<name>`` per contract field, failed_casts.

    A value that can't be cast is null and its name stands in failed_casts; a payload
    that isn't a JSON object has nulls only and is_object false.
    """
    columns = contract_columns(contract)
    rows = once(raw_events.select("event_id", "tenant_id", "event_type", "payload_version", "landing_file", "payload"), _p=object_map("payload", "variant"))
    value = {n: F.try_variant_get(F.element_at("_p", n), "$", SQL_TYPES[k]) for n, k in columns.items()}
    there = lambda n: F.element_at("_p", n).isNotNull() & ~F.is_variant_null(F.element_at("_p", n))
    failed = F.array_compact(F.array(*[F.when(there(n) & v.isNull(), F.lit(n)) for n, v in value.items()]))
    return rows.select(
        "event_id", "tenant_id", "event_type", "payload_version", "landing_file", F.col("_p").isNotNull().alias("is_object"), *[v.alias(f"f_{n}") for n, v in value.items()], failed.alias("failed_casts")
    )
