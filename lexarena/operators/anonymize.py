"""Personal data replaced by deterministic identifiers, backed by a decode map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.functions.hashing import pii_uuid
from lexarena.functions.text import let


def is_blank(value: Column) -> Column:
    """Whether a string has nothing but white space of any kind; null for null."""
    return ~value.rlike(r"(?U)[^\s\x1C-\x1F]")


def replace_value(kind: str, value: Column, normalize: Callable[[Column], Column] | None = None) -> Column:
    """The identifier of a value; null stays null and a blank value stays as it is."""
    reference = normalize(value) if normalize else value
    return F.when(value.isNull() | is_blank(value), value).otherwise(pii_uuid(kind, reference))


def replace_list(kind: str, values: Column, normalize: Callable[[Column], Column] | None = None) -> Column:
    """Each item replaced, null items dropped."""
    return F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: replace_value(kind, x, normalize))


def replace_keys(kind: str, values: Column) -> Column:
    """The map with each key replaced; of keys that meet, the last one counts.

    Each key is replaced once; a key that comes again later is found in the sorted keys beside it.
    """
    names = F.transform(F.map_keys(values), lambda k: replace_value(kind, k))
    cells = F.zip_with(names, F.map_values(values), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    placed = F.array_sort(F.transform(names, lambda k, i: F.struct(k.alias("key"), i.alias("i"))))
    last = lambda at: F.filter(at, lambda x, i: (i + 1 == F.size(at)) | (F.get(at, i + 1)["key"] != x["key"]))
    kept = let(placed, lambda at: F.transform(F.array_sort(F.transform(last(at), lambda x: x["i"])), lambda i: i))
    return F.map_from_entries(let(F.struct(cells.alias("c"), kept.alias("k")), lambda s: F.transform(s["k"], lambda i: F.get(s["c"], i))))


def replace_json(text: Column, kinds: dict[str, str]) -> Column:
    """A JSON object with top-level string fields, and the strings of list fields, replaced.

    Fields that aren't named, and named ones that are neither a string nor a list, keep their type and
    value. Null items of a named list are dropped, other items that are no strings stay. Keys come out
    in their order in Spark's VARIANT. What isn't a JSON object is returned as it is.
    """
    kind_of = F.schema_of_variant
    text_of = lambda v: F.try_variant_get(v, "$", "string")
    named = lambda kind, v: replace_value(kind, text_of(v)).cast("variant")

    def item(kind: str, v: Column) -> Column:
        return F.when(kind_of(v) == "STRING", named(kind, v)).otherwise(v)

    def field(k: Column, v: Column) -> Column:
        out = v
        for name, kind in kinds.items():
            items = F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: x.isNotNull() & (kind_of(x) != "VOID"))
            changed = F.when(kind_of(v) == "STRING", named(kind, v)).when(F.startswith(kind_of(v), F.lit("ARRAY")), F.transform(items, lambda x: item(kind, x)).cast("variant")).otherwise(v)  # noqa: B023
            out = F.when(k == name, changed).otherwise(out)
        return out

    parsed = F.try_parse_json(text)
    fields = let(parsed, lambda v: F.when(F.startswith(kind_of(v), F.lit("OBJECT")), F.try_variant_get(v, "$", "map<string,variant>")))
    rebuilt = let(fields, lambda m: F.to_json(F.transform_values(m, field)))
    return F.coalesce(rebuilt, text)


def extend_map(known: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(map with the new values, quarantined values).

    values: pii_type, original_value, value_for_uuid_ref (null: the original), seq. A value whose
    identifier is known is left out; of new ones with one identifier the least seq counts. Blank
    originals or references go to quarantine.
    """
    ready = values.withColumn("value_for_uuid_ref", F.coalesce("value_for_uuid_ref", "original_value"))
    blank = F.coalesce(is_blank(F.col("original_value")), F.lit(True)) | is_blank(F.col("value_for_uuid_ref"))
    named = ready.where(~blank).withColumn("pii_uuid", pii_uuid(F.col("pii_type"), F.col("value_for_uuid_ref")))
    first = named.groupBy("pii_uuid").agg(*(F.min_by(c, "seq").alias(c) for c in ("original_value", "value_for_uuid_ref", "pii_type")))
    fresh = first.join(known.select("pii_uuid"), "pii_uuid", "left_anti")
    columns = ["pii_uuid", "original_value", "value_for_uuid_ref", "pii_type"]
    return known.select(*columns).unionByName(fresh.select(*columns)), ready.where(blank)


def decode(requests: DataFrame, known: DataFrame, allowed: bool, requester: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(requests with original_value and pii_type, audit rows); unknown identifiers decode to null."""
    if not allowed:
        raise PermissionError("decoding is switched off (security.allow_pii_decoding)")
    out = requests.join(known.select("pii_uuid", "original_value", "pii_type"), "pii_uuid", "left")
    audit = out.select("pii_uuid", F.col("original_value").isNotNull().alias("found"), F.lit(requester).alias("requester"), as_of.alias("requested_at"))
    return out, audit


def anonymize_metadata(metadata: Column) -> Column:
    """Creator and title replaced, other keys unchanged."""
    value = lambda k, v: F.when(k == "creator", replace_value("METADATA_CREATOR", v)).when(k == "title", replace_value("METADATA_TITLE", v)).otherwise(v)
    return F.transform_values(metadata, value)


def migrate_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("advogado_id", replace_value("LAWYER_ID_NORMALIZED", F.col("advogado_id")))


#: The personal columns of a decision: identifier kinds of the value and, for lawyers, of the normalized name beside it.
DECISION_KINDS = {"numero_processo": "CASE_NUMBER", "polo_ativo": "PARTY_NAME", "polo_passivo": "PARTY_NAME", "advogados_polo_ativo": "LAWYER_FULL_STRING", "advogados_polo_passivo": "LAWYER_FULL_STRING"}
LAWYERS = ("advogados_polo_ativo", "advogados_polo_passivo")


def migrate_decisions(decisions: DataFrame, normalize: Callable[[Column], Column], raw: str | None = None) -> DataFrame:
    """decisions with case numbers, parties and lawyers replaced, lawyers' normalized ids in *_ids, and the same fields of a raw JSON column."""
    out = decisions
    if raw:
        out = out.withColumn(raw, replace_json(F.col(raw), DECISION_KINDS))
    for c in LAWYERS:
        out = out.withColumn(f"{c}_ids", replace_list("LAWYER_ID_NORMALIZED", F.col(c), normalize))
    for c, kind in DECISION_KINDS.items():
        out = out.withColumn(c, replace_value(kind, F.col(c)) if c == "numero_processo" else replace_list(kind, F.col(c)))
    return out


def decision_values(decisions: DataFrame, normalize: Callable[[Column], Column], seq: str) -> DataFrame:
    """(pii_type, original_value, value_for_uuid_ref, seq) of every personal value of decisions, for extend_map()."""
    entry = lambda kind, ref: lambda v: F.struct(F.lit(kind).alias("pii_type"), v.alias("original_value"), ref(v).alias("value_for_uuid_ref"))
    parts = []
    for c, kind in DECISION_KINDS.items():
        items = F.array(F.col(c)) if c == "numero_processo" else F.col(c)
        items = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull() & ~is_blank(x))
        parts.append(F.transform(items, entry(kind, lambda v: v)))
        if c in LAWYERS:
            parts.append(F.transform(items, entry("LAWYER_ID_NORMALIZED", normalize)))
    return decisions.select(F.col(seq).alias("seq"), F.explode(F.concat(*parts)).alias("v")).select("v.*", "seq")


def migrate_matches(matches: DataFrame) -> DataFrame:
    out = matches.withColumn("numero_processo", replace_value("CASE_NUMBER", F.col("numero_processo")))
    for c in ("equipe_a_ids", "equipe_b_ids"):
        out = out.withColumn(c, replace_list("LAWYER_ID_NORMALIZED", F.col(c)))
    for side in "ab":
        for when in ("antes", "depois"):
            c = f"ratings_equipe_{side}_{when}"
            out = out.withColumn(c, replace_keys("LAWYER_ID_NORMALIZED", F.col(c)))
    return out
