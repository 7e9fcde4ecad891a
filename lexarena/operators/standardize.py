"""Raw extraction records to canonical decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.functions.text import first_truthy, list_length

LISTS = ("polo_ativo", "polo_passivo", "advogados_polo_ativo", "advogados_polo_passivo")
# Fixed: the aliases of each canonical field, the one that counts first in front.
ALIASES = {
    "numero_processo": ("process_number", "numero_processo"),
    "tipo_decisao": ("tipo_decisao",),
    "resultado": ("outcome", "decision", "resultado"),
    "data_decisao": ("decision_date", "data_decisao"),
    "resumo": ("resumo",),
    "polo_ativo": ("advogados_ativo", "active_party", "polo_ativo"),
    "polo_passivo": ("advogados_passivo", "passive_party", "polo_passivo"),
    "advogados_polo_ativo": ("advogados_polo_ativo",),
    "advogados_polo_passivo": ("advogados_polo_passivo",),
}


def as_list(value: Column) -> Column:
    """A VARIANT list of strings, or one string as a list; an empty list for anything else or empty."""
    many = F.try_variant_get(value, "$", "array<string>")
    one = F.nullif(F.try_variant_get(value, "$", "string"), F.lit(""))
    single = F.when(F.schema_of_variant(value) == "STRING", F.when(one.isNotNull(), F.array(one)))
    return F.coalesce(single, many, F.array().cast("array<string>"))


def standardize(record: Column, gazette_date: Column) -> Column:
    """A raw record (VARIANT) as a canonical decision struct; the date defaults to the gazette's."""
    text = lambda k: F.try_variant_get(record, f"$.{k}", "string")
    fields = []
    for name, aliases in ALIASES.items():
        if name in LISTS:
            found = [as_list(F.try_variant_get(record, f"$.{a}", "variant")) for a in aliases]
            value = F.coalesce(*(F.when(list_length(f) > 0, f) for f in found), F.array().cast("array<string>"))
        elif name == "data_decisao":
            value = F.coalesce(*(F.try_to_date(text(a)) for a in aliases), gazette_date)
        else:
            value = F.coalesce(first_truthy(*(text(a) for a in aliases)), F.lit(""))
        fields.append(value.alias(name))
    return F.struct(*fields, record.alias("raw"))


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row (source, position, record) for each decision of each extraction file; a file without decisions gives none."""
    return envelopes.select(F.col("file_name_source").alias("source"), F.posexplode("decisions").alias("position", "record"))


def gazette_decision_stats(decisions: DataFrame, key: str) -> DataFrame:
    """Per gazette: decisions, distinct case numbers that aren't empty, parties, and a map of outcomes."""
    outcomes = decisions.groupBy(key, "resultado").agg(F.count("*").alias("n"))
    outcomes = outcomes.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("resultado", "n")))).alias("outcomes"))
    parties = sum((list_length(F.col(c)) for c in LISTS[:2]), F.lit(0))
    number = F.nullif(F.col("numero_processo"), F.lit(""))
    stats = decisions.groupBy(key).agg(F.count("*").alias("decisions"), F.count_distinct(number).alias("cases"), F.sum(parties).alias("parties"))
    return stats.join(outcomes, key)


def merge_chunks(replies: DataFrame) -> DataFrame:
    """Chunk replies (doc_id, chunk, reply) merged in chunk order; a document with a reply that isn't JSON is null."""
    decisions = F.try_variant_get(F.try_parse_json(F.col("reply")), "$.decisions", "array<variant>")
    parsed = replies.withColumns({"ok": F.try_parse_json(F.col("reply")).isNotNull(), "d": F.coalesce(decisions, F.array().cast("array<variant>"))})
    whole = parsed.groupBy("doc_id").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("chunks_processed"))
    rows = parsed.select("doc_id", "chunk", F.posexplode("d").alias("position", "record"))
    rows = rows.withColumn("json", F.to_json("record"))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "position", "json"))).alias("d"))
    out = whole.join(joined, "doc_id", "left")
    found = F.coalesce(F.transform("d", lambda x: x["json"]), F.array().cast("array<string>"))
    return out.select("doc_id", F.when(F.col("ok"), found).alias("decisions"), "chunks_processed", F.when(F.col("ok"), F.size(found)).alias("total"))
