"""Typed validation of JSON documents: a schema walked over VARIANT, which names the first value at fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.functions.text import let

#: Fields of an extracted decision and of the envelope around a file's decisions. '?': may be missing or null; a list in a tuple may be missing.
DECISION = {
    "numero_processo": "string", "tipo_decisao": "string?", "polo_ativo": (["string"],), "advogados_polo_ativo": (["string"],), "polo_passivo": (["string"],),
    "advogados_polo_passivo": (["string"],), "resultado": "string", "data_decisao": "date", "resumo": "string?", "tribunal": "string?",
}
ENVELOPE = {"file_name_source": "string", "extraction_timestamp": "timestamp", "decisions": [DECISION], "chunks_processed": "int", "total_decisions_found": "int"}

Spec = str | list | tuple | dict


def _leaf(kind: str, v: Column) -> Column:
    """Whether a value that is there is of a kind.

    Integers may be numbers without a fraction or strings of digits, dates and times strings in ISO form
    or, for times, numbers of seconds; strings are strings only.
    """
    name, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    number = name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind == "string":
        return name == "STRING"
    if kind == "boolean":
        return name == "BOOLEAN"
    if kind == "double":
        return number
    if kind == "int":
        return (name == "BIGINT") | (number & text.rlike(r"^[-+]?\d+(\.0*)?$")) | ((name == "STRING") & text.rlike(r"^\s*[-+]?\d+(\.0*)?\s*$"))
    if kind == "date":
        return (name == "STRING") & text.rlike(r"^\d{4}-\d\d-\d\d([T ]00:00(:00(\.0*)?)?)?$") & F.try_to_date(F.substring(text, 1, 10)).isNotNull()
    if kind == "timestamp":
        return number | ((name == "STRING") & text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$") & text.try_cast("timestamp").isNotNull())
    raise ValueError(f"unknown kind {kind!r}")


def first_fault(value: Column, spec: Spec, path: Column | None = None) -> Column:
    """'path: missing', 'path: null' or 'path: not a kind' of the first value of a VARIANT that breaks spec; null if none does.

    spec: a kind (string, boolean, double, int, date, timestamp; '?' after it: may be missing or null), a
    list of one spec, a tuple of a list that may be missing, or a dict of fields. Fields are walked in
    spec's order, list items in theirs; fields that spec doesn't have are let be. The document is '$'.
    """
    here = F.lit("$") if path is None else path

    def says(what: str) -> Column:
        return F.concat(here, F.lit(f": {what}"))

    def inside(v: Column) -> Column:
        missing = says("missing")
        void = F.schema_of_variant(v) == "VOID"
        if isinstance(spec, tuple):
            return F.when(v.isNull(), None).otherwise(first_fault(v, spec[0], here))
        if isinstance(spec, list):
            items = F.try_variant_get(v, "$", "array<variant>")
            walk = F.transform(items, lambda x, i: first_fault(x, spec[0], F.concat(here, F.lit("["), i.cast("string"), F.lit("]"))))
            first = F.get(F.filter(walk, lambda x: x.isNotNull()), F.lit(0))
            return F.when(v.isNull(), missing).when(void, says("null")).when(~F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), says("not a list")).otherwise(first)
        if isinstance(spec, dict):
            fields = [first_fault(F.try_variant_get(v, f"$.{name}", "variant"), s, F.concat(here, F.lit(f".{name}"))) for name, s in spec.items()]
            return F.when(v.isNull(), missing).when(void, says("null")).when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), says("not an object")).otherwise(F.coalesce(*fields))
        kind = spec.removesuffix("?")
        wrong = F.when(~F.coalesce(_leaf(kind, v), F.lit(False)), says(f"not a {kind}"))
        if spec.endswith("?"):
            return F.when(v.isNotNull() & ~void, wrong)
        return F.when(v.isNull(), missing).when(void, says("null")).otherwise(wrong)

    return let(value, inside)


def with_fault(documents: DataFrame, column: str, spec: Spec = ENVELOPE) -> DataFrame:
    """documents with fault: the first one of a JSON string, null if it has none; what isn't JSON has the fault '$: not JSON'."""
    parsed = F.try_parse_json(F.col(column))
    return documents.withColumn("fault", F.when(parsed.isNull(), "$: not JSON").otherwise(first_fault(parsed, spec)))


def split_typed(documents: DataFrame, column: str, spec: Spec = ENVELOPE) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with fault) of JSON strings, each a walk of its own over all of them; with_fault takes one."""
    marked = with_fault(documents, column, spec)
    return marked.where("fault IS NULL").drop("fault"), marked.where("fault IS NOT NULL")
