"""Decision validity with reason codes, quarantine and column quality tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarena.functions.text import let


def _kind(v: Column) -> Column:
    """'null', 'string', 'list', 'dict' or 'other' for a VARIANT."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (name == "VOID"), "null").when(name == "STRING", "string")
        .when(F.startswith(name, F.lit("ARRAY")), "list").when(F.startswith(name, F.lit("OBJECT")), "dict").otherwise("other")
    )


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _falsy(v: Column, kind: Column) -> Column:
    """Null, '', [], {}, 0 or false."""
    size = F.size(F.try_variant_get(v, "$", "array<variant>"))
    empty = ((kind == "string") & (_text(v) == "")) | ((kind == "list") & (size == 0)) | ((kind == "dict") & (F.to_json(v) == "{}"))
    return (kind == "null") | empty | ((kind == "other") & _text(v).isin("0", "false", "0.0"))


def _facts(v: Column) -> Column:
    """struct(kind, text, falsy, filled) of a VARIANT; filled: a list has an item that isn't empty."""
    items = lambda x: F.try_variant_get(x, "$", "array<variant>")
    fact = lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), _falsy(x["v"], x["kind"]).alias("falsy"))
    kinds = let(v, lambda x: F.struct(x.alias("v"), _kind(x).alias("kind")))
    full = lambda x: F.coalesce(F.exists(items(x["v"]), lambda i: let(F.struct(i.alias("v"), _kind(i).alias("kind")), lambda y: ~_falsy(y["v"], y["kind"]))), F.lit(False))
    return let(let(kinds, fact), lambda x: F.struct(x["kind"].alias("kind"), _text(x["v"]).alias("text"), x["falsy"].alias("falsy"), F.when(x["kind"] == "list", full(x)).alias("filled")))


def _side(f: Column, name: str) -> Column:
    return F.when(f["falsy"], f"{name}_missing").when(~f["kind"].isin("string", "list"), f"{name}_type").when((f["kind"] == "list") & ~f["filled"], f"{name}_empty_items")


def reject_reason(record: Column) -> Column:
    """Why a raw decision (VARIANT) is invalid, or null; the first rule that fails names the reason."""

    def reason(r: Column) -> Column:
        get = lambda path: F.try_variant_get(r, path, "variant")
        parties = _facts(get("$.partes"))
        old = let(parties, lambda p: (p["kind"] == "dict") & ~p["falsy"])
        sides = let(old, lambda o: F.struct(F.when(o, get("$.partes.requerente")).otherwise(get("$.polo_ativo")).alias("a"), F.when(o, get("$.partes.requerido")).otherwise(get("$.polo_passivo")).alias("p")))
        facts = let(sides, lambda s: F.struct(_facts(get("$.numero_processo")).alias("n"), _facts(get("$.resultado")).alias("r"), _facts(s["a"]).alias("a"), _facts(s["p"]).alias("p"), _kind(r).alias("k")))
        return let(facts, lambda f: F.coalesce(
            F.when(f["k"] != "dict", "not_a_record"),
            F.when(f["n"]["falsy"], "numero_missing").when(f["n"]["kind"] != "string", "numero_type").when(~f["n"]["text"].rlike(r"(?U)\A[\d.-]{15,25}\z"), "numero_pattern"),
            _side(f["a"], "ativo"),
            _side(f["p"], "passivo"),
            F.when(f["r"]["falsy"], "resultado_missing").when(f["r"]["kind"] != "string", "resultado_type"),
        ))

    return let(record, reason)


def split_valid(records: DataFrame, column: str = "record") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reject_reason)."""
    marked = records.withColumn("reject_reason", reject_reason(F.col(column)))
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def queueable(gazettes: DataFrame) -> DataFrame:
    """Records that have a URL, a date and a court."""
    return gazettes.where("url IS NOT NULL AND data IS NOT NULL AND tribunal IS NOT NULL")


def valid_pdf(content: Column) -> Column:
    return (F.length(content) > 1000) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def quality_report(df: DataFrame, not_null: list[str] = (), unique: list[str] = (), accepted: dict[str, list] | None = None) -> DataFrame:
    """(test, column, failures) of column tests: nulls, values that occur twice, values outside a list."""
    checks = [F.count_if(F.col(c).isNull()).alias(f"not_null|{c}") for c in not_null]
    checks += [F.count_if(~F.col(c).isin(*values)).alias(f"accepted_values|{c}") for c, values in (accepted or {}).items()]
    checks += [(F.count(c) - F.count_distinct(c)).alias(f"unique|{c}") for c in unique]
    row = df.agg(*checks)
    long = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("failures")) for c in row.columns))).alias("x"))
    return long.select(F.split_part("x.k", F.lit("|"), F.lit(1)).alias("test"), F.split_part("x.k", F.lit("|"), F.lit(2)).alias("column"), "x.failures")


def broken_references(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys are left out."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
