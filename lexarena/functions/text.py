"""String, date, array, map and JSON functions as Columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, even where the optimizer would copy its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _latin_fold() -> tuple[str, str]:
    """Accented Latin letters (U+00C0 to U+024F) and the base letters they decompose to."""
    pairs = []
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _latin_fold()
_TITLES = r"(?U)^\s*(?:(?:DOUTORA|DOUTOR|DRA\.|DR\.|DRA|DR)\s*)*+"


def normalize_lawyer_name(name: Column) -> Column:
    """Upper case, titles off the front until none is left, Latin accents folded, white space collapsed; null gives ''.

    Folding covers precomposed letters; combining marks after a Latin letter are dropped as well.
    """
    bare = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), _TITLES, "")
    folded = F.regexp_replace(F.translate(bare, ACCENTED, PLAIN), r"(?<=[A-Za-z])[̀-ͯ]+", "")
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def sanitize_filename(name: Column) -> Column:
    clean = F.regexp_replace(name, r"(?U)[^\w.\-]", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("default_filename"))


def url_host(url: Column) -> Column:
    """Lower-case authority of a URL (host, and port or user if given)."""
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def is_court_url(url: Column) -> Column:
    return F.coalesce(F.endswith(url_host(url), F.lit(".jus.br")), F.lit(False))


def date_from_url(url: Column) -> Column:
    """The date in a gazette's URL by four patterns; the first hit of the first pattern whose hit is a date."""
    by_name = F.regexp_extract(url, r"(?i)diario(?:jus)?(?:tj)?(\d{8})", 1)
    by_param = F.regexp_extract(url, r"(?i)(?:data=|date=|dt=)(\d{8})", 1)
    year_first = F.regexp_replace(F.regexp_substr(url, F.lit(r"\d{4}[/_-]?\d{2}[/_-]?\d{2}")), "[/_-]", "")
    day_first = F.regexp_replace(F.regexp_substr(url, F.lit(r"\d{2}[/_-]?\d{2}[/_-]?\d{4}")), "[/_-]", "")
    dates = [F.try_to_date(x, "yyyyMMdd") for x in (by_name, by_param, year_first)] + [F.try_to_date(day_first, "ddMMyyyy")]
    return F.coalesce(*dates)


def gazette_date_from_url(url: Column) -> Column:
    """The date at the start of the file name, which a year folder before it doesn't mislead."""
    return F.coalesce(F.try_to_date(F.regexp_extract(url, r"/(\d{8})\d*[^/]*$", 1), "yyyyMMdd"), date_from_url(url))


def url_metadata(url: Column) -> Column:
    """struct(year, file_date, edition) read off a gazette's URL; null where absent."""
    take = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.struct(take(r"/novodiario/(\d{4})/").alias("year"), take(r"(\d{8})").alias("file_date"), take(r"(?i)-NR(\d+)").alias("edition"))


def gazette_file_name(date: Column, suffix: Column) -> Column:
    """dj_YYYYMMDD.pdf, with _SUFFIX before the ending if there is one."""
    end = F.when(F.coalesce(suffix, F.lit("")) != "", F.concat(F.lit("_"), F.upper(suffix))).otherwise(F.lit(""))
    return F.concat(F.lit("dj_"), F.date_format(date, "yyyyMMdd"), end, F.lit(".pdf"))


def archive_identifier(court: Column, date: Column, suffix: Column) -> Column:
    """court-diario-YYYY-MM-DD, with -suffix if there is one; lower case."""
    return F.lower(F.concat_ws("-", court, F.lit("diario"), F.date_format(date, "yyyy-MM-dd"), F.nullif(suffix, F.lit(""))))


def display_name(court: Column, date: Column) -> Column:
    return F.concat_ws(" - ", F.upper(court), F.date_format(date, "yyyy-MM-dd"))


def basename(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def identifier_from_archive_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/details/([^/]+)", 1), F.lit(""))


def strip_json_fence(reply: Column) -> Column:
    """A reply without white space around it, a leading ```json line and a trailing fence."""
    return F.regexp_replace(F.regexp_replace(reply, r"^\s*(?:```json\s*)?", ""), r"\s*(?:```)?\s*$", "")


def absolute_url(base: str, url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("http")), url).otherwise(F.concat(F.lit(base), url))


def iso_date_part(value: Column) -> Column:
    return F.substring_index(value, "T", 1)


def date_from_filename(name: Column, default: Column) -> Column:
    return F.coalesce(F.try_to_date(F.regexp_extract(name, r"dj_(\d{8})", 1), "yyyyMMdd"), default)


def megabytes(size: Column) -> Column:
    return F.bround(size / F.lit(float(1 << 20)), 2)


def any_truthy(items: Column) -> Column:
    """Whether a list holds a string that isn't empty."""
    return F.exists(items, lambda x: F.coalesce(x, F.lit("")) != "")


def list_length(items: Column) -> Column:
    return F.when(items.isNull(), 0).otherwise(F.size(items))


def tolerant_map(text: Column) -> Column:
    """A JSON object as a map; an empty map for null or bad JSON."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def first_truthy(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))
