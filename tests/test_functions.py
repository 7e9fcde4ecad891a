import random
import re
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from lexarena.functions import hashing, text


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


NAMES = {
    "Dr. Foo Bar": "FOO BAR", "DR.  QUX": "QUX", "Doutor Doutora Baz": "BAZ", "Dr.Dr. Foo": "FOO", "Dra.Ana Maria": "ANA MARIA",
    "  DRA.  MARÍA ÇLARA  NÚÑEZ  ": "MARIA CLARA NUNEZ", "Ñunez Ôliveira": "NUNEZ OLIVEIRA", "Ana\tClara": "ANA CLARA",
    "Dr. José (OAB/SP 123)": "JOSE (OAB/SP 123)", "Maria Silva OAB/RJ12345": "MARIA SILVA OAB/RJ12345", "": "", None: "", "কা": "কা",
}


def test_lawyer_names(spark):
    assert column(spark, list(NAMES), text.normalize_lawyer_name) == list(NAMES.values())


def by_steps(name):
    s, titles = name.upper().strip(), ["DOUTORA", "DOUTOR", "DRA.", "DR.", "DRA", "DR"]
    while True:
        hit = next((t for t in titles if s.startswith(t)), None)
        if hit is None:
            break
        s = s[len(hit) :].strip()
    out = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", out).strip()


def test_lawyer_names_at_random(spark):
    rng = random.Random(1)
    parts = ["dr", "DR.", "dra", "Doutor", "DOUTORA", " ", "  ", ".", "Ana", "é", "ção", "x"]
    names = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(400)]
    assert column(spark, names, text.normalize_lawyer_name) == [by_steps(n) for n in names]


URLS = {
    "https://www.tjro.jus.br/diario20250626.pdf": "2025-06-26", "https://x.jus.br/20250626614-NR115.pdf": "2025-06-26", "https://x/a/26062025.pdf": "2025-06-26",
    "https://x/d?dt=20251340&x=2025-06-07": None, "https://x/2024/202407251014-NR100.pdf": None, "https://x/none.pdf": None,
}


def test_date_from_url(spark):
    assert [d and str(d) for d in column(spark, list(URLS), text.date_from_url)] == list(URLS.values())
    assert str(column(spark, ["https://x/2024/202407251014-NR100.pdf"], text.gazette_date_from_url)[0]) == "2024-07-25"


def test_url_parts(spark):
    assert column(spark, ["https://WWW.tjro.jus.br:80/x", "nothing"], text.is_court_url) == [False, False]
    assert column(spark, ["https://WWW.tjro.jus.br/x"], text.is_court_url) == [True]
    assert column(spark, ["https://archive.org/details/abc/x", "https://a/b"], text.identifier_from_archive_url) == ["abc", None]
    assert column(spark, ["a b/ç?.pdf", "///"], text.sanitize_filename) == ["abç.pdf", "default_filename"]
    assert column(spark, ["```json\n{}\n```", " {} "], text.strip_json_fence) == ["{}", "{}"]
    assert column(spark, ["/novodiario/2024/202407251014-NR100.pdf"], lambda u: text.absolute_url("https://x", u)) == ["https://x/novodiario/2024/202407251014-NR100.pdf"]


VECTORS = {
    "CASE_NUMBER:0001234-56.2023.8.22.0001": "d15a9242-fb63-5616-aaf8-45beb77f58d2", "PARTY_NAME:joao da silva": "8cd8354d-021e-571a-a977-b66112606ce8",
    "LAWYER_ID_NORMALIZED:JOAO ALVES DA SILVA": "74eab0bc-464f-5a5c-a8cc-c01591b47930",
}


def test_uuid5(spark):
    assert column(spark, list(VECTORS), hashing.uuid5) == list(VECTORS.values())
    names = [f"ç{i}" for i in range(50)]
    assert column(spark, names, hashing.uuid5) == [str(uuid.uuid5(hashing.DEFAULT_NAMESPACE, n)) for n in names]


@pytest.mark.parametrize("size,want", [(1048576, 1.0), (0, 0.0), (5 << 19, 2.5)])
def test_megabytes(spark, size, want):
    assert column(spark, [size], text.megabytes, "long") == [want]


def test_tolerant_json(spark):
    assert column(spark, ['{"a":"1"}', "bad", None], text.tolerant_map) == [{"a": "1"}, {}, {}]
