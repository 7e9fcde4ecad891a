"""The prefix trie, conversation repair and packing against plain-Python versions, with nulls, ties and empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexarena.llm import packing, repair, trie
from lexarena.llm.queries import QUERIES, vocabulary_file
from tests.oracle import rows

DATA = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


def table_of(spark, data):
    return spark.createDataFrame(data, CONV).withColumns({"depth": F.lit("clash"), "pos": F.lit("clash"), "hash": F.lit("clash"), "fault": F.lit(1), "chars": F.lit("c"), "n_convs": F.lit("c")})


def sha(s):
    return hashlib.sha256((s if isinstance(s, bytes) else s.encode())).hexdigest()


def in_order(data, fill):
    """Rows of each conversation by turn, null first, then by hash."""
    convs = defaultdict(list)
    for c, t, role, text in data:
        role, text = (fill if x is None else x for x in (role, text))
        convs[c].append((t is not None, t or 0, sha(f"{len(role)}:{role}{text}"), t, role, text))
    return {c: [r[3:] for r in sorted(v, key=lambda r: r[:3])] for c, v in convs.items()}


# ---- prefix trie


def trie_by_hand(data):
    own = {c: [r[1:] for r in v] for c, v in in_order([r for r in data if r[0] is not None], "").items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(path))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, sha(ends)))
    return out


def random_conversations(rng, convs, turns):
    data = []
    for c in convs:
        for t in range(rng.randint(0, turns)):
            data.append((c, rng.choice([None, t, t, t, 2]), rng.choice([None, "", "user", "assistant", "system"]), rng.choice([None, "", "a", "b. ", "é!"])))
    return data + data[::7]


@pytest.mark.parametrize("seed", range(2))
def test_trie_equals_brute_force_with_nulls_ties_and_repeats(spark, seed):
    rng = random.Random(seed)
    data = random_conversations(rng, [*range(20), *range(195, 215), 300, 7001], 9)
    data += [(c, t, "user", "same") for c in (400, 401, 402, 450) for t in range(8)] + [(None, 1, "user", "x"), (500, None, None, None)]
    assert {tuple(r) for r in trie.trie_of(table_of(spark, data)).collect()} == trie_by_hand(data)


def test_trie_of_conversations_longer_than_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE", 2)
    rng = random.Random(5)
    stem = [("user", rng.choice("ab")) for _ in range(17)]
    data = [(c, t, *x) for c in range(1000, 1900, 100) for t, x in enumerate(stem[: rng.choice([4, 8, 12, 16, 17])] + [("assistant", "z")] * rng.randint(0, 5))]
    data += [(c, t, *x) for c in (3000, 3100, 3200, 3300, 3400) for t, x in enumerate(stem[:8])]
    assert {tuple(r) for r in trie.trie_of(table_of(spark, data)).collect()} == trie_by_hand(data)


def test_trie_of_a_conversation_over_many_tasks(spark):
    data = [(c, t, "user", str(t % 7)) for c in (100, 200) for t in range(1500)] + [(200, 1500, "assistant", "end")]
    got = trie.trie_of(table_of(spark, data)).collect()
    assert len(got) == 1502
    top = next(r for r in got if r.depth == 0)
    assert (top.n_convs, top.n_leaves, top.saved_tokens) == (2, 1, 1500)
    assert {(r.depth, r.n_convs, r.saved_tokens) for r in got if r.depth > 1498} == {(1499, 2, 2), (1500, 2, 1), (1501, 1, 0)}
    assert next(r.ends_sha256 for r in got if r.depth == 1500) == sha("100")


def test_trie_of_no_conversation(spark):
    assert trie.trie_of(spark.createDataFrame([], CONV)).collect() == []
    assert trie.trie_of(spark.createDataFrame([(None, 1, "user", "x")], CONV)).collect() == []
    one = trie.trie_of(spark.createDataFrame([(7, None, None, None)], CONV)).collect()
    h = zlib.crc32(b"7") % 6
    assert [r.depth for r in sorted(one)] == ([0, 1] if h == 0 else [0])


def test_turn_hash_keeps_role_and_text_apart(spark):
    got = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("", "abc")], "r string, t string").select(trie.turn_hash(F.col("r"), F.col("t")).alias("h")).distinct().count()
    assert got == 3


# ---- repair


def damage_by_hand(data):
    out = []
    for c, t, role, text in data:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults_by_hand(turns):
    seen, out = set(), []
    for _, role, text in turns:
        body = text.strip(" \t\n\v\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "ok")
        seen.add((role, text))
    return out


def cheapest_by_hand(turns, faults):
    """Every sequence of edits with at most two insertions in front of each turn and at the end, one by one."""
    best = None
    ends = [(), ("user",), ("assistant",), ("user", "assistant")]
    edits = [["D"] + ([] if f in ("blank", "duplicate") else ["K", "user", "assistant"]) for f in faults]
    for inserts in product(ends, repeat=len(turns) + 1):
        for chosen in product(*edits):
            cost, audit, kept = 0, "", []
            for i in range(len(turns) + 1):
                for r in inserts[i]:
                    cost, audit = cost + 2, audit + "I"
                    kept.append((r, ""))
                if i < len(turns):
                    e, (_, role, text) = chosen[i], turns[i]
                    cost += 3 if e == "D" else (0 if e == "K" else 2) + (faults[i] == "truncated")
                    audit += e if e in "DK" else "R"
                    if e != "D":
                        kept.append((role if e == "K" else e, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
    return best


def repair_by_hand(turns):
    faults = faults_by_hand(turns)
    known = [t for t, _, _ in turns if t is not None]
    cost, audit, out = cheapest_by_hand(turns, faults)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha(out))


def test_repair_equals_every_sequence_of_edits(spark):
    rng = random.Random(3)
    data = []
    for c in range(150):
        for t in range(rng.randint(1, 4)):
            data.append((c, rng.choice([None, t, t, t + 1]), rng.choice([None, "", "user", "user", "assistant", "system", "tool", "agent"]), rng.choice([None, " \n", "Yes.", "No! ", "cut", "é?\t"])))
    data += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    want = {c: repair_by_hand(v) for c, v in in_order(data, " ").items()}
    got = {r[0]: tuple(r)[1:] for r in repair.report(table_of(spark, data)).collect()}
    assert got == want


def test_damage_and_conversations_without_rows(spark):
    rng = random.Random(4)
    data = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["A. B!", None, "x"])) for c in range(60) for t in [None, *range(rng.randint(0, 2))]]
    conversations = table_of(spark, data)
    damaged = repair.damage(conversations)
    plain = lambda some: sorted((c, -1 if t is None else t, r, x) for c, t, r, x in some)
    assert plain(tuple(r)[:4] for r in damaged.collect()) == plain(damage_by_hand(data))
    left = in_order(damage_by_hand(data), " ")
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(damaged, conversations).collect()}
    assert set(got) == {r[0] for r in data} and set(got) - set(left)
    nothing = (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got == {c: repair_by_hand(left[c]) if c in left else nothing for c in got}


def test_repaired_turns_alternate_and_a_long_conversation_passes(spark):
    data = [(1, t, "user" if t % 3 else "assistant", f"Turn {t}.") for t in range(2500)] + [(2, 0, "system", "S."), (2, 1, "tool", "x" * 300_000 + ".")]
    out = repair.repaired(table_of(spark, data)).collect()
    for c in (1, 2):
        turns = sorted((r.turn, r.role, r.text) for r in out if r.conv_id == c)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in turns)) and [t for t, _, _ in turns] == list(range(len(turns)))
    assert sorted((r.role, len(r.text), r.edit) for r in out if r.conv_id == 2) == [("assistant", 300_001, "R"), ("system", 2, "K"), ("user", 0, "I")]  # KIR is less than KRI
    assert repair.report(spark.createDataFrame([], CONV), spark.createDataFrame([], CONV)).collect() == []


def test_few_vectors_are_ever_met():
    found, rng = repair.Repairs(), random.Random(1)
    for _ in range(50):
        found.scan(bytearray(rng.choice([4 * r + f for r in range(4) for f in range(4)]) for _ in range(400)))
    assert len(found.vectors) < 60 and all(min(v) == 0 and max(v) <= 4 for v in found.vectors)


# ---- packing


def test_packed_pieces_equal_the_tokenizer_and_nothing_is_padded(spark, tmp_path):
    path = vocabulary_file("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [None, "", " \n ", "It's <|endoftext|> or <|ENDOFTEXT|>, isn't it", "H̱ ẖ É ΣΣ İ  x\ty z", "word " * 7000, "a" * 5000]
    texts += [" ".join(rng.choice(["the", "The", "court's", "No. 12,", "ÉTÉ", "été", "x"]) for _ in range(rng.randint(0, 900))) for _ in range(80)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"offset": F.lit("clash"), "seq": F.lit("clash")}).repartition(3)
    packing.pack_sequences(df, f"file://{tmp_path}/packed", path, end_id=1, window=256, group_tokens=4000)
    got = packing.read_pieces(spark, f"file://{tmp_path}/packed").toPandas()
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    for i, some in want.items():
        mine = got[got.doc_id.isna()] if i is None else got[got.doc_id == i]
        assert len(mine) and mine.length.sum() == sum(map(len, some))
        for r in mine.itertuples():
            assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in some)
        if len(some) == 1:
            mine = mine.sort_values("start")
            assert list(mine.start) == [0, *mine.length.cumsum()[:-1]]
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    used = by.length.sum()
    assert sorted(used.index) == list(range(len(used)))
    assert all(n == 256 or n < 256 and n & (n - 1) == 0 for n in used)
    assert ((by.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length) == got.sort_values(["sequence_id", "offset"]).offset).all()


def test_packing_of_no_document(spark, tmp_path):
    packing.pack_sequences(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", vocabulary_file("word_bpe_49k.json"), end_id=1)
    assert packing.read_pieces(spark, f"file://{tmp_path}/none").collect() == []


def test_tightest_window_by_brute_force():
    rng = random.Random(6)
    for window in (16, 100, 2048):
        sizes = [rng.randint(1, window) for _ in range(400)]
        pieces = [(i, 0, np.zeros(n, np.uint32), n) for i, n in enumerate(sizes)]
        room: list[int] = []
        for n in sorted(sizes, reverse=True):
            fits = [r for r in room if r >= n]
            left = min(fits) if fits else window
            if fits:
                room.remove(left)
            room.append(left - n)
        found = packing.best_fit_decreasing(pieces, window)
        assert sorted(window - sum(len(p[2]) for p in w) for w in found) == sorted(room)
        full, left = packing.fill(found, window)
        assert all(sum(len(p[2]) for p in w) == window for w in full) and sum(len(p[2]) for p in left) < window
        assert sum(len(p[2]) for w in [*full, *packing.powers(left)] for p in w) == sum(sizes)


def test_words_equal_the_tokenizer_after_the_cache_is_cleared(monkeypatch):
    monkeypatch.setattr(packing.Words, "PIECES", 3)
    monkeypatch.setattr(packing, "SLICE_BYTES", 16)
    enc = packing.Words(vocabulary_file("word_bpe_49k.json"))
    texts = ["a b c d", "e f", "", "g, h! a\nb", "  a", "Ünï <|endoftext|>x"]
    assert [list(x) for x in enc.encode(pa.array(texts))] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_query_covers_every_document(spark):
    got = QUERIES["op13_packing"](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert rows(got.groupby("doc_id", as_index=False).length.sum()[["doc_id"]]) == rows(docs.select("doc_id").toPandas())
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
