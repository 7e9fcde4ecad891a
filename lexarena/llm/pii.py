"""Personal data by weak supervision: base spans, and further spans that a classifier finds from voting labelers.

The base spans (emails, IP addresses, card and phone numbers) are exact matches of fixed patterns with
their checks. Wider generators propose further candidates: obfuscated mail, IPv6, cards of 13 to 15 digits
or with odd separators, phone numbers without a plus, and secrets (long runs of letters and digits, and
values after a password cue). Labelers vote on every candidate, base ones included: the pattern's form, a
loose form, a gazetteer, the words before it, and a check of the value. Votes are counted by pattern
over all documents, a table that can't outgrow the possible votes, and expectation-maximisation on it
estimates each labeler's reliability without labels (Dawid and Skene, 1979). Its posteriors train a
logistic classifier of each kind, which reads no votes but features of the span itself (length, entropy,
digits, case, quotes, assignment, distance of a cue, neighbours), so it also judges spans on which the
labelers are silent or at odds. It decides which candidates become spans.

Every scan is linear in the text: runs are found once, and no pattern starts inside a run that has failed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarena.llm.common import save

KINDS = ("email", "ip", "card", "phone", "secret")
N_BASE = 4
# Fixed: the base patterns. An email is found from its "@"; in the others a run of digits is entered at its head only.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AT = re.compile(r"\s?(?:[\[({]\s?at\s?[\])}]|\sat\s)\s?([A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[({]\s?dot\s?[\])}]|\sdot\s)\s?[A-Za-z0-9-]{2,63}(?![A-Za-z0-9-]))+)", re.I)
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
CARD_LIKE = re.compile(r"(?<![0-9.])[0-9](?:[\x20./_-]?[0-9]){12,18}+(?![0-9])")
PHONE_LIKE = re.compile(r"(?<![0-9+.])(?:00[1-9][0-9]|\(0?[0-9]{2,4}\)|[0-9]{3}[-.])[\x20()./0-9-]{4,15}[0-9](?![0-9])")
RUN = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=-]{16,}+")
VALUE = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api[_ -]?key)\b\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,}+)")
# Fixed: common top-level domains, card issuer prefixes, calling codes and marks of credentials.
TLDS = frozenset("com org net edu gov io info biz de fr es it nl br uk us eu co".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "22")
CODES = ("1", "7", "20", "27", "30", "31", "33", "34", "39", "44", "49", "55", "61", "81", "86", "91")
CREDENTIALS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_", "sk-", "pk_", "rk_", "xoxb-", "xoxp-", "AIza", "eyJ", "ya29")
CUES = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write to", re.I),
    "ip": re.compile(r"\bip\b|\bipv6\b|host|server|address|adresse", re.I),
    "card": re.compile(r"card|visa|amex|karte|tarjeta|carte|credit", re.I),
    "phone": re.compile(r"phone|\btel|call|mobil|fax|telefon|tél", re.I),
    "secret": re.compile(r"token|secret|passw|passphrase|\bpwd|api.?key|\bkey|credential|auth|bearer", re.I),
}
LABELERS = ("strict", "loose", "gazetteer", "context", "form")
CONTEXT = 40
ACCEPT = 0.9
#: Buckets of each feature: length, entropy, digits, case, quotes, assignment, cue, neighbours.
FEATURES = (6, 6, 5, 4, 2, 2, 3, 2)
WIDE = max(FEATURES)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`."""
    low, at = 0, text.find("@")
    while at >= 0:
        run = text[low:at]
        start = low + len(run.rstrip(LOCAL))
        low = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for k, pattern, low, high in ((2, CARD, 16, 19), (3, PHONE, 8, 15)):
        for m in pattern.finditer(text):
            if len(m[0]) >= low:
                digits = re.sub("[^0-9]", "", m[0])
                if low <= len(digits) <= high and (k == 3 or luhn(digits)):
                    out.append((k, m.start(), m.end()))
    return out


def entropy(found: str) -> float:
    """Bits a character."""
    n = len(found)
    return -sum(c / n * math.log2(c / n) for c in Counter(found).values())


def _votes(kind: str, text: str, start: int, end: int, strict: bool) -> str:
    """A character for each labeler: + for, - against, 0 no opinion."""
    found = text[start:end]
    digits = re.sub("[^0-9]", "", found)
    before = text[max(0, start - CONTEXT) : start]
    sign = lambda yes, no=False: "+" if yes else "-" if no else "0"
    cue = sign(CUES[kind].search(before))
    if kind == "email":
        last = re.split(r"[.\s\])}]", found)[-1].lower()
        loose, listed, form = sign(re.search(r"[@\[({]", found), " at " in found.lower()), sign(last in TLDS, len(last) > 6), sign(re.search(r"[A-Za-z]{2}$", found), len(found) > 254)
    elif kind == "ip":
        groups = found.split(":") if ":" in found else found.split(".")
        loose = sign(len(groups) in (4, 8) or "::" in found, len(groups) < 4)
        listed, form = sign(False, found.startswith(("0.", "255.255"))), sign(strict or len(groups) == 8, all(g.isdigit() for g in groups) and not strict)
    elif kind == "card":
        loose, listed = sign(re.fullmatch(r"[0-9]{4}(?:.?[0-9]{4}){3}|3[47][0-9]{2}.?[0-9]{6}.?[0-9]{5}", found)), sign(digits.startswith(ISSUERS), not digits.startswith(ISSUERS))
        form = sign(luhn(digits), not luhn(digits))
    elif kind == "phone":
        plain = digits.removeprefix("00")
        loose, listed = sign(re.search(r"[()]|^[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}$", found)), sign(strict and plain.startswith(CODES))
        form = sign(8 <= len(digits) <= 15 and len(re.findall("[0-9]+", found)) <= 5, not 8 <= len(digits) <= 15)
    else:
        hexes = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", found)
        strict, loose = bool(hexes and len(found) in (32, 40, 48, 64, 128)) or found.startswith(CREDENTIALS), sign(re.search(r"[:=]\s*[\"']?$", before), re.search(r"[/\\]$|https?:\S*$", before))
        listed, form = sign(found.startswith(CREDENTIALS) or hexes, re.fullmatch(r"[A-Za-z]+[-_/][A-Za-z]+.*|.*(?:example|test|sample).*", found, re.I)), sign(entropy(found) >= 3.2, entropy(found) < 2.5)
    return sign(strict) + loose + listed + cue + form  # a pattern that isn't met is no vote against: other forms are as good


def _features(kind: str, text: str, start: int, end: int) -> list[int]:
    """The span's features, each as the number of its bucket."""
    found = text[start:end]
    n, before = len(found), text[max(0, start - CONTEXT) : start]
    digits = sum(c.isdigit() for c in found)
    lower, upper = found.lower() != found, found.upper() != found
    cue = None
    for cue in CUES[kind].finditer(before):
        pass
    near = 0 if cue is None else 2 if len(before) - cue.end() <= 8 else 1
    left, right = text[start - 1 : start], text[end : end + 1]
    return [
        min(5, n // 8), min(5, int(entropy(found))), min(4, 5 * digits // n), 2 * lower + upper, int(left in ("'", '"') and left == right != ""),
        int(re.search(r"[:=]\s*[\"']?$", before) is not None), near, int(left.isalnum() or right.isalnum()),
    ]


def _wider(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind's index, start, end) of the wider generators' candidates."""
    if re.search("at", text, re.I):
        low = 0
        for m in AT.finditer(text):
            start = low + len(text[low : m.start()].rstrip(LOCAL))
            low = m.end()
            marked = not re.search(r"\sat\s", m[0], re.I) or re.search(r"\sdot\s|[\[({]\s?dot", m[0], re.I)
            if start < m.start() and marked:
                yield 0, start, m.end()
    if re.search("[0-9]", text):
        yield from ((1, m.start(), m.end()) for m in IPV6.finditer(text) if re.search("[0-9]", m[0]))
        yield from ((2, m.start(), m.end()) for m in CARD_LIKE.finditer(text))
        yield from ((3, m.start(), m.end()) for m in PHONE_LIKE.finditer(text))
        yield from ((4, m.start(), m.end()) for m in RUN.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))
    if ":" in text or "=" in text:
        yield from ((4, m.start(1), m.end(1)) for m in VALUE.finditer(text))


def candidates(text: str) -> list[tuple[int, int, int, str, list[int], bool]]:
    """(kind's index, start, end, votes, features, base) of base spans, and of wider candidates that overlap no base span.

    Of candidates of one kind that overlap, whatever generator they come from, the one that starts first counts, or else the longer.
    """
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    found = [(k, a, b, True) for k, a, b in base]
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    starts = [a for a, _ in taken]
    last = [-1] * len(KINDS)
    for k, a, b in sorted(_wider(text), key=lambda c: (c[0], c[1], -c[2])):
        i = bisect_left(starts, b)
        if a >= last[k] and not (i and reach[i - 1] > a):
            found.append((k, a, b, False))
            last[k] = b
    return [(k, a, b, _votes(KINDS[k], text, a, b, strict), _features(KINDS[k], text, a, b), strict) for k, a, b, strict in found]


def estimate(counts: dict[str, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """(chance of a + or -, given a span; the same given none; posterior of each vote pattern) by EM over pattern counts.

    Rows: labelers; columns: +, -, 0. Chances are those of a + or - among a labeler's votes, so that a
    labeler which is silent on a form says nothing about it; 0 has the factor 1. It starts from the
    majority of the votes, and each chance gets half a count more.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    code = np.array([["+-0".index(c) for c in p] for p in patterns])
    post = np.clip(0.5 + np.array([p.count("+") - p.count("-") for p in patterns]) / 4, 0.05, 0.95)
    for _ in range(rounds):
        chance = []
        for w in (post * n, (1 - post) * n):
            table = np.full((code.shape[1], 3), 0.5)
            for j in range(code.shape[1]):
                np.add.at(table[j], code[:, j], w)
            table /= table[:, :2].sum(1, keepdims=True)
            table[:, 2] = 1  # no vote, no evidence
            chance.append(table)
        prior = ((post * n).sum() + 0.5) / (n.sum() + 1)
        logs = [np.log(c[np.arange(code.shape[1]), code]).sum(1) for c in chance]
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0] + np.log((1 - prior) / prior), -30, 30)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return chance[0], chance[1], dict(zip(patterns, post.tolist(), strict=True))


def classify(features: np.ndarray, n: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """(intercept, weight of each feature's bucket) of a span classifier: ridge logistic regression, targets the posteriors.

    features has a row for each pattern (bucket numbers), n its count. A few candidates weigh as one each at
    most, so the ridge holds what has hardly been seen near the intercept.
    """
    x = np.zeros((len(features), 1 + len(FEATURES) * WIDE))
    x[:, 0] = 1
    for j in range(len(FEATURES)):
        x[np.arange(len(features)), 1 + j * WIDE + features[:, j]] = 1
    weight, ridge = 200 * n / max(n.sum(), 200), np.append(1e-3, np.full(x.shape[1] - 1, 0.1))
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(ridge), x.T @ (weight * (target - p)) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), beta[1:].reshape(len(FEATURES), WIDE)


def trained(rows: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """A classifier for each kind that has candidates in rows (found), trained on all of them.

    What comes to the driver is counts of vote patterns, at most 3 ** 5 a kind, and for each combination of
    feature buckets, of which a kind has 34,560, the candidates and the sum of their posteriors.
    """
    seen = rows.select(F.explode("found").alias("c")).select("c.k", "c.votes", "c.x")
    votes = seen.groupBy("k", "votes").agg(F.count("*").alias("n")).collect()
    chance = []
    for k in {r["k"] for r in votes}:
        _, _, posterior = estimate({r["votes"]: r["n"] for r in votes if r["k"] == k})
        chance += [(k, v, p) for v, p in posterior.items()]
    if not chance:
        return {}
    posteriors = rows.sparkSession.createDataFrame(chance, "k int, votes string, p double")
    shown = seen.groupBy("k", "votes", "x").agg(F.count("*").alias("n")).join(F.broadcast(posteriors), ["k", "votes"])
    shown = shown.groupBy("k", "x").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("s")).orderBy("k", "x").collect()
    out = {}
    for k in {r["k"] for r in shown}:
        mine = [r for r in shown if r["k"] == k]
        n = np.array([r["n"] for r in mine], float)
        out[k] = classify(np.array([list(r["x"]) for r in mine]), n, np.array([r["s"] for r in mine]) / n)
    return out


def find(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, base and spans (strings), n_secret, n_spans, found (array of kind, start, end, base).

    Positions are code points, end exclusive; spans are kind:start:end by kind (email, ip, card, phone,
    secret), then start, joined by commas. Base spans always stay; another candidate becomes a span if the
    classifier gives it at least `accept`. n_secret counts spans of that kind, n_spans all spans. Null texts
    are empty; a text of any length is scanned once. Rows that repeat a doc_id are documents each, and
    each counts in the estimates. A null doc_id stays null, an empty table gives an empty one, and extra
    columns are not read.
    """
    found_type = "array<struct<k:int,start:int,end:int,votes:string,x:array<int>,base:boolean>>"
    schema = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found {found_type}"
    kind = pa.list_(pa.struct([("k", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.string()), ("x", pa.list_(pa.int32())), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            counts, base, spans = [], [], []
            for text in batch.column(1):
                found = candidates(text.as_py() or "")
                base.append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _, _, strict in found if strict))
                counts.append([sum(1 for c in found if c[5] and c[0] == k) for k in range(N_BASE)])
                spans.append([dict(zip(("k", "start", "end", "votes", "x", "base"), c, strict=True)) for c in found])
            sums = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            cells = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(N_BASE)), pa.array(sums, pa.string()), pa.array(base, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", *(f"n_{k}" for k in KINDS[:N_BASE]), "base_sha256", "base", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = save(rows.mapInArrow(run, schema), "pii-candidates")
    models = trained(rows)
    flat = F.array(*(F.lit(float(w)) for k in range(len(KINDS)) for w in (models[k][1].ravel() if k in models else np.zeros(len(FEATURES) * WIDE))))
    start = F.array(*(F.lit(models[k][0] if k in models else -30.0) for k in range(len(KINDS))))
    score = lambda c: sum((F.get(flat, c["k"] * (len(FEATURES) * WIDE) + j * WIDE + F.get(c["x"], F.lit(j))) for j in range(len(FEATURES))), F.get(start, c["k"]))
    kept = F.filter("found", lambda c: c["base"] | (score(c) >= math.log(accept / (1 - accept))))
    named = F.array(*(F.lit(k) for k in KINDS))
    order = F.array_sort(F.transform(kept, lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))
    found = F.transform(order, lambda c: F.struct(F.get(named, c["k"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    out = rows.withColumn("found", found)
    text = F.array_join(F.transform("found", lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    n_secret = F.size(F.filter("found", lambda c: c["kind"] == "secret")).cast("long")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:N_BASE]), "base_sha256", "base", text.alias("spans"), n_secret.alias("n_secret"), F.size("found").cast("long").alias("n_spans"), "found")
