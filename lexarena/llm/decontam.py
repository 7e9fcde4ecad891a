"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared as the UTF-8 bytes of their letters and digits, in lower case. Items are cut
into overlapping parts of at most PART bytes, one every PART / 2, so a leaked fragment counts. A part of
m bytes may differ by k = floor(edit_rate * m) edits from a region of a text; such a region shares at
least m - q + 1 - k * q of the part's q-grams with it, on diagonals (text position - part position)
at most k apart. Overlapping bands of 2 * width diagonals, one every width >= k, hold them all in one band.
Counted are the part's positions whose q-gram the text has in the band. Positions are taken together in
buckets of width, in the part and in the text, so that a q-gram that both repeat costs the product of its
buckets, not of its occurrences; equal parts of many items are one part. Bands that reach the bound are
aligned: an exact search first, else an edit distance kept to their diagonals, bands side by side in one
pass. Only a slice's own hits and one block of items are in memory.

Items of fewer than q letters and digits have no q-gram; they are searched for as whole words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarena.llm.common import _LOWER, _P, mix, text_slices

Q = 9
EDIT_RATE = 0.07
PART = 128
BLOCK_BYTES = 8 << 20
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
SPREAD_BITS = 22
PAIRS = 1 << 20
RUN = 1024


def _place(i: int | None) -> tuple[bool, int]:
    return i is not None, i or 0


def normal(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, source position of each byte): letters and digits in lower case (A-Z and the Latin-1 letters)."""
    keep = _ALNUM[raw]
    at = np.flatnonzero(keep)
    out = _LOWER[raw][at]
    if len(out) > 1:
        after = np.zeros(len(out), bool)
        after[1:] = out[:-1] == 0xC3
        out[after & (out >= 0x80) & (out <= 0x9E) & (out != 0x97)] += 0x20
    count = np.concatenate(([0], np.cumsum(keep)))
    return out, count[offs], at


def grams(raw: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes from each position on."""
    n = max(0, len(raw) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h *= _P
        h += raw[j : j + n]
    return mix(h)


class Items:
    """One block of items: their distinct parts, an index of the parts' q-grams, and the short items."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, rate: float):
        self.q = q
        parts: dict[bytes, set] = {}
        short: dict[bytes, set] = {}
        for i, text in items:
            raw = np.frombuffer(text, np.uint8)
            out, _, _ = normal(raw, np.array([0, len(raw)]))
            if 0 < len(out) < q:
                short.setdefault(out.tobytes(), set()).add(i)
            for first in [*range(0, max(1, len(out) - PART), PART // 2), max(0, len(out) - PART)]:
                part = out[first : first + PART]
                if len(part) >= q:
                    parts.setdefault(part.tobytes(), set()).add(i)
        self.short = {n: {k: sorted(v, key=_place) for k, v in short.items() if len(k) == n} for n in {len(k) for k in short}}
        self.bytes, self.owners = [np.frombuffer(b, np.uint8) for b in parts], [sorted(v, key=_place) for v in parts.values()]
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.budget = np.minimum((rate * self.length).astype(np.int64), (self.length - q) // q)  # so that the bound is 1 at least
        self.least = self.length - q + 1 - self.budget * q
        self.width = 1 << max(3, int(self.budget.max(initial=1)).bit_length())
        found = [grams(b, q) for b in self.bytes]
        h = np.concatenate(found) if found else np.empty(0, np.uint64)
        part = np.repeat(np.arange(len(found)), [len(f) for f in found])
        bucket = np.concatenate([np.arange(len(f)) // self.width for f in found]) if found else np.empty(0, np.int64)
        order = np.lexsort((bucket, part, h))
        h, part, bucket = h[order], part[order], bucket[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        self.hash, self.part, self.bucket, self.n = h[at], part[at], bucket[at], np.diff(np.append(at, len(h)))
        self.seen = np.zeros(1 << SPREAD_BITS, bool)
        self.seen[self.hash >> np.uint64(64 - SPREAD_BITS)] = True

    def __bool__(self) -> bool:
        return bool(self.bytes or self.short)

    def bands(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, part, first band, last band) of the runs of bands that reach the bound, at most RUN bands each."""
        h = grams(raw, self.q)
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - SPREAD_BITS)])
        doc = np.searchsorted(offs, at, "right") - 1
        whole = at + self.q <= offs[doc + 1]
        at, doc = at[whole], doc[whole]
        if not len(at):
            return []
        h, bucket = h[at], (at - offs[doc]) // self.width
        order = np.lexsort((h, bucket, doc))
        h, bucket, doc = h[order], bucket[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
        h, bucket, doc = h[new], bucket[new], doc[new]
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        ends = np.cumsum(high - low)
        if not ends[-1]:
            return []
        n, out = high - low, []
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        total = np.append(0, ends)
        first = 0
        while first < len(starts):  # texts together with up to PAIRS pairs
            last = max(first + 1, int(np.searchsorted(total[np.append(starts, len(doc))], total[starts[first]] + PAIRS, "right")) - 1)
            x, y = starts[first], starts[last] if last < len(starts) else len(doc)
            pieces = max(1, -(-int(total[y] - total[x]) // PAIRS))  # one text with more: some of the parts at a time
            for k in range(pieces):
                of = range(k * len(self.bytes) // pieces, (k + 1) * len(self.bytes) // pieces)
                out += self._reach(bucket[x:y], doc[x:y], low[x:y], n[x:y], of)
            first = last
        return out

    def _reach(self, bucket: np.ndarray, doc: np.ndarray, low: np.ndarray, n: np.ndarray, of: range) -> list[tuple[int, int, int, int]]:
        """bands() for some texts' q-grams and the parts `of`, PAIRS pairs at a time."""
        if not len(n) or not n.sum():
            return []
        shift = int(self.length.max() // self.width) + 4
        span = int(bucket.max()) + shift + 8
        keys, ends = [], np.cumsum(n)
        for start in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(start, min(start + PAIRS, int(ends[-1])))
            row = np.searchsorted(ends, pair, "right")
            entry = low[row] + pair - (ends[row] - n[row])
            if len(of) < len(self.bytes):
                mine = (self.part[entry] >= of.start) & (self.part[entry] < of.stop)
                row, entry = row[mine], entry[mine]
            band = bucket[row] - self.bucket[entry] + shift
            key = (doc[row] * len(self.hash) + entry) * span + band
            keys.append(np.unique(np.concatenate((key, key - 1, key - 2))))  # text and part buckets meet on the diagonals of these bands
        key = np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0]
        band, rest = key % span, key // span
        entry, d = rest % len(self.hash), rest // len(self.hash)
        key, which = np.unique((d * len(self.bytes) + self.part[entry]) * span + band, return_inverse=True)
        count = np.bincount(which, self.n[entry])
        key = key[count >= self.least[key // span % len(self.bytes)]]
        if not len(key):
            return []
        cut = np.flatnonzero(np.append(True, np.diff(key) != 1))
        out = []
        for x, y in zip(cut, np.append(cut[1:], len(key)), strict=True):
            pair, b = int(key[x] // span), int(key[x] % span) - shift
            out += [(pair // len(self.bytes), pair % len(self.bytes), b + i, b + min(i + RUN, int(y - x)) - 1) for i in range(0, int(y - x), RUN)]
        return out

    def words(self, raw: np.ndarray, offs: np.ndarray, source: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first byte, last byte, 0) of the first place of each short item that has no letter or digit beside it."""
        out = []
        if not len(raw):
            return out
        joined = np.append(False, np.diff(source) == 1)  # to the byte before
        joined[offs[:-1][offs[:-1] < len(raw)]] = False
        for n, known in self.short.items():
            wanted = np.sort(np.concatenate([grams(np.frombuffer(k, np.uint8), n) for k in known]))
            h = grams(raw, n)
            at = np.flatnonzero(~joined[: len(h)])
            at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]]
            doc = np.searchsorted(offs, at, "right") - 1
            end = at + n
            whole = (end <= offs[doc + 1]) & ~np.append(joined, False)[end]
            seen = set()
            for a, d in zip(at[whole].tolist(), doc[whole].tolist(), strict=True):
                for i in known.get(raw[a : a + n].tobytes(), ()):
                    if (d, i) not in seen:
                        seen.add((d, i))
                        out.append((d, i, a - int(offs[d]), a - int(offs[d]) + n, 0))
        return out

    def matches(self, raw: np.ndarray, offs: np.ndarray, source: np.ndarray | None = None) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first byte, last byte, edits) of the regions within the budget, in normal bytes.

        The matched parts of one item in one text are one region, with the most edits of its parts.
        """
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, first, last in self.bands(raw, offs) if self.bytes else ():
            if (d, i) in best and not best[d, i][2]:
                continue
            found = self._align(raw[offs[d] : offs[d + 1]], i, first, last)
            if found and ((d, i) not in best or found[2] < best[d, i][2]):
                best[d, i] = found
        region: dict[tuple[int, int], tuple[int, int, int]] = {}
        every = [(d, i, *r) for (d, p), r in best.items() for i in self.owners[p]]
        for d, i, a, b, e in every + (self.words(raw, offs, source) if self.short else []):
            x, y, z = region.get((d, i), (a, b, e))
            region[d, i] = (min(a, x), max(b, y), max(e, z))
        return [(d, i, *r) for (d, i), r in region.items()]

    def _align(self, text: np.ndarray, i: int, band: int, to: int) -> tuple[int, int, int] | None:
        """(first, last, edits) of the best region of a part on the diagonals of bands `band` to `to`, if within the budget."""
        item, k = self.bytes[i], int(self.budget[i])
        first = max(0, band * self.width - k)
        last = min(len(text), (to + 2) * self.width + len(item) + k)
        window = text[first:last]
        exact = window.tobytes().find(item.tobytes())
        if exact >= 0:
            return first + exact, first + exact + len(item), 0
        # d[j]: least edits of item[:r] against a region that ends on diagonal j; start[j]: where it began
        low, wide = band * self.width - k, (to - band + 2) * self.width + 2 * k + 1
        diag = np.arange(wide)
        far = 1 << 28
        d = np.where((low + diag >= 0) & (low + diag <= len(text)), 0, far)
        start = low + diag
        padded = np.concatenate((text, np.zeros(1, np.uint8)))
        for r, c in enumerate(item):
            pos = low + r + diag  # text position that a match of item[r] would use
            inside = (pos >= 0) & (pos < len(text))
            same = np.where(inside, d + (padded[np.where(inside, pos, -1)] != c), far)
            drop = np.append(d[1:], far) + 1  # item[r] has no counterpart
            take = drop < same
            new, begin = np.where(take, drop, same), np.where(take, np.append(start[1:], 0), start)
            # text bytes without a counterpart: new[j] = min over i <= j of new[i] + (j - i)
            lead = new - diag
            run = np.minimum.accumulate(lead)
            source = np.maximum.accumulate(np.where(lead == run, diag, -1))
            d, start = run + diag, begin[source]
            d[(pos + 1 < 0) | (pos + 1 > len(text))] = far
            if d.min() > k:
                return None
        j = int(d.argmin())
        return int(start[j]), int(low + len(item) + j), int(d[j])


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start, end, edits: the region of each document that holds what it leaks of an item.

    start and end are byte offsets in the document's UTF-8 text; edits are those of the part that needs most.
    There is one row for a document and an item, also where several rows of the benchmark have one item_id
    (all their texts are the item) or a region is found in several parts. An item of fewer than q letters
    and digits is found as whole words, with any separators between them that it or the text has; one of
    fewer than 2 q is found without an edit only. A fragment of an item counts if it holds a whole part:
    surely from 3 / 2 PART - 1 letters and digits on (191). Null or empty texts and null items, and items
    without a letter or digit, match nothing; text and items that repeat a few q-grams cost no more than
    others; documents or items without an id keep a null id; repeated documents
    give repeated rows, an empty table none. A text of any length is read whole. Extra columns are not read.

    The items reach the tasks in blocks of about block_bytes of text, by a hash of item_id, one pass over
    docs for each block; the items of one id share a block.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for b in range(blocks):
        held = [(r.item_id, bytes(r.text)) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        found = docs.mapInArrow(_scan(spark.sparkContext.broadcast(held), q, edit_rate), "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionAll(found)
    return out


def _scan(held, q: int, edit_rate: float):
    def run(batches):
        items = Items(held.value, q, edit_rate)
        for batch in batches:
            if not items:
                continue
            rows = []
            for first, _, raw, offs in text_slices(batch.column(1)):
                out, bounds, source = normal(raw, offs)
                for d, i, a, b, edits in items.matches(out, bounds, source):
                    place = source[bounds[d] : bounds[d + 1]] - offs[d]
                    rows.append((batch.column(0)[first + d].as_py(), i, int(place[a]), int(place[min(b, len(place)) - 1]) + 1, edits))
            cells = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that leak no item, columns unchanged; a document without an id is kept."""
    return docs.join(leaks(docs, benchmark, **options).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
