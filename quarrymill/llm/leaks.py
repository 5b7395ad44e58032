"""Evaluation texts leaking into training text: SimHash of windows, multi-index Hamming blocks, exact verification.

Words are unbroken runs of ASCII letters and digits in lower case. Every window of ``window`` consecutive words of an item's
part (prompt or solution) and of a document has a 64-bit SimHash of its words. The bits are cut into radius + 1 blocks; two
fingerprints within the radius agree in at least one block, so looking up each block in an index of the
items' windows finds every pair within the radius. A pair is verified by the exact weighted Jaccard similarity of the windows' shingles
(five words; a shingle weighs the more, the fewer of all items hold it) and, for passages, by equality word by word.
Windows are sized to the item where a part of it is shorter than the usual window: then the whole part is one window.

Equal windows have equal fingerprints, so passages need no more. Windows that are merely alike are mostly further apart than the radius
(one other word at a window's end moves about five bits), so where these are wanted too, every pair of windows with the similarity asked for
is found by its shingles: of a document's window so much weight must be known to the index, and a pair must share one of its rarest shingles
whose weight the rest cannot spare. Items that the fingerprints found already are left out there.

Items are indexed in blocks of bounded text size, each sent to the tasks as one broadcast index; documents are read
once per block and never shuffled before their findings are. Of several blocks one at a time is held: its findings are stored and it is given up before
the next. Texts are handled as one byte buffer per batch, in slices.

Defined results: null and empty texts hold no words and give nothing; a part of fewer than five words is never found, and one shorter than the
window is found as a whole but is no passage;
texts of any length are handled whole; repeated documents are reported under their doc_id once; repeated items are
reported under each item_id; an empty table on either side gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import write_once

WINDOW = 25
RADIUS = 3
SHINGLE = 5
SIMILARITY = 0.8
#: Text of the items in one index; an index takes about 40 bytes for each of its windows.
BLOCK_CHARS = 8 << 20
SLICE_BYTES = 2 << 20
TABLE_BITS = 20

_PRIME = 0x9E3779B97F4A7C15 | 1
_LUT = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum():
        _LUT[_c] = ord(chr(_c).lower())


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_PRIME, -1, 1 << 64)
    up, down = np.full(n, _PRIME, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, byte at which it starts) of texts that lie end to end; ``cuts`` are their first bytes."""
    low = _LUT[buf]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = cuts[cuts < len(buf)]
    first[cuts] = inside[cuts]
    last = np.empty_like(inside)
    last[:-1] = inside[:-1] & (~inside[1:] | first[1:])
    last[-1:] = inside[-1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    up, down = _powers(1 << max(16, int(len(buf) - 1).bit_length()) if len(buf) else 16)
    total = np.cumsum(low.astype(np.uint64) * up[: len(buf)], dtype=np.uint64)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return _mix((total[end] - before) * down[start] + (end - start + 1).astype(np.uint64)), start


def simhash(h: np.ndarray, window: int) -> np.ndarray:
    """Fingerprint of every window of words: each bit is the majority among the words' hashes."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    up = np.zeros((len(h) + 1, 64), np.uint8)  # counts wrap at 256; a window's own count does not
    np.cumsum(bits, axis=0, dtype=np.uint8, out=up[1:])
    return np.packbits((up[window:] - up[:-window]) * 2 > window, axis=1).view(np.uint64).ravel()


class Index:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, radius: int = RADIUS, holders: tuple[np.ndarray, np.ndarray, int] | None = None, usual: int | None = None):
        """``holders``: shingles with the number of items that hold each, and the number of all items; counted from these items if left out."""
        self.window, self.radius, self.holders = window, radius, holders
        self.passages = window == (usual or window)
        hashes, owner = [], []
        for number, (_, text) in enumerate(items):
            h, _ = words(np.frombuffer((text or "").encode(), np.uint8), np.zeros(1, np.int64))
            hashes.append(h)
            owner.append(np.full(len(h), number))
        self.ids = np.array([i for i, _ in items], np.int64)
        self.words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        place = np.concatenate(owner) if owner else np.empty(0, np.int64)
        prints = simhash(self.words, window)
        whole = place[: len(prints)] == place[window - 1 :] if len(prints) else np.empty(0, bool)
        self.start = np.flatnonzero(whole)
        self.owner, self.prints = place[self.start], prints[self.start]
        self.weights(place)
        self.postings(place)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:]):
            key = self._block(self.prints, a, b)
            order = np.argsort(key, kind="stable")
            # blocks of few bits have a table of first places, wider ones are searched
            places = np.searchsorted(key[order], np.arange((1 << (b - a)) + 1)) if b - a <= TABLE_BITS else None
            self.blocks.append((a, b, order, key[order], places))

    @staticmethod
    def _block(prints: np.ndarray, a: int, b: int) -> np.ndarray:
        return ((prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)

    def weights(self, place: np.ndarray) -> None:
        s = shingles(self.words)
        ok = place[: len(s)] == place[SHINGLE - 1 :] if len(s) else np.empty(0, bool)
        if self.holders:
            known, held, n = self.holders
            self.shingle = np.unique(s[ok])
            df = held[np.searchsorted(known, self.shingle)]
        else:
            pairs = np.unique(np.stack([s[ok], self.ids[place[: len(s)][ok]].astype(np.uint64)]), axis=1)
            self.shingle, df = np.unique(pairs[0], return_counts=True)
            n = len(np.unique(self.ids))
        self.weight, self.unknown = np.log(1 + (n + 1) / df), float(np.log(2 + n))

    def postings(self, place: np.ndarray) -> None:
        """The places of every shingle, the window that starts at a place (or -1), and the weight of every window's shingles."""
        s = shingles(self.words)
        ok = np.flatnonzero(place[: len(s)] == place[SHINGLE - 1 :]) if len(s) else np.empty(0, np.int64)
        number = np.searchsorted(self.shingle, s[ok])
        self.posted = ok[np.argsort(number, kind="stable")]
        self.post = np.append(0, np.cumsum(np.bincount(number, minlength=len(self.shingle)))).astype(np.int64)
        self.window_at = np.full(len(self.words), -1)
        self.window_at[self.start] = np.arange(len(self.start))
        _, self.item = np.unique(self.ids, return_inverse=True)  # an item's parts share a number
        self.heavy = np.zeros(len(self.start))
        if (k := self.window - SHINGLE + 1) > 0:
            for part in np.array_split(np.arange(len(self.start)), len(self.start) // 2048 + 1):
                x = s[self.start[part, None] + np.arange(k)]
                self.heavy[part] = (self.weigh(x) * first_of(x)).sum(axis=1)

    def weigh(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingle):
            return np.full(s.shape, self.unknown)
        at = np.minimum(np.searchsorted(self.shingle, s), len(self.shingle) - 1)
        return np.where(self.shingle[at] == s, self.weight[at], self.unknown)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the print, number of the item's window) of all pairs within the radius."""
        left, right = [], []
        for a, b, order, keys, places in self.blocks:
            key = self._block(prints, a, b)
            if places is not None:
                low, n = places[key], places[key + 1] - places[key]
            else:
                low = np.searchsorted(keys, key)
                n = np.searchsorted(keys, key, side="right") - low
            hit = np.flatnonzero(n)
            n = n[hit]
            for part in np.array_split(np.arange(len(hit)), max(1, int(n.sum()) >> 22)):
                m = n[part]
                who = np.repeat(hit[part], m)
                at = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[hit[part]], m)
                other = order[at]
                near = np.bitwise_count(prints[who] ^ self.prints[other]) <= self.radius
                left.append(who[near])
                right.append(other[near])
        if not left:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
        return both[0], both[1]


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of a run of words, or of every row of word hashes."""
    n = max(0, h.shape[-1] - SHINGLE + 1)
    out = np.zeros((*h.shape[:-1], n), np.uint64)
    for k in range(SHINGLE if n else 0):
        out = _mix(out * np.uint64(_PRIME) + h[..., k : k + n])
    return out


def first_of(s: np.ndarray) -> np.ndarray:
    """Whether a shingle is the first of its kind in its row."""
    return ~np.tril(s[:, :, None] == s[:, None, :], -1).any(axis=2)


def similarity(a: np.ndarray, b: np.ndarray, index: Index) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle sets of windows (rows of word hashes)."""
    out = np.empty(len(a))
    k = a.shape[1] - SHINGLE + 1
    if k < 1:
        return np.where((a == b).all(axis=1), 1.0, 0.0)
    for part in np.array_split(np.arange(len(a)), len(a) // 2048 + 1):
        if not len(part):
            continue
        x, y = shingles(a[part]), shingles(b[part])
        wx, wy = index.weigh(x), index.weigh(y)
        fx, fy = first_of(x), first_of(y)
        common = (wx * fx * (x[:, :, None] == y[:, None, :]).any(axis=2)).sum(axis=1)
        out[part] = common / np.maximum((wx * fx).sum(axis=1) + (wy * fy).sum(axis=1) - common, 1e-12)
    return out


def _alike(index: Index, own: np.ndarray, doc: np.ndarray, whole: np.ndarray, least: float, best: dict) -> None:
    """Adds to ``best`` the items that have a window with the least similarity to one of the words, and are not in it yet.

    ``own``: hashes of words, ``doc``: the texts they belong to, ``whole``: windows that lie within one text.
    """
    w, k, slack = index.window, index.window - SHINGLE + 1, 1e-9
    if k < 1 or not len(whole) or not len(index.start) or least <= 0:
        return
    s = shingles(own)
    at = np.minimum(np.searchsorted(index.shingle, s), len(index.shingle) - 1)
    known = index.shingle[at] == s
    # at most this much weight is known; one unknown shingle at least counts where there are any
    most = np.append(0, np.cumsum(np.where(known, index.weight[at], 0)))
    gaps = np.append(0, np.cumsum(~known))
    most, gaps = most[whole + k] - most[whole], gaps[whole + k] - gaps[whole]
    rows = whole[(gaps < k) & (most * (1 - least) >= least * index.unknown * (gaps > 0) - 1e-6)]
    numbers = len(index.item)
    ids = {int(i): int(n) for i, n in zip(index.ids, index.item)}
    for part in np.array_split(rows, len(rows) // 2048 + 1):
        x, n, sure = (a[part[:, None] + np.arange(k)] for a in (s, at, known))
        weight = np.where(sure, index.weight[n], index.unknown) * first_of(x)
        total, sure = weight.sum(axis=1), sure & (weight > 0)
        spare = np.where(sure, weight, 0).sum(axis=1) - least * total * (1 - slack)
        keep = spare >= 0
        part, n, weight, sure, total, spare = part[keep], n[keep], weight[keep], sure[keep], total[keep], spare[keep]
        if not len(part):
            continue
        places = np.where(sure, index.post[n + 1] - index.post[n], 1 << 40)
        order = np.argsort(places, axis=1, kind="stable")
        places, n, weight, sure = (np.take_along_axis(a, order, 1) for a in (places, n, weight, sure))
        weight = np.where(sure, weight, 0)
        # shingles are needed until those before them outweigh what a pair may lack
        need = sure & (np.cumsum(weight, axis=1) - weight <= spare[:, None] + slack)
        size = np.where(need, places, 0)
        for group in np.split(np.arange(len(part)), np.flatnonzero(np.diff(np.cumsum(size.sum(axis=1)) * k >> 21)) + 1):
            r, c = np.nonzero(need[group])
            r = group[r]
            m = size[r, c]
            off = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            q, r = index.posted[np.repeat(index.post[n[r, c]], m) + off], np.repeat(r, m)
            starts = q[:, None] - np.arange(k)
            window = np.where(starts >= 0, index.window_at[np.maximum(starts, 0)], -1)
            # a window that starts before its shingle's part is none of that part's
            r, q, window = np.repeat(r, k), np.repeat(q, k), window.ravel()
            ok = window >= 0
            pairs = np.unique(r[ok] * len(index.start) + window[ok])
            r, window = pairs // len(index.start), pairs % len(index.start)
            size_y = index.heavy[window]
            ok = (size_y >= least * total[r] * (1 - slack)) & (total[r] >= least * size_y * (1 - slack))
            r, window = r[ok], window[ok]
            item = index.item[index.owner[window]]
            pair = doc[part[r]] * numbers + item
            done = np.array([d * numbers + ids[i] for d, i in best], np.int64)
            new = ~np.isin(pair, done)
            r, window = r[new], window[new]
            if not len(r):
                continue
            span = np.arange(w)
            for few in np.array_split(np.arange(len(r)), len(r) // 65536 + 1):
                a, b = own[part[r[few], None] + span], index.words[index.start[window[few], None] + span]
                sim = similarity(a, b, index)
                ok = sim >= least
                owner = index.ids[index.owner[window[few]]]
                for d, i, e in zip(doc[part[r[few]]][ok].tolist(), owner[ok].tolist(), sim[ok].tolist()):
                    best[d, i] = (False, max(best.get((d, i), (False, 0.0))[1], e))


def indexes(items: list[tuple[int, str]], window: int, radius: int, holders: tuple | None = None) -> list[Index]:
    """An index of the parts with at least a window of words, and one for every length of the shorter parts."""
    by_length: dict[int, list] = {}
    for i, text in items:
        h, _ = words(np.frombuffer((text or "").encode(), np.uint8), np.zeros(1, np.int64))
        if len(h) >= min(SHINGLE, window):
            by_length.setdefault(min(len(h), window), []).append((i, text))
    return [Index(own, n, radius, holders, usual=window) for n, own in sorted(by_length.items())]


def holders_of(items: DataFrame, item: str, parts: list[str]) -> DataFrame:
    """(shingle, n): how many items hold each shingle of the items' parts."""

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, out, own = b.column(0), [], []
            for k in range(1, b.num_columns):
                for row, text in enumerate(b.column(k).to_pylist()):
                    h, _ = words(np.frombuffer((text or "").encode(), np.uint8), np.zeros(1, np.int64))
                    s = np.unique(shingles(h))
                    out.append(s)
                    own.append(np.full(len(s), row))
            if out:
                yield pa.record_batch([ids.take(pa.array(np.concatenate(own).astype(np.int64))), pa.array(np.concatenate(out).view(np.int64))], names=["item", "shingle"])

    picked = items.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item"), *(F.col(p).cast("string").alias(f"part_{k}") for k, p in enumerate(parts)))
    return picked.mapInArrow(scan, "item bigint, shingle bigint").distinct().groupBy("shingle").agg(F.count("*").alias("n"))


def _holders_in(known: DataFrame, total: int, block: list) -> tuple[np.ndarray, np.ndarray, int]:
    """Those of the shingles that a block of items holds."""
    own = [shingles(words(np.frombuffer(t.encode(), np.uint8), np.zeros(1, np.int64))[0]) for _, t in block]
    own = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
    import pandas as pd

    mine = known.sparkSession.createDataFrame(pd.DataFrame({"shingle": own.view(np.int64)}), "shingle bigint")
    got = known.join(mine, "shingle").toPandas()
    s, n = got["shingle"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(s)
    return s[order], n[order], total


def _find(index: Index, buf: np.ndarray, offsets: np.ndarray, least: float, alike: bool = True) -> list[tuple[int, int, bool, float]]:
    """(number of the text, item, whether a run is equal, best similarity) over texts that lie end to end.

    Windows that are alike but beyond the radius are looked for only if ``alike``.
    """
    h, start = words(buf, offsets[:-1])
    doc = np.searchsorted(offsets, start, side="right") - 1
    w, best = index.window, {}
    for at in range(0, max(0, len(h) - w + 1), 1 << 17):
        own = h[at : at + (1 << 17) + w - 1]
        prints = simhash(own, w)
        whole = np.flatnonzero(doc[at : at + len(prints)] == doc[at + w - 1 : at + w - 1 + len(prints)])
        left, right = index.candidates(prints[whole])
        left = whole[left] + at
        span = np.arange(w)
        for part in np.array_split(np.arange(len(left)), len(left) // 65536 + 1):
            a, b = h[left[part, None] + span], index.words[index.start[right[part], None] + span]
            equal = (a == b).all(axis=1)
            sim = np.ones(len(part))
            sim[~equal] = similarity(a[~equal], b[~equal], index)
            ok = sim >= least
            item = index.ids[index.owner[right[part]]]
            for d, i, e, s in zip(doc[left[part]][ok].tolist(), item[ok].tolist(), equal[ok].tolist(), sim[ok].tolist()):
                was = best.get((d, i), (False, 0.0))
                best[d, i] = (was[0] or e and index.passages, max(was[1], s))
        if alike:
            _alike(index, own, doc[at:], whole, least, best)
    return [(d, i, e, s) for (d, i), (e, s) in best.items()]


def _scan(shared, least: float, alike: bool):
    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            text = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = text.buffers()[2]
            data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            rows, first = [], 0
            while first < len(text):  # slices of whole texts
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
                own = offsets[first : last + 1]
                for index in shared.value:
                    found = _find(index, data[own[0] : own[-1]], own - own[0], least, alike)
                    rows += [(first + d, i, e, s) for d, i, e, s in found]
                first = last
            if rows:
                d, i, e, s = zip(*rows)
                yield pa.record_batch(
                    [ids.take(pa.array(d)), pa.array(i, pa.int64()), pa.array(e, pa.bool_()), pa.array(s, pa.float64())],
                    names=["doc_id", "item_id", "passage", "similarity"],
                )

    return scan


def item_blocks(items: DataFrame, item: str, parts: list[str], block_chars: int = BLOCK_CHARS) -> Iterator[list]:
    """The items' parts in blocks of bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for row in items.select(F.col(item).cast("bigint"), *parts).toLocalIterator():
        for text in row[1:]:
            if row[0] is not None and text:
                block.append((row[0], text))
                size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    parts: tuple[str, ...] = ("prompt", "solution"),
    window: int = WINDOW,
    radius: int = RADIUS,
    least: float = SIMILARITY,
    alike: bool = True,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, passage, similarity): items of which a document holds a window, alike or equal (passage).

    All pairs with the least similarity are found, however far apart their fingerprints are; without ``alike`` all passages, but
    of the rest only those within the radius. The similarity is the best of the windows compared, not of all.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id bigint, item_id bigint, passage boolean, similarity double"
    blocks = item_blocks(items, item, list(parts), block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        shared = spark.sparkContext.broadcast(indexes(first, window, radius))
        found = read.mapInArrow(_scan(shared, least, alike), schema)
    else:
        known = write_once(holders_of(items, item, list(parts)), "holders")
        total = items.where(F.col(item).isNotNull()).select(item).distinct().count()
        stored = []
        for block in chain((first, second), blocks):
            shared = spark.sparkContext.broadcast(indexes(block, window, radius, _holders_in(known, total, block)))
            stored.append(write_once(read.mapInArrow(_scan(shared, least, alike), schema), "findings"))
            shared.destroy()
        found = reduce(DataFrame.unionByName, stored)
    return found.groupBy("doc_id", "item_id").agg(F.bool_or("passage").alias("passage"), F.max("similarity").alias("similarity"))
