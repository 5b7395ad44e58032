"""Filling containers of fixed capacity with texts: best-two-fit in shards of bounded size.

Texts are measured in tokens of a public byte-level BPE and only (id, size) travels on. A text longer than the capacity is
split into full containers and one rest; nothing else is split. Sizes are dealt to shards of about ``shard_items``
rows, so no task holds more, however many texts there are; each shard leaves at most a few unfilled containers.

Within a shard, per container: fill greedily with the largest unpacked size that fits until none does; then take out
the smallest member if two unpacked ones fit its expanded gap and fill it more tightly.

Defined results: a capacity that is null or below 1 gives no rows; a null or empty text has 0 tokens and lies in a container with others (place is then where it would begin);
equal sizes are interchangeable and taken in order of the row; repeated rows are placed each; texts of any length are handled;
an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import write_once

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer divides text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_ITEMS = 20_000


@lru_cache(maxsize=2)
def _encoder_of(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(path: str = TOKENIZER):
    with open(path, "rb") as f:
        return _encoder_of(f.read())


def token_counts(df: DataFrame, item: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(item, n_tokens) of every row. The vocabulary is read where this is called and sent to the workers (below a megabyte)."""
    with open(path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc = _encoder_of(shared.value)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["item", "n_tokens"])

    picked = df.select(F.col(item).cast("bigint").alias("item"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(count, "item bigint, n_tokens bigint")


def pack(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Containers of item numbers; every size is from 1 to the capacity."""
    stacks: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        stacks.setdefault(sizes[i], []).append(i)
    free = 0
    for s in stacks:
        free |= 1 << s

    def largest(limit: int) -> int:
        """The largest unpacked size of at most ``limit``, or 0."""
        return (free & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and free & ((1 << (limit + 1)) - 1) else 0

    def take(s: int) -> int:
        nonlocal free
        i = stacks[s].pop()
        if not stacks[s]:
            free &= ~(1 << s)
        return i

    def put(s: int, i: int) -> None:
        nonlocal free
        stacks[s].append(i)
        free |= 1 << s

    bins = []
    while free:
        own: list[tuple[int, int]] = []
        gap = capacity
        while s := largest(gap):
            own.append((s, take(s)))
            gap -= s
        if gap and free:
            small = own[-1][0]  # sizes were taken in falling order
            room, best, a = gap + small, (small, 0, 0), largest(gap + small - 1)
            while a and 2 * a >= best[0]:
                b = largest(min(a, room - a))
                if b == a and len(stacks[a]) < 2:
                    b = largest(min(a - 1, room - a))
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = largest(a - 1)
            if best[1]:
                s, i = own.pop()
                own += [(x, take(x)) for x in best[1:]]
                put(s, i)
        bins.append([i for _, i in own])
    return bins


PLACED = (
    "capacity_tokens bigint, container bigint, item bigint, part_no int, first_token bigint, n_tokens bigint, place bigint"
)


def _pack_shard(key, table):
    import pyarrow as pa

    shard, capacity = (k.as_py() for k in key)
    order = table.sort_by([("row", "ascending")])
    items, sizes = order.column("item").to_pylist(), order.column("n_tokens").to_pylist()
    out, bins, rest = [], 0, []
    first = shard << 32
    for k, n in enumerate(sizes):
        for part in range(n // capacity):
            out.append((capacity, first + bins, items[k], part, part * capacity, capacity, 0))
            bins += 1
        if n % capacity:
            rest.append((n % capacity, k))
    for members in pack([n for n, _ in rest], capacity):
        place = 0
        for m in members:
            n, k = rest[m]
            out.append((capacity, first + bins, items[k], sizes[k] // capacity, sizes[k] - n, n, place))
            place += n
        bins += 1
    last = max(bins - 1, 0)
    end = sum(r[5] for r in out if r[1] == first + last)
    out += [(capacity, first + last, items[k], 0, 0, 0, end) for k, n in enumerate(sizes) if n == 0]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in PLACED.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def place_all(counts: DataFrame, capacities: Sequence[int], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The container and place of every part of every item, for each capacity; capacities below 1 and null ones hold nothing."""
    capacities = [c for c in capacities if c is not None and c > 0]
    if not capacities:
        return counts.sparkSession.createDataFrame([], PLACED)
    stored = write_once(counts, "sizes")
    shards = max(1, -(-stored.count() // shard_items))
    numbered = stored.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("item", "row"), F.lit(shards)).cast("bigint")).withColumn(
        "capacity", F.explode(F.array(*(F.lit(int(c)).cast("bigint") for c in sorted(set(capacities)))))
    )
    return dealt.groupBy("shard", "capacity").applyInArrow(_pack_shard, PLACED)


def use(placed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, unused share, and parts."""
    return placed.groupBy("capacity_tokens").agg(
        F.countDistinct("container").alias("containers"),
        F.sum("n_tokens").alias("tokens"),
        F.count("*").alias("parts"),
        (1 - F.sum("n_tokens") / (F.countDistinct("container") * F.first("capacity_tokens"))).alias("unused_share"),
    )


def invariants(placed: DataFrame, counts: DataFrame) -> DataFrame:
    """Per capacity: texts placed, and how often a rule of packing is broken: containers that hold too much, texts whose tokens are not all
    placed exactly once, texts split without need or into more parts than necessary, parts that overlap in their container; and whether at most
    2 % (and a container for every shard) more containers are used than the tokens need at least."""
    part = placed.groupBy("capacity_tokens", "container").agg(F.sum("n_tokens").alias("filled"), F.max(F.col("place") + F.col("n_tokens")).alias("end"))
    boxes = part.groupBy("capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.count_if(F.col("filled") > F.col("capacity_tokens")).alias("overfull"),
        F.count_if(F.col("filled") != F.col("end")).alias("overlapping"),
        F.sum("filled").alias("tokens"),
    )
    # parts of a text are told apart by their first token: these must follow each other without a gap
    texts = placed.groupBy("capacity_tokens", "item").agg(
        F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"), F.count("*").alias("parts"), F.countDistinct("part_no").alias("numbers")
    )
    own = counts.groupBy("item").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("rows"))
    least = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity_tokens")))
    one = F.col("rows") == 1
    whole = own.join(texts, "item", "left").groupBy("capacity_tokens").agg(
        F.sum("rows").alias("texts"),
        F.count_if((F.col("n") != F.col("size")) | one & ((F.col("upto") != F.col("size")) | (F.col("parts") != F.col("numbers")))).alias("incomplete"),
        F.count_if(one & (F.col("parts") != least)).alias("split_wrongly"),
    )
    room = F.ceil(F.col("tokens") / F.col("capacity_tokens"))
    shards = F.ceil(F.col("texts") / SHARD_ITEMS)
    return whole.join(boxes, "capacity_tokens").select(
        "capacity_tokens", "texts", "overfull", "overlapping", "incomplete", "split_wrongly", (F.col("containers") <= F.ceil(room * 1.02) + 2 * shards).alias("tight")
    )
