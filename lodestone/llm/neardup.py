"""Near-duplicates as a set-similarity join filtered by several global token orders.

Similarity of two token bags: the tokens both have (repetitions counted) as a share of the
larger bag. A repetition makes a token of its own, so a bag is a set. For a bag of n tokens
and a threshold t, any bag similar to it has one of the first n - ceil(t n) + 1 tokens under
*every* order of all tokens. Candidates meet on a prefix token of the first order and must
also share prefix tokens under the others and may not differ in too many bits of a bitmap of
their tokens, before the exact count. These filters run over blocks of bags in Arrow batches. Orders come from a sketch of token frequencies of fixed
size, rarest first; an order need not be exact, only the same for all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import store

#: Cells of the frequency sketch. Its size doesn't grow with the data.
CELLS = 1 << 16
#: 64-bit words of the bitmap of a bag's tokens; half as many, folded, are looked at first.
BITS = 8
#: Bags of one token that a task takes at once: those of more frequent tokens meet by pairs of blocks.
HELD = 1 << 15
#: Bags of one token up to which tokens are taken together, bags and partners looked at in one step, rows read before.
FEW, WIDE, LONG, ROWS = 32, 64, 2048, 1 << 18
#: Tokens of all bags for each task, and tokens (16 a bag at least) or rows that are signed at once.
TASK, SIGNED = 1 << 19, 1 << 17
#: Members that a task takes at once of a class when its pairs are listed: larger classes are split by salt.
BLOCK = 64


def bag(tokens: Column) -> Column:
    """Tokens numbered by repetition, as a sorted array of strings without repeats."""
    full = F.sort_array(F.filter(tokens, lambda x: x.isNotNull() & (x != "")))
    # in a sorted array the first place of a token tells its repetition, looked for only where the token before is equal;
    # the outer transform sorts only once. Places count from 1 there and from 0 here
    again = lambda s, x, i: F.when(F.get(s, i - 1) == x, (i - F.array_position(s, x) + 1).cast("string")).otherwise("0")
    number = lambda s: F.transform(s, lambda x, i: F.concat(x, F.lit("\u0001"), again(s, x, i)))
    return F.transform(F.array(full), number)[0]


def _cell(h: Column) -> Column:
    return F.pmod(h, F.lit(CELLS)).cast("int")


def _sketch(h: DataFrame) -> tuple[bytes, int]:
    """How frequent the tokens of each cell are, one byte a cell: four steps for each doubling; and how many there are."""
    counts = h.select(F.explode("h").alias("t")).groupBy(_cell(F.col("t")).alias("cell")).agg(F.count("*").alias("n"))
    level, every = bytearray(CELLS), 0
    for cell, n in counts.collect():
        level[cell] = min(127, round(4 * math.log2(1 + n)))
        every += n
    return bytes(level), every


def needed(n: Column, t: float) -> Column:
    """Common tokens that a bag of n needs at least: ceil(t n), safe from rounding."""
    return F.ceil(n * F.lit(t) - 1e-9).cast("int")


def _need(n: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(n * t - 1e-9).astype(np.int64)


def _bits(rows: int, row: np.ndarray, h: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of each row's hashed tokens, as 64-bit words."""
    held = np.zeros((rows, 64 * words), np.uint8)
    held[row, ((h >> np.uint64(17)) % np.uint64(64 * words)).astype(np.int64)] = 1
    return np.packbits(held, axis=1).view(np.uint64)


#: Odd numbers that mix hashes.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
POSTINGS = "key bigint, side tinyint, rid bigint, n int, place int, sig binary"


def _sign(level: bytes, t: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each token of a bag's prefix, with the bag's bitmaps; for a frequent token one for each block that the bag's block meets."""
    levels, held = np.frombuffer(level, np.uint8), HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            part = np.cumsum(np.maximum(whole.column("h").value_lengths().to_numpy(), 16).astype(np.int64)) // SIGNED
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
            for batch in (whole.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i):
                lists = batch.column("h")
                n = lists.value_lengths().to_numpy().astype(np.int64)
                h = lists.flatten().to_numpy().view(np.uint64)
                rid, within = batch.column("rid").to_numpy(), batch.column("within").to_numpy().view(np.uint64)
                row = np.repeat(np.arange(len(n)), n)
                first, length = np.cumsum(n) - n, n - _need(n, t) + 1
                rank = levels[(h & np.uint64(CELLS - 1)).astype(np.int64)]
                half = (h >> np.uint64(33)) & np.uint64(1)
                place = np.arange(len(h)) - first[row]
                front = place < length[row]

                def prefix(by: np.ndarray | None) -> np.ndarray:
                    """Places of the first tokens under the order: ``by``, then rarest. What is left equal is in the order of the bag."""
                    order = (row.astype(np.uint64) << np.uint64(50)) | (rank.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22))
                    order = order if by is None else order | (by << np.uint64(49))
                    return np.argsort(order, kind="stable")[front]

                at = row[front]
                sig = np.hstack([_bits(len(n), at, h[prefix(half)], 1), _bits(len(n), at, h[prefix(np.uint64(1) - half)], 1), _bits(len(n), row, h, BITS)])
                one = prefix(None)
                key, side, put = (within[at] * _M1) ^ h[one], np.zeros(len(one), np.int8), place[front]
                blocks = np.ceil(2.0 ** (rank[one] / 4) / held).astype(np.int64)
                if blocks.max(initial=1) > 1:
                    own = ((rid[at].view(np.uint64) * _M2) >> np.uint64(32)).astype(np.int64) % blocks
                    again = np.repeat(np.arange(len(one)), blocks)
                    other = np.arange(len(again)) - (np.cumsum(blocks) - blocks)[again]
                    own, many = own[again], blocks[again] > 1
                    low, high = np.minimum(own, other), np.maximum(own, other)
                    key = np.where(many, (key[again] + low.astype(np.uint64) * _M1 + np.uint64(1)) * _M2 + high.astype(np.uint64) * _M1, key[again])
                    side = np.where(low == high, 0, np.where(own == low, 1, 2)).astype(np.int8)
                    at, put = at[again], put[again]
                width = 8 * sig.shape[1]
                for i in range(0, len(at), SIGNED):
                    rows, to = at[i : i + SIGNED], slice(i, i + SIGNED)
                    ends = np.arange(0, width * (len(rows) + 1), width, dtype=np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sig[rows]))])
                    columns = [pa.array(key[to].view(np.int64)), pa.array(side[to]), pa.array(rid[rows]), pa.array(n[rows].astype(np.int32)), pa.array(put[to].astype(np.int32)), packed]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "side", "rid", "n", "place", "sig"])

    return run


class _Group:
    """Bags of some tokens; rows come sorted by token and are then by side and size too."""

    def __init__(self, batch: pa.RecordBatch, t: float):
        self.t = t
        order = np.lexsort([batch.column(c).to_numpy() for c in ("n", "side", "key")])
        self.key, self.side, self.rid, self.place, n = (batch.column(c).to_numpy()[order] for c in ("key", "side", "rid", "place", "n"))
        self.n = n.astype(np.int64)
        self.need = _need(self.n, t)
        sig = batch.column("sig")
        width = 8 * (2 + BITS)
        start = int(np.frombuffer(sig.buffers()[1], np.int32)[sig.offset])
        self.sig = np.frombuffer(sig.buffers()[2], np.uint8)[start : start + width * len(sig)].view(np.uint64).reshape(-1, 2 + BITS)[order]
        bits, words = self.sig[:, 2:], BITS // 2
        self.folded = [np.ascontiguousarray(bits[:, i] | bits[:, i + words]) for i in range(words)]

    def kept(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``i`` and ``j`` that may be similar bags."""
        n, place, sig = self.n, self.place, self.sig
        need = np.maximum(self.need[i], self.need[j])
        # at places i and j, at most the tokens from there on are common
        ok = np.minimum(n[i] - place[i], n[j] - place[j]) >= need
        ok &= (sig[i, 0] & sig[j, 0] != 0) & (sig[i, 1] & sig[j, 1] != 0)
        i, j, need = i[ok], j[ok], need[ok]
        # at least so many tokens of one bag are not in the other: bits that only one has
        a, b = sig[i, 2:], sig[j, 2:]
        ok = (n[i] - np.bitwise_count(a & ~b).sum(1, np.int64) >= need) & (n[j] - np.bitwise_count(b & ~a).sum(1, np.int64) >= need)
        return self.rid[i[ok]], self.rid[j[ok]]

    def few(self, take: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of small groups, by how far apart they stand."""
        at = np.flatnonzero(take)
        key, side = self.key[at], self.side[at]
        for d in range(1, min(FEW, len(at))):
            k = np.flatnonzero((key[:-d] == key[d:]) & ((side[:-d] == 0) | (side[:-d] != side[d:])))
            if not len(k):
                break
            yield self.kept(at[k], at[k + d])

    def block(self, a0: int, a1: int, b0: int, b1: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of two runs of rows that are sorted by size: few bits differ."""
        n, t = self.n, self.t
        x, c = np.empty(WIDE * LONG, np.uint64), np.empty(WIDE * LONG, np.uint8)
        for i in range(a0, a1, WIDE):
            i1 = min(a1, i + WIDE)
            low, high = n[i], n[i1 - 1]
            start = max(b0, i + 1) if same else b0 + int(np.searchsorted(n[b0:b1], self.need[i]))
            end = b0 + int(np.searchsorted(self.need[b0:b1], high, "right"))
            for j in range(start, end, LONG):
                j1 = min(end, j + LONG)
                m = n[j:j1]
                # as many as may differ for the best size in this run, and two for rounding
                most = np.max([s + m - 2 * _need(np.maximum(s, m), t) for s in (np.full_like(m, low), np.clip(m, low, high), np.full_like(m, high))], axis=0) + 2
                shape = (i1 - i, j1 - j)
                xor, count = x[: shape[0] * shape[1]].reshape(shape), c[: shape[0] * shape[1]].reshape(shape)
                # a sum beyond a byte would be too small: such a pair is looked at again
                total = np.zeros(shape, np.uint8)
                for w in self.folded:
                    np.bitwise_xor(w[i:i1, None], w[None, j:j1], out=xor)
                    np.bitwise_count(xor, out=count)
                    np.add(total, count, out=total)
                found = np.flatnonzero(total <= np.clip(most, 0, 255).astype(np.uint8)[None, :])
                p, q = i + found // shape[1], j + found % shape[1]
                if same and j < i1:
                    p, q = p[ok := p < q], q[ok]
                yield self.kept(p, q)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        change = np.flatnonzero(self.key[1:] != self.key[:-1]) + 1
        first = np.concatenate([[0], change])
        size = np.diff(np.concatenate([first, [len(self.key)]]))
        yield from self.few(np.repeat((size > 1) & (size <= FEW), size))
        for s, m in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
            if self.side[s] == 0:
                yield from self.block(s, s + m, s, s + m, True)
            else:
                cut = s + int(np.searchsorted(self.side[s : s + m], 2))
                yield from self.block(s, cut, cut, s + m, False)


def _meet(t: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of bags that meet on a token and may be similar; rows come sorted by token."""

    def out(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in _Group(group, t).pairs():
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                whole = pa.concat_batches(held)
                # the last token may go on
                cut = int(np.flatnonzero((key := whole.column("key").to_numpy()) == key[-1])[0])
                if cut:
                    yield from out(whole.slice(0, cut))
                held, rows = [whole.slice(cut)], whole.num_rows - cut
                limit = max(ROWS, 2 * rows)
        if rows:
            yield from out(pa.concat_batches(held))

    return run


def pairs(df: DataFrame, key: str, tokens: str, t: float = 0.8, within: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Similar bags: pairs of classes of equal bags, and the members of each class.

    Pairs: ``within..., a, b, common, larger`` (a < b, ids of the classes' first members).
    Members: ``within..., id, class, copies`` (rows in the class). Rows are compared only where the columns ``within``
    are equal. Null or empty bags (also of nothing but null or empty tokens) are in no class.
    Rows equal in key and bag count once; a key with several bags is in several classes.
    Other columns are ignored.
    """
    g = list(within or [])
    bags = df.select(*g, F.col(key).alias("id"), bag(F.col(tokens)).alias("bag")).where(F.size("bag") > 0)
    # computed once and kept where they are: equal bags only come together after a partial aggregation
    bags = store(bags.withColumn("same", F.sha2(F.concat_ws("\u0002", "bag"), 256)))
    ids = bags.select(*g, "id", "same").distinct()
    members = ids.join(ids.groupBy(*g, "same").agg(F.min("id").alias("class"), F.count("*").alias("copies")), [*g, "same"])
    reps = bags.groupBy(*g, "same").agg(F.min("id").alias("id"), F.first("bag").alias("bag")).drop("same")
    # numbers of the stored rows: a bag is one of them
    reps = store(reps.withColumn("rid", F.monotonically_increasing_id()))

    h = reps.select("rid", F.xxhash64(F.lit(0), *g).alias("within"), F.transform("bag", lambda x: F.xxhash64(x)).alias("h"))
    level, every = _sketch(h)
    postings = h.mapInArrow(_sign(level, t), POSTINGS)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), every // TASK)
    found = postings.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet(t), "x bigint, y bigint").distinct()
    left, right = (reps.select(*[F.col(c).alias(f"{c}_{x}") for c in [*g, "id", "bag"]], F.col("rid").alias(x)) for x in "xy")
    both = found.join(left, "x").join(right, "y").where("id_x <> id_y")
    for c in g:
        both = both.where(F.col(f"{c}_x") == F.col(f"{c}_y"))
    both = both.select(*[F.col(f"{c}_x").alias(c) for c in g], F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), F.col("bag_x").alias("bag_a"), F.col("bag_y").alias("bag_b"))
    common = F.size(F.array_intersect("bag_a", "bag_b"))
    most = F.greatest(F.size("bag_a"), F.size("bag_b"))
    exact = both.select(*g, "a", "b", common.alias("common"), most.alias("larger")).where(F.col("common") >= needed(F.col("larger"), t))
    return exact, members.select(*g, "id", "class", "copies")


def members_pairs(classes: DataFrame, members: DataFrame, within: list[str] | None = None, copies: int | None = None) -> DataFrame:
    """Pairs of rows (``id_a < id_b``): of similar classes, and in a class. All of them, if ``copies`` isn't given.

    With ``copies``, a class of more members than that stands in pairs with its first member only,
    and its other members are paired with that: a huge group gives as many rows as it has members, not their square.
    """
    g = list(within or [])
    if copies is None:
        return _all_pairs(classes, members, g)
    sized = members.withColumn("many", F.col("copies") > copies)
    front = sized.where("not many or id = class").select(*g, "id", "class")
    a = front.select(*g, F.col("id").alias("x"), F.col("class").alias("a"))
    b = front.select(*g, F.col("id").alias("y"), F.col("class").alias("b"))
    across = classes.select(*g, "a", "b").join(a, [*g, "a"]).join(b, [*g, "b"]).select(*g, "x", "y")
    inside = a.join(sized.select(*g, F.col("id").alias("y"), F.col("class").alias("a")), [*g, "a"]).where("x < y").select(*g, "x", "y")
    return across.unionByName(inside).where("x <> y").select(*g, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _all_pairs(classes: DataFrame, members: DataFrame, g: list[str]) -> DataFrame:
    """Every pair of members of similar classes and of one class, by blocks: a large class is spread over tasks."""
    links = classes.select(*g, "a", "b").unionByName(members.select(*g, F.col("class").alias("a"), F.col("class").alias("b")).distinct())
    # the order of ids within a class doesn't matter, only that a block has about as many members as others
    blocks = F.ceil(F.col("copies") / BLOCK).cast("int")
    put = members.withColumns({"block": F.pmod(F.xxhash64("id"), blocks).cast("int"), "blocks": blocks})
    packed = put.groupBy(*g, "class", "block").agg(F.collect_set("id").alias("ids"))
    sizes = members.groupBy(*g, "class").agg(F.max("copies").alias("copies")).select(*g, "class", blocks.alias("blocks"))
    for c in "ab":
        links = links.join(sizes.select(*g, F.col("class").alias(c), F.col("blocks").alias(f"n_{c}")), [*g, c])
    links = links.select("*", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)).alias("k_a"))
    links = links.select("*", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("k_b")).where("a <> b or k_a <= k_b")
    for c in "ab":
        links = links.join(packed.select(*g, F.col("class").alias(c), F.col("block").alias(f"k_{c}"), F.col("ids").alias(f"ids_{c}")), [*g, c, f"k_{c}"])
    pairs = links.select(*g, "a", "b", "k_a", "k_b", F.explode("ids_a").alias("x"), "ids_b").select(*g, "a", "b", "k_a", "k_b", "x", F.explode("ids_b").alias("y"))
    # within one block each pair comes both ways round
    pairs = pairs.where("x <> y and (a <> b or k_a <> k_b or x < y)")
    return pairs.select(*g, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(classes: DataFrame, members: DataFrame, within: list[str] | None = None) -> DataFrame:
    """One row per record: ``id``, its class, copies in it, and the number of classes linked to it."""
    g = list(within or [])
    links = classes.select(*g, F.explode(F.array("a", "b")).alias("class")).groupBy(*g, "class").agg(F.count("*").alias("links"))
    return members.join(links, [*g, "class"], "left").select(*g, "id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))
