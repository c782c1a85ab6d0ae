"""Orphan references found with compressed bitmaps over dictionary-encoded keys.

Each key space is cut into ranges by hash. Inside a range every distinct key gets
a small integer; references and parents become bitmaps per range and period, and
``reference AND NOT parent`` leaves the keys that need a closer look. Those bits
are decoded back to keys and only the rows that carry them are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that one key range should hold at most on average: those of parents and references.
KEYS_PER_RANGE = 20_000
BLANKS = " \t\r\n 　"

SURVIVORS = (
    "space string, ck string, tbl string, ref_field string, period string, known boolean, "
    "spellings array<string>, arrived_at timestamp, deleted_at double"
)


class Bits:
    """A set of 16-bit integers: a sorted array while sparse, a bitmap of 8 KB once dense."""

    DENSE = 4096

    def __init__(self, codes: np.ndarray):
        codes = np.unique(codes).astype(np.int64)
        self.dense = len(codes) > self.DENSE
        if self.dense:
            flags = np.zeros(65536, np.uint8)
            flags[codes] = 1
            self.data = np.packbits(flags)
        else:
            self.data = codes.astype(np.uint16)

    def flags(self) -> np.ndarray:
        if self.dense:
            return np.unpackbits(self.data).astype(bool)
        out = np.zeros(65536, bool)
        out[self.data] = True
        return out

    def codes(self) -> np.ndarray:
        return np.flatnonzero(self.flags()) if self.dense else self.data.astype(np.int64)

    def and_not(self, other: Bits) -> Bits:
        if self.dense and other.dense:
            return Bits(np.flatnonzero(np.unpackbits(self.data & ~other.data)))
        mine = self.codes()
        return Bits(mine[~other.flags()[mine]])

    def union(self, other: Bits) -> Bits:
        if self.dense and other.dense:
            both = Bits(np.zeros(0, np.int64))
            both.dense, both.data = True, self.data | other.data
            return both
        return Bits(np.concatenate([self.codes(), other.codes()]))


class Bitmap:
    """A compressed bitmap: one container for each 65,536 codes."""

    def __init__(self, parts: dict[int, Bits]):
        self.parts = parts

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        high = codes >> 16
        return cls({int(h): Bits(codes[high == h] & 0xFFFF) for h in np.unique(high)})

    def and_not(self, other: Bitmap) -> Bitmap:
        return Bitmap({h: b.and_not(other.parts[h]) if h in other.parts else b for h, b in self.parts.items()})

    def union(self, other: Bitmap) -> Bitmap:
        return Bitmap(self.parts | {h: self.parts[h].union(b) if h in self.parts else b for h, b in other.parts.items()})

    def decode(self) -> np.ndarray:
        found = [b.codes() + (h << 16) for h, b in self.parts.items()]
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _survivors(rows: pd.DataFrame) -> pd.DataFrame:
    """One key range: encode, AND NOT by period, decode what is left."""
    codes, keys = pd.factorize(rows["ck"])
    is_parent = rows["tbl"].isna().to_numpy()
    parents = rows[is_parent]
    at = pd.Series(np.flatnonzero(is_parent), index=codes[is_parent])
    safe = is_parent & rows["deleted_at"].isna().to_numpy()
    arrived = rows["period"].to_numpy()
    out = []
    refs = rows[~is_parent]
    ref_codes = codes[~is_parent]
    # parents month by month; what came before a month is the union so far, built once. An unknown month
    # ('' sorts first) has no parent that surely came before it
    months = sorted(x for x in set(arrived[safe]) if x)
    so_far, upto = Bitmap({}), 0
    groups = refs.groupby(["tbl", "ref_field", "period"]).indices
    for tbl, field, period in sorted(groups, key=lambda g: g[2]):
        where = groups[tbl, field, period]
        while upto < len(months) and months[upto] < period:
            so_far, upto = so_far.union(Bitmap.of(codes[safe & (arrived == months[upto])])), upto + 1
        left = Bitmap.of(ref_codes[where]).and_not(so_far).decode()
        if len(left):
            out.append(pd.DataFrame({"code": left, "tbl": tbl, "ref_field": field, "period": period}))
    cols = ["space", "ck", "tbl", "ref_field", "period", "known", "spellings", "arrived_at", "deleted_at"]
    if not out:
        return pd.DataFrame(columns=cols)
    found = pd.concat(out, ignore_index=True)
    found["space"] = rows["space"].iloc[0]
    found["ck"] = np.asarray(keys, dtype=object)[found["code"]]
    found["known"] = found["code"].isin(at.index)
    place = found["code"].map(at)
    info = rows[["spellings", "arrived_at", "deleted_at"]].reset_index(drop=True)
    for c in info.columns:
        found[c] = [info[c].iat[int(p)] if p == p else None for p in place] if c == "spellings" else info[c].reindex(place).to_numpy()
    return found[cols] if len(parents) or len(found) else pd.DataFrame(columns=cols)


def canonical(key: Column) -> Column:
    """A key without letter case and outer blanks."""
    return F.lower(F.btrim(key, F.lit(BLANKS)))


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def orphan_references(refs: DataFrame, parents: DataFrame, keys_per_range: int = KEYS_PER_RANGE) -> DataFrame:
    """Referring rows whose key names no row, a deleted row or a row that came later.

    ``refs``: ``tbl, ref_field, row_id, space, key, ref_at`` (arrival of the referring
    row), ``made_at`` (DOUBLE, compared with the parent's deletion; null where deletion
    is no matter) and ``late_counts`` (BOOLEAN). ``parents``: ``space, key, arrived_at,
    deleted_at``. Result: ``tbl, ref_field, row_id, orphan_kind, period``, distinct.

    Null, empty and blank references are no case, nor is a reference that differs
    from a parent's key only in letter case or outer blanks. Of repeated parents the
    first arrival counts and the last state of deletion. A referring row without an arrival has a null
    period and is never late. Empty tables give no rows or only ``missing`` ones.
    Other columns of the inputs are ignored. References are reduced to distinct
    (key, period) before they are gathered, so a key that a third of all rows name
    costs a range no more than one of a single row.
    """
    # references may name keys that no parent has, so they count for the number of ranges too
    ranges = max(16, -(-(parents.count() + refs.count()) // keys_per_range))
    bucket = F.pmod(F.xxhash64("space", "ck"), F.lit(ranges))
    r = (
        refs.select("tbl", "ref_field", "row_id", "space", "key", "ref_at", "made_at", "late_counts", canonical(F.col("key")).alias("ck"), F.coalesce(month(F.col("ref_at")), F.lit("")).alias("period"))
        .where(F.col("ck") != "")
    )
    p = (
        parents.select("space", "key", "arrived_at", "deleted_at", canonical(F.col("key")).alias("ck"))
        .where(F.col("ck") != "")
        .groupBy("space", "ck")
        .agg(F.collect_set("key").alias("spellings"), F.min("arrived_at").alias("arrived_at"), F.max_by("deleted_at", "arrived_at").alias("deleted_at"))
    )
    none = F.lit(None)
    both = r.select("space", "ck", "tbl", "ref_field", "period", none.cast("array<string>").alias("spellings"), none.cast("timestamp").alias("arrived_at"), none.cast("double").alias("deleted_at")).distinct().unionByName(
        p.select("space", "ck", none.cast("string").alias("tbl"), none.cast("string").alias("ref_field"), F.coalesce(month(F.col("arrived_at")), F.lit("")).alias("period"), "spellings", "arrived_at", "deleted_at")
    )
    left = both.groupBy("space", bucket.alias("key_range")).applyInPandas(_survivors, SURVIVORS)
    same = F.array_contains(F.col("spellings"), F.col("key"))
    kind = (
        F.when(~F.col("known"), "missing")
        .when(same & (F.col("deleted_at") <= F.col("made_at")), "deleted")
        .when(same & F.col("late_counts") & (F.col("arrived_at") > F.col("ref_at")), "late")
    )
    return (
        r.join(left, ["space", "ck", "tbl", "ref_field", "period"])
        .withColumn("orphan_kind", kind)
        .where("orphan_kind is not null")
        .select("tbl", "ref_field", "row_id", "orphan_kind", F.nullif("period", F.lit("")).alias("period"))
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, kind and month."""
    return orphans.groupBy("tbl", "ref_field", "orphan_kind", "period").agg(F.count("*").alias("orphans"))
