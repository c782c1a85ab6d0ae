"""Histories: revisions, changes folded into state, lineage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import cut


def heads(revisions: DataFrame) -> DataFrame:
    """The newest revision of each document."""
    return revisions.groupBy("document_id").agg(F.max_by(F.struct("id", "revision_no"), F.struct("revision_no", "id")).alias("h")).select("document_id", "h.id", "h.revision_no")


def stale(revisions: DataFrame) -> DataFrame:
    """Revisions whose content differs from the one before (V3): ``id, document_id, changed``."""
    w = Window.partitionBy("document_id").orderBy("revision_no", "id")
    before = F.lag("content_hash").over(w)
    return revisions.select("id", "document_id", (before.isNotNull() & ~F.col("content_hash").eqNullSafe(before)).alias("changed"))


def fold(ops: DataFrame, key: list[str], field: str, value: str, order: list[str]) -> DataFrame:
    """State after all operations: the last value of each field."""
    return ops.groupBy(*key, field).agg(F.max_by(value, F.struct(*order)).alias(value))


def ancestors(nodes: DataFrame, child: str, parent: str, most: int = 40) -> DataFrame:
    """``id, root, depth``: the oldest ancestor of each row by doubling pointers (V5).

    Each round joins pointers with themselves, so a chain of length n takes log n rounds;
    lineage is cut after each. A parent that isn't there ends a chain. Cycles end after ``most`` rounds.
    """
    known = nodes.select(F.col(child).alias("id"), F.col(parent).alias("up")).dropDuplicates(["id"])
    there = known.select(F.col("id").alias("up"), F.lit(True).alias("ok"))
    p = known.join(there, "up", "left").select("id", F.when(F.col("ok"), F.col("up")).alias("up"), F.when(F.col("ok"), 1).otherwise(0).alias("depth"))
    p = cut(p)
    for _ in range(most):
        q = p.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        j = p.join(q, "up", "left")
        new = cut(j.select("id", F.coalesce("far", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("went")))
        p = new.drop("went")
        if not new.where("went").take(1):
            break
    return p.select("id", F.coalesce("up", "id").alias("root"), "depth")


def lost_updates(ops: DataFrame, fence: str, order: list[str], by: list[str]) -> DataFrame:
    """Writes whose token is older than one seen before (R6): rejected, kept apart."""
    newest = F.max(fence).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ops.withColumn("rejected", F.coalesce(F.col(fence) < newest, F.lit(False)))


def purge(documents: DataFrame, now: float) -> DataFrame:
    """Documents past their deadline lose their payload (R11): ``id, state``."""
    gone = (F.col("lifecycle_state") == "DELETED") & (F.col("retention_deadline") <= now)
    return documents.select("id", F.when(gone, "PURGED").otherwise(F.col("lifecycle_state")).alias("state"))


def access(requests: DataFrame, members: DataFrame, grants: DataFrame, actions: DataFrame) -> DataFrame:
    """``role, allowed`` of requests: by membership, else by a document's grant."""
    j = requests.join(members, ["tenant_id", "user_id"], "left").join(grants, ["doc_id", "user_id"], "left").withColumn("role", F.coalesce("member_role", "grant_role"))
    allowed = actions.select("role", "action", F.lit(True).alias("yes")).distinct()
    return j.join(allowed, ["role", "action"], "left").select("request_id", "role", F.coalesce("yes", F.lit(False)).alias("allowed"))


def fill_budget(charges: DataFrame, by: str, order: str, amount: str, cap: float) -> DataFrame:
    """``accepted`` of each charge: rejected ones don't count towards the cap.

    A key's charges are one sequence by nature. They are sorted with their key and pass by in Arrow batches; of
    what went before only the sum is kept. Null amounts count as 0.
    """
    rows = charges.select(by, order, F.col(amount).cast("double").alias(amount)).repartition(by).sortWithinPartitions(by, order, amount)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, spent = object(), 0.0
        for batch in batches:
            ok = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != last:
                    last, spent = key, 0.0
                ok.append(spent + (x or 0.0) <= cap)
                if ok[-1]:
                    spent += x or 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], names=[by, order, amount, "accepted"])

    return rows.mapInArrow(run, f"{kinds}, accepted boolean")


def swap_heads(changes: DataFrame, by: str, order: list[str], ident: str, expected: str) -> DataFrame:
    """``accepted, head`` of changes made under an expected head (V2, V7): a change is taken if the head is the one it names.

    Each key starts without a head; an accepted change is the new one. ``head`` is what it was before the change.
    Changes are sorted with their key and pass by in Arrow batches; of what went before only the head is kept.
    """
    cols = [by, ident, expected]
    rows = changes.select(*dict.fromkeys([*cols, *order])).repartition(by).sortWithinPartitions(by, *order).select(*cols)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = object(), None
        for batch in batches:
            ok, seen = [], []
            for key, new, want in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if key != last:
                    last, head = key, None
                seen.append(head)
                ok.append(want == head)
                if ok[-1]:
                    head = new
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(seen, batch.column(1).type)], names=[*cols, "accepted", "head"])

    return rows.mapInArrow(run, f"{kinds}, accepted boolean, head {rows.schema[ident].dataType.simpleString()}")


def resolve_units(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """Units after people's decisions (V9): the last decision on a unit gives its value and makes it HUMAN_VERIFIED.

    ``units``: ``atu_id, status, value_json``; ``decisions``: ``atu_id, value_json, ts, id``. Decisions on
    units that aren't there are left out.
    """
    last = decisions.groupBy("atu_id").agg(F.max_by(F.struct(F.col("value_json").alias("v")), F.struct("ts", "id")).alias("d"))
    return units.join(last, "atu_id", "left").select("atu_id", F.when(F.col("d").isNotNull(), "HUMAN_VERIFIED").otherwise(F.col("status")).alias("status"), F.when(F.col("d").isNotNull(), F.col("d.v")).otherwise(F.col("value_json")).alias("value_json"))


def append_revision(revisions: DataFrame, contents: DataFrame) -> DataFrame:
    """New revisions: number and parent from the head, content hash; equal contents make none (V1, V2, V4).

    ``contents``: ``document_id, content``. A document without revisions starts at 1. Undo is
    appending an older content again.
    """
    h = revisions.groupBy("document_id").agg(F.max_by(F.struct("id", "revision_no", "content_hash"), F.struct("revision_no", "id")).alias("h"))
    new = contents.withColumn("content_hash", F.sha2("content", 256)).join(h, "document_id", "left")
    new = new.where(F.col("h.content_hash").isNull() | (F.col("h.content_hash") != F.col("content_hash")))
    no = F.coalesce(F.col("h.revision_no"), F.lit(0)) + 1
    ident = F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("|", "document_id", no.cast("string"), "content_hash"), 256), 1, 12))
    return new.select(ident.alias("id"), "document_id", no.alias("revision_no"), F.col("h.id").alias("parent_revision_id"), "content", "content_hash")


def current(rows: DataFrame, key: list[str], order: list[str], deleted: str) -> DataFrame:
    """What is there after all upserts and deletions (X1, X2, V8): the last row of each key, unless it deletes it."""
    from lodestone.operators.ordered import latest

    return latest(rows, key, order).where(~F.coalesce(F.col(deleted), F.lit(False)))


def live(rows: DataFrame, expires: str, now: float) -> DataFrame:
    """Rows that haven't run out."""
    return rows.where(F.col(expires) >= now)
