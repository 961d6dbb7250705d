"""Streams that keep the document index and the asset table up to date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scenelake.operators.catalog import completed_after
from scenelake.operators.changes import scan_diff, scan_upsert
from scenelake.operators.lifecycle import first_policies
from scenelake.session import cut_lineage
from scenelake.sources.search_docs import build_documents, with_index, write_batch


@dataclass(frozen=True)
class Synced:
    """`policy`: the table to store, first indexes of new libraries included. `cursor`: where to go on.
    `left_out`: (asset_id, library_slug) of completed assets that gave no document, such as videos without scenes."""

    policy: DataFrame
    cursor: int | None
    left_out: DataFrame


def _index(
    todo: DataFrame, scene: DataFrame, policy: DataFrame, documents: str, postings: str, batch_id: str, as_of: int,
    store_policy: Callable[[DataFrame], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents and postings of `todo`; the policies, and the assets without a document."""
    policies = cut_lineage(first_policies(policy, todo.select(F.col("library_id").alias("library_slug")), as_of))
    # Policies first: an index without documents is harmless, documents without a policy can't be found.
    if store_policy is not None:
        store_policy(policies)
    docs = cut_lineage(with_index(build_documents(todo, scene, as_of), policies))
    if not docs.isEmpty():
        write_batch(docs, documents, postings, batch_id)
    without = todo.select(F.col("id").alias("asset_id"), F.col("library_id").alias("library_slug"))
    return policies, cut_lineage(without.join(docs, "asset_id", "left_anti"))


def sync_batch(
    asset: DataFrame, scene: DataFrame, library: DataFrame, policy: DataFrame, documents: str, postings: str,
    as_of: int, cursor: int | None = None, slug: str | None = None,
    store_policy: Callable[[DataFrame], None] | None = None,
) -> Synced:
    """Index the completed assets beyond the cursor: documents and postings, in one job each.

    Libraries without a policy get their first index; store the returned policies, or give `store_policy`, which
    is called before any document is written. A batch is named by its library and cursor, so the same call after
    a failure replaces what the failed one has written.
    """
    todo = completed_after(asset, library, cursor, slug)
    name = f"{slug or 'all'}-{cursor if cursor is not None else 'start'}"
    policies, left_out = _index(todo, scene, policy, documents, postings, name, as_of, store_policy)
    newest = todo.agg(F.max("id")).first()[0]
    return Synced(policies, newest if newest is not None else cursor, left_out)


def sync_stream(
    completed: DataFrame, scene: Callable[[], DataFrame], library: Callable[[], DataFrame],
    policy: Callable[[], DataFrame], store_policy: Callable[[DataFrame], None], documents: str, postings: str,
    checkpoint: str, as_of: int, slug: str | None = None,
    store_left_out: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Index a stream of asset rows as they complete, of all libraries or of one; the checkpoint is the cursor.

    New libraries get a policy, stored before their documents. A batch replaces its own output on a retry, so
    documents and postings are written once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        todo = completed_after(batch, library(), None, slug)
        name = f"stream-{slug or 'all'}-{batch_id}"
        _, left_out = _index(todo, scene(), policy(), documents, postings, name, as_of, store_policy)
        if store_left_out is not None:
            store_left_out(left_out, batch_id)

    return (
        completed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def scan_stream(
    found: DataFrame, current: Callable[[], DataFrame], publish: Callable[[DataFrame, DataFrame, int], None],
    checkpoint: str,
) -> StreamingQuery:
    """Apply each arriving inventory: `publish(new_assets, diff, batch_id)` stores the next snapshot."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        asset = current()
        publish(scan_upsert(asset, batch), scan_diff(asset, batch), batch_id)

    return (
        found.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
