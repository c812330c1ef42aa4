"""Correction log to links, detections to records, price refreshes, and incremental re-projection.

Tables that streams maintain are folders of versions: batch ``n`` of a writer goes to
``<path>/writer=<name>/version=n`` and a repeated batch replaces the same folder, so a restart
gives the same table and writers never touch each other's versions.  Every version carries a
commit time.  The current record of a detection is the one with the newest commit among all writers,
so a scan adds to a session, a re-projection replaces what it redoes, and a replayed
batch replaces itself.

Current tables (links, catalog, stored detections) are given as functions and read anew for
each batch, so a running stream sees every correction and refresh.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from slotvalue.operators.resolve import item_entries, resolve
from slotvalue.operators.skew import top_per_group
from slotvalue.runtime import checkpoint as checkpoint_table
from slotvalue.runtime import freed_shuffles
from slotvalue.schema import DETECTION, LINK_EVENT
from slotvalue.sources.readers import path_exists, stale
from slotvalue.sources.writers import write_snapshot

Table = Callable[[], DataFrame]
BUCKETS = 1024
# Up to this many folders, each task writes its rows into all of them; of more, rows of a folder come together first.
OWN_FOLDERS = 64
# Bytes of arriving and of stored detections that are resolved at once: what their joins shuffle is gone before the next ones are read.
BATCH_BYTES, SLICE_BYTES = 2 << 30, 1 << 30


def stream_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LINK_EVENT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_detections(spark: SparkSession, path: str, files_per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """Arriving detections; however much arrives, a batch has ``BATCH_BYTES`` of files unless another measure is given."""
    reader = spark.readStream.schema(DETECTION)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch or BATCH_BYTES)
    return reader.parquet(path)


def changing_links(events: DataFrame) -> DataFrame:
    """Streaming state: the newest manual item per icon.  Order of arrival does not matter."""
    manual = events.where((F.col("source") == "manual") & (F.col("item_id") != ""))
    last = manual.groupBy("icon_id").agg(F.max(F.struct("seq", "item_id")).alias("last"))
    return last.select("icon_id", "last.item_id", "last.seq")


def _now() -> int:
    """Commit time in microseconds; the clocks of the drivers that share a store must agree."""
    return time.time_ns() // 1000


def version_path(path: str, writer: str, version: int) -> str:
    return f"{path}/writer={writer}/version={version}"


def write_version(
    batch: DataFrame, path: str, version: int, writer: str = "main", by: Sequence[str] = (), buckets: int = BUCKETS,
    commit: int | None = None, mode: str = "overwrite",
) -> None:
    """Write a batch as one version, in folders ``by`` of ``buckets`` values.

    Bringing the rows of a folder together spares files, but shuffles the whole batch; with few folders a task has
    enough rows for a file in each.  A version that is written in several parts gives them one ``commit`` and appends
    all but the first.
    """
    rows = batch.withColumn("commit", F.lit(commit or _now()).cast("bigint"))
    if by and buckets > OWN_FOLDERS:
        rows = rows.hint("rebalance", *[F.col(c) for c in by])
    with freed_shuffles(rows.sparkSession):
        rows.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(version_path(path, writer, version))


def start(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None], **trigger) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


# --- links -----------------------------------------------------------------------------


LINKS = "icon_id string, item_id string, seq bigint"


def maintain_links(events: DataFrame, out: str, checkpoint: str, compact_every: int = 0, **trigger) -> StreamingQuery:
    """Write the links that changed in each batch; after every ``compact_every`` batches fold the versions into one."""
    spark = events.sparkSession

    def each(changed: DataFrame, n: int) -> None:
        write_version(changed, out, n)
        if compact_every and (n + 1) % compact_every == 0:
            fold_links(spark, out, links_as_of(spark, checkpoint, n, spark.read.parquet(version_path(out, "main", n))), n)

    return start(changing_links(events), "update", checkpoint, each, **trigger)


def links_in_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """Newest link per icon out of the state of the stream, as of a finished batch or of the last one.

    The state has one row per icon, so this costs the same after any number of batches.
    """
    if not path_exists(spark, f"{checkpoint}/state/0/*") or (batch is not None and batch < 0):
        return spark.createDataFrame([], LINKS)
    reader = spark.read.format("statestore")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    # The value of the state is the one aggregate of ``changing_links``.
    last = F.col(f"value.{state.schema['value'].dataType.names[0]}")
    return state.select("key.icon_id", last["item_id"].alias("item_id"), last["seq"].alias("seq"))


def links_as_of(spark: SparkSession, checkpoint: str, batch: int, changed: DataFrame) -> DataFrame:
    """Links while a batch is being worked on: the state after the batch before, and what this one changed."""
    both = links_in_state(spark, checkpoint, batch - 1).unionByName(changed.select("icon_id", "item_id", "seq"))
    return top_per_group(both, ["icon_id"], [F.col("seq").desc()], 1).drop("rn")


def current_links(spark: SparkSession, out: str) -> DataFrame:
    """Newest link per icon over all written versions."""
    if not path_exists(spark, f"{out}/writer=*/version=*"):
        return spark.createDataFrame([], LINKS)
    changes = spark.read.parquet(out).select("icon_id", "item_id", "seq")
    return top_per_group(changes, ["icon_id"], [F.col("seq").desc()], 1).drop("rn")


def changes_since(spark: SparkSession, out: str, seen: int) -> DataFrame:
    """Rows of the versions after ``seen``; older folders are pruned.

    A folded version has every link, changed or not: what a reader missed is in it, also where the versions between
    are gone.
    """
    return spark.read.parquet(out).where(F.col("version") > seen)


def _versions(spark: SparkSession, out: str, writer: str) -> dict[int, str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/writer={writer}/version=*")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    return {int(s.getPath().getName().partition("=")[2]): s.getPath().toString() for s in found}


def fold_links(spark: SparkSession, out: str, links: DataFrame, version: int) -> None:
    """Write all links as one folded version, and remove what the folded version before it made superfluous.

    Versions since that one stay until the next fold, so a reader that has listed them can finish.
    """
    before = [v for v in _versions(spark, out, "fold") if v < version]
    write_version(links, out, version, "fold")
    if not before:
        return
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    last = max(before)
    old = [p for v, p in _versions(spark, out, "main").items() if v <= last] + [p for v, p in _versions(spark, out, "fold").items() if v < last]
    for p in old:
        path = hadoop.Path(p)
        path.getFileSystem(conf).delete(path, True)


def compact_links(spark: SparkSession, out: str, target: str) -> None:
    """Write the newest link of every icon to a new place as version 0."""
    write_version(current_links(spark, out), target, 0, "compact")


# --- detections and records ------------------------------------------------------------


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _ddl(schema: StructType) -> str:
    return ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schema)


# The indexes of a detection store: name, key column and bucket column.
ICON_INDEX = ("icons", "icon_id", "icon_bucket")
TEXT_INDEX = ("texts", "ocr_id", "text_bucket")


def store_detections(detections: DataFrame, path: str, buckets: int = BUCKETS, version: int = 0, writer: str = "main") -> None:
    """Keep detections by session bucket, and their sessions by icon and by recognised item.

    A batch of corrections or prices then reads the buckets it touches only.  A crowded
    bucket lies in several files, as each task writes its own.  An index has a row per detection: readers
    make its sessions distinct, and repeated rows compress to little.
    """
    rows = detections.withColumn("session_bucket", _bucket("session_id", buckets))
    write_version(rows, f"{path}/rows", version, writer, ["session_bucket"], buckets)
    for name, key, column in (ICON_INDEX, TEXT_INDEX):
        shown = detections.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, "session_id")
        write_version(shown.withColumn(column, _bucket(key, buckets)), f"{path}/{name}", version, writer, [column], buckets)


def _stored(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    if not path_exists(spark, f"{path}/writer=*/version=*"):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(path)


def stored_detections(spark: SparkSession, path: str) -> DataFrame:
    """Each detection once, however often a scan was stored."""
    rows = _stored(spark, f"{path}/rows", f"{_ddl(DETECTION)}, commit bigint, session_bucket int")
    return newest(rows).drop("commit", "writer", "version")


def stored_index(spark: SparkSession, path: str, index: tuple[str, str, str] = ICON_INDEX) -> DataFrame:
    name, key, column = index
    return _stored(spark, f"{path}/{name}", f"{key} string, session_id string, {column} int")


def newest(rows: DataFrame) -> DataFrame:
    """The row with the newest commit of every detection; a hot session is many groups.

    Records that were redone from several stored copies of a detection share a commit; that of the newest copy counts.
    """
    keys = ["session_id", "det_idx"]
    if "session_bucket" in rows.columns:
        keys.append("session_bucket")  # so that a filter on it reaches the folders
    order = [F.col(c).desc_nulls_last() for c in ("commit", "stored") if c in rows.columns]
    return top_per_group(rows, keys, order, 1).drop("rn")


def _pick(rows: DataFrame, keys: DataFrame, key: str, bucket: str, buckets: int) -> DataFrame:
    """Rows with one of the keys.

    On a stored table only the folders of the touched buckets are read; their numbers (at
    most ``buckets`` integers) go through the driver into the partition filter.
    """
    keys = keys.select(key).distinct()
    if bucket not in rows.columns:
        return rows.join(keys, key, "left_semi")
    keys = checkpoint_table(keys.withColumn(bucket, _bucket(key, buckets)))
    touched = [row[0] for row in keys.select(bucket).distinct().collect()]
    return rows.where(F.col(bucket).isin(touched)).join(keys, [bucket, key], "left_semi").drop(bucket)


def affected_sessions(
    icon_index: DataFrame, icons: DataFrame, text_index: DataFrame | None = None, items: DataFrame | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Sessions that show one of the icons, or whose text names one of the items.

    The detections themselves can take the place of the indexes.
    """
    found = _pick(icon_index, icons, "icon_id", "icon_bucket", buckets).select("session_id")
    if items is not None:
        named = items.select(F.col("item_id").alias("ocr_id"))
        found = found.unionByName(_pick(text_index, named, "ocr_id", "text_bucket", buckets).select("session_id"))
    return found.distinct()


def sessions(spark: SparkSession, records: str, session_ids: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Current records of some sessions; only the folders of their buckets are read."""
    touched = spark.createDataFrame([(s,) for s in session_ids], "session_id string").select(_bucket("session_id", buckets))
    numbers = sorted({row[0] for row in touched.collect()})
    rows = spark.read.parquet(records).where(F.col("session_bucket").isin(numbers) & F.col("session_id").isin(list(session_ids)))
    return newest(rows).drop("commit", "stored", "writer", "version", "session_bucket")


def write_records(
    records: DataFrame, out: str, version: int, writer: str, buckets: int = BUCKETS, commit: int | None = None, mode: str = "overwrite"
) -> None:
    """``stored`` is the commit of the stored detection that a record was redone from, null for a scanned one."""
    if "stored" not in records.columns:
        records = records.withColumn("stored", F.lit(None).cast("bigint"))
    rows = records.withColumn("session_bucket", _bucket("session_id", buckets))
    write_version(rows, out, version, writer, ["session_bucket"], buckets, commit, mode)


def current_records(spark: SparkSession, out: str) -> DataFrame:
    """The newest record of each detection over all writers."""
    return newest(spark.read.parquet(out)).drop("commit", "stored", "session_bucket")


def compact_records(spark: SparkSession, out: str, target: str, buckets: int = BUCKETS) -> None:
    """Write the current record of every detection to a new place as version 0."""
    write_records(current_records(spark, out).drop("writer", "version"), target, 0, "compact", buckets)


def value_detections(
    detections: DataFrame, links_of: Table, catalog_of: Table, out: str, checkpoint: str,
    basis: str = "avg24h", store: str | None = None, buckets: int = BUCKETS, writer: str = "scan", **trigger,
) -> StreamingQuery:
    """Resolve arriving detections against the tables of the moment and add their records.

    With ``store`` the detections are kept for later re-projections.
    """

    def each(batch: DataFrame, n: int) -> None:
        if store:
            store_detections(batch, store, buckets, n, writer)
        write_records(resolve(batch, links_of(), catalog_of(), basis), out, n, writer, buckets)

    return start(detections, "append", checkpoint, each, **trigger)


def _slices(spark: SparkSession, store: str, touched: Sequence[int], buckets: int) -> list[list[int]]:
    """Touched buckets in groups of about ``SLICE_BYTES`` of stored rows; one empty group if none is touched."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/rows")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = files.getContentSummary(folder).getLength() if files.exists(folder) else 0
    parts = max(1, min(len(touched), -(-size * len(touched) // (buckets * SLICE_BYTES))))
    return [sorted(touched)[n::parts] for n in range(parts)]


def reproject(
    spark: SparkSession, store: str, sessions: DataFrame | None, links: DataFrame, catalog: DataFrame, out: str,
    version: int, writer: str, basis: str = "avg24h", buckets: int = BUCKETS,
) -> None:
    """Resolve the stored detections of some sessions, or of all, again and write them as a version.

    Whole buckets are worked on one slice after the other, so a session is always of one state and the disk holds the
    shuffles of one slice.  Stored copies of a detection are not compared here, where rows are wide: all are redone, and
    ``newest`` picks among the records.
    """
    stored = _stored(spark, f"{store}/rows", f"{_ddl(DETECTION)}, commit bigint, session_bucket int").withColumnRenamed("commit", "stored")
    touched, keys = list(range(buckets)), None
    if sessions is not None:
        with freed_shuffles(spark):
            keys = checkpoint_table(sessions.select("session_id").distinct().withColumn("session_bucket", _bucket("session_id", buckets)))
        touched = [row[0] for row in keys.select("session_bucket").distinct().collect()]
    slices, commit = _slices(spark, store, touched, buckets), _now()
    if len(slices) > 1:
        links, catalog = (spark.read.parquet(write_snapshot(side, name)) for side, name in ((links, "links"), (catalog, "catalog")))
    for n, part in enumerate(slices):
        rows = stored.where(F.col("session_bucket").isin(part))
        if keys is not None:
            rows = rows.join(keys.where(F.col("session_bucket").isin(part)), ["session_bucket", "session_id"], "left_semi")
        records = resolve(rows, links, catalog, basis, keep=["stored"])
        write_records(records, out, version, writer, buckets, commit, "append" if n else "overwrite")


def maintain_records(
    events: DataFrame, store: str, links_of: Callable[[DataFrame], DataFrame], catalog_of: Table,
    links_out: str, records_out: str, checkpoint: str, basis: str = "avg24h", buckets: int = BUCKETS,
    writer: str = "correction", **trigger,
) -> StreamingQuery:
    """After each batch of corrections recompute only the sessions that show a changed icon.

    ``links_of`` merges the manual links into the other layers; ``store`` is the folder of
    ``store_detections``.
    """
    spark = events.sparkSession

    def each(changed: DataFrame, batch: int) -> None:
        write_version(changed, links_out, batch)
        icons = spark.read.parquet(version_path(links_out, "main", batch))
        shown = affected_sessions(stored_index(spark, store), icons, buckets=buckets)
        links = links_of(links_as_of(spark, checkpoint, batch, icons))
        reproject(spark, store, shown, links, catalog_of(), records_out, batch, writer, basis, buckets)

    return start(changing_links(events), "update", checkpoint, each, **trigger)


# --- prices ----------------------------------------------------------------------------


def repriced_items(before: DataFrame, after: DataFrame, basis_before: str = "avg24h", basis_after: str = "avg24h") -> DataFrame:
    """Items whose value or entry differs between two catalogs (or two price bases)."""
    old = item_entries(before, basis_before)
    new = item_entries(after, basis_after)
    changed = new.exceptAll(old).unionByName(old.exceptAll(new))
    return changed.select("item_id").distinct()


def refresh_records(
    spark: SparkSession, store: str, links: DataFrame, before: DataFrame, after: DataFrame, records_out: str, version: int,
    basis_before: str = "avg24h", basis_after: str = "avg24h", buckets: int = BUCKETS, writer: str = "refresh",
) -> None:
    """Recompute the sessions that a new catalog or price basis changes.

    An item is reached over the icons that are linked to it and over the texts that name it.
    """
    with freed_shuffles(spark):
        items = checkpoint_table(repriced_items(before, after, basis_before, basis_after))
    icons = links.join(items, "item_id", "left_semi").select("icon_id")
    shown = affected_sessions(stored_index(spark, store), icons, stored_index(spark, store, TEXT_INDEX), items, buckets)
    reproject(spark, store, shown, links, after, records_out, version, writer, basis_after, buckets)


def refresh_catalog(
    age: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame], str], ttl_h: float = 24.0
) -> str | None:
    """Load and store a new snapshot if the current one is stale; None if it is still fresh.

    ``age`` is the one-row result of ``snapshot_age``.
    """
    if not age.select(stale(F.col("age_h"), ttl_h)).first()[0]:
        return None
    return store(load())


def refresh_prices(
    spark: SparkSession, age: DataFrame, current: DataFrame, load: Table, save: Callable[[DataFrame], str], read: Callable[[str], DataFrame],
    store: str, links: DataFrame, records_out: str, version: int, basis: str = "avg24h", ttl_h: float = 24.0, buckets: int = BUCKETS,
) -> str | None:
    """The whole refresh: age test, new snapshot, and the records that it changes."""
    path = refresh_catalog(age, load, save, ttl_h)
    if path is not None:
        refresh_records(spark, store, links, current, read(path), records_out, version, basis, basis, buckets)
    return path
