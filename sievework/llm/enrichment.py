"""Valid-time enrichment of sales with the versions of their clients, as a stateful stream with event-time timers.

Both tables arrive in batches. Each batch of a table has a tick, a row whose event time is the table's largest time so far; all other rows have none, so that no row
is ever late to Spark. A table's watermark is then the largest time of its earlier batches, and Spark's policy for two watermarks, the smaller one, yields H. Changes below their table's watermark are late; the others are versions. A sale waits until H
has passed it, then takes its client's last version up to its time. Afterwards all versions up to H but each client's last are
dropped. Both are events at known times, so each slot of the state holds one timer, at the first of them: a slot without new rows is called when its timer expires, and no other.
The query is started anew for each batch, on one checkpoint; each start runs one micro-batch. The last batch's event time is the end of all time, so that one more start, fed with nothing but a tick, releases what still waits.

Scale: a slot holds some ``SLOT_ROWS`` rows, clients by hash, and works on them as arrays. A client with more rows has slots of its own, a grid: its versions are dealt to the
columns, its sales to the rows, and a sale asks every slot of its row. Rows and columns are the root of the client's size over ``SLOT_ROWS`` each, so a slot's share sinks as the client grows.
What a slot says of its own versions is enough to tell the last of all columns: versions since the last pruning, whose last one counts, and the one that
pruning has left, of which only the last of all columns is still there. Waiting sales are few against all: those between the watermark and their batch's end.
Only the batches' 12 largest times and a count go to the driver.

Defined cases: null valid_at is ignored, and equal changes count once; null sold_at is emitted at once, without a version; a sale without client has none, and such a
change is a version of no sale; repeated sales are rows of their own; versions of one client, time and change_id are ordered by op and balance, null first; null arrived_at is the last batch, days before the
first batch belong to that; null balance gives null cents; empty batches and tables run like others; extra columns, whatever their
names, are ignored. Times are compared in microseconds; watermarks are in whole milliseconds, cut down, and lie between 1970 (before which they count as minus infinity) and the end of 2261.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import materialize, release, settings, shared_root, ship

BATCHES = 12
FIRST_DAY, DAYS = 19723, 152
SLOT_ROWS = 1 << 16
#: 2262-01-01, the event time after which nothing waits; pandas' times end in that year.
END_MS = 9_214_646_400_000

VERSION, SALE, LATE, TICK = range(4)
HAS_ID, HAS_CLIENT, HAS_TIME, HAS_CENTS = 1, 2, 4, 8
FED = "kind int, has int, uid bigint, id bigint, client bigint, at bigint, op string, cents bigint, wide boolean, bucket bigint, grid_row int, grid_column int, peak timestamp"
STATE = "versions binary, waiting binary"
VERSIONS = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("has", pa.int32()), ("op", pa.string()), ("cents", pa.int64()), ("pinned", pa.bool_())])
WAITING = pa.schema([("client", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("has", pa.int32()), ("uid", pa.int64()), ("wide", pa.bool_())])
#: What a slot says: its last version since pruning (of all, where the slot is the client's only one) and, of wide clients, the one left by pruning.
SAID = "rec string, id bigint, uid bigint, wide boolean, at bigint, held bigint, v_at bigint, v_id bigint, v_op string, v_cents bigint, p_at bigint, p_id bigint, p_op string, p_cents bigint"

#: One micro-batch a start; the state keeps what a restart needs.
STREAMING = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def _packed(frame: pd.DataFrame, schema: pa.Schema) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_pandas(frame[schema.names], schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None, schema: pa.Schema) -> pd.DataFrame:
    return (pa.ipc.open_stream(data).read_all() if data else schema.empty_table()).to_pandas()


def _sorted(versions: pd.DataFrame) -> pd.DataFrame:
    """By client, time and change, null first; equal ones by op and cents."""
    op = versions["op"]
    order = np.lexsort((versions["cents"], (versions["has"] & HAS_CENTS) > 0, op.fillna(""), op.notna(), versions["id"], (versions["has"] & HAS_ID) > 0, versions["at"], versions["client"]))
    return versions.iloc[order].reset_index(drop=True)


def last_up_to(versions: pd.DataFrame, client: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of each client's last version up to a time among sorted versions, or -1."""
    if not len(versions):
        return np.full(len(client), -1)
    clients, code = np.unique(versions["client"].to_numpy(), return_inverse=True)
    times = np.unique(versions["at"].to_numpy())
    key = code * (len(times) + 1) + np.searchsorted(times, versions["at"].to_numpy(), "right")
    mine = np.searchsorted(clients, client)
    known = (mine < len(clients)) & (clients[np.minimum(mine, len(clients) - 1)] == client)
    found = np.searchsorted(key, mine * (len(times) + 1) + np.searchsorted(times, at, "right"), "right") - 1
    return np.where(known & (found >= 0) & (code[found] == mine), found, -1)


def _counts(versions: pd.DataFrame, client: np.ndarray) -> np.ndarray:
    own = versions["client"].to_numpy()
    return np.searchsorted(own, client, "right") - np.searchsorted(own, client, "left")


def advance(key, fed: Iterator[pd.DataFrame], state: GroupState, last: bool) -> Iterator[pd.DataFrame]:
    """A slot's part of a batch: its new rows, or an expired timer, against its versions and waiting sales."""
    before = state.getOption or (None, None)
    versions, sales = _unpacked(before[0], VERSIONS), _unpacked(before[1], WAITING)
    if not state.hasTimedOut:
        rows = pd.concat(list(fed), ignore_index=True)
        late = rows[rows["kind"] == LATE]
        if len(late):
            yield said(late.assign(rec="late"))
        new = rows[rows["kind"] == VERSION].assign(pinned=False)
        versions = _sorted(pd.concat([versions, new[VERSIONS.names]], ignore_index=True).astype({"pinned": bool}))
        sales = pd.concat([sales, rows.loc[rows["kind"] == SALE, WAITING.names]], ignore_index=True).astype({"wide": bool})
    watermark = state.getCurrentWatermarkMs()
    ready = ((sales["has"] & HAS_TIME) == 0) | last
    if watermark > 0:
        ready |= sales["at"] < watermark * 1000
    if ready.any():
        yield emitted(versions, sales[ready])
    sales = sales[~ready]
    if watermark > 0 and len(versions):
        versions = pruned(versions, watermark * 1000)
    if len(versions) or len(sales):
        state.update((_packed(versions, VERSIONS), _packed(sales, WAITING)))
    elif state.exists:
        state.remove()
    # A timer expires once the watermark is above it: a sale must be below the watermark, a version at it or below.
    fresh = versions.loc[~versions["pinned"], "at"]
    events = [*([sales["at"].min() // 1000] if len(sales) else []), *([-(-fresh.min() // 1000) - 1] if len(fresh) else [])]
    if events:
        state.setTimeoutTimestamp(int(max(min(*events, END_MS - 1), watermark, 1)))


def emitted(versions: pd.DataFrame, sales: pd.DataFrame) -> pd.DataFrame:
    """SAID of sales that wait no longer."""
    sales = sales.reset_index(drop=True)
    client, at, wide = sales["client"].to_numpy(), sales["at"].to_numpy(), sales["wide"].to_numpy()
    asks = ((sales["has"] & HAS_CLIENT) > 0).to_numpy()
    dated = asks & ((sales["has"] & HAS_TIME) > 0).to_numpy()
    fresh, pinned = (versions[x].reset_index(drop=True) for x in (~versions["pinned"], versions["pinned"]))
    out = sales.assign(rec="sale", held=np.where(asks, np.where(wide, _counts(fresh, client), _counts(versions, client)), 0))
    for part, prefix, rows in ((versions, "v", dated & ~wide), (fresh, "v", dated & wide), (pinned, "p", asks & wide)):
        if not rows.any():
            continue
        found = last_up_to(part, client[rows], at[rows] if prefix == "v" else np.full(rows.sum(), np.iinfo(np.int64).max))
        where, found = np.flatnonzero(rows)[found >= 0], found[found >= 0]
        for name, flag in (("at", 0), ("id", HAS_ID), ("op", 0), ("cents", HAS_CENTS)):
            column = f"{prefix}_{name}"
            if column not in out:
                out[column] = None if name == "op" else pd.array([pd.NA] * len(out), "Int64")
            value = part[name].to_numpy()[found]
            known = (part["has"].to_numpy()[found] & flag) > 0 if flag else np.ones(len(found), bool)
            out.loc[where[known], column] = value[known]
    return said(out)


def pruned(versions: pd.DataFrame, horizon: int) -> pd.DataFrame:
    """Sorted versions without those up to the horizon that aren't their client's last of these; what stays of these is pinned."""
    old = versions["at"] <= horizon
    last = old & ~versions["client"].where(old).duplicated(keep="last")
    return versions[~old | last].assign(pinned=last[~old | last]).reset_index(drop=True)


def said(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows as SAID has them."""
    out = {}
    for name, kind in (x.split() for x in SAID.split(", ")):
        column = rows[name] if name in rows else pd.Series([None] * len(rows), rows.index, object)
        if kind == "bigint":
            column = column.astype("Int64")
            if name == "id":
                column = column.mask((rows["has"] & HAS_ID) == 0)
        elif kind == "boolean":
            column = column.astype(bool)
        out[name] = column
    return pd.DataFrame(out)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp, by its own clock where it has no zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(name)


def batch_of(day: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BATCHES - 1), F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


def day_of(at: Column) -> Column:
    return F.floor(at / 86_400_000_000)


@dataclass
class Peaks:
    """A table's largest time in microseconds by batch."""

    by_batch: dict[int, int | None]

    @classmethod
    def of(cls, rows: DataFrame) -> Peaks:
        return cls({r["batch"]: r["most"] for r in rows.groupBy("batch").agg(F.max("at").alias("most")).collect()})  # a row a batch

    def up_to(self, batch: int) -> int | None:
        """The largest time of the batches up to this one."""
        return max((at for k, at in self.by_batch.items() if k <= batch and at is not None), default=None)

    def column(self, lag: int) -> Column:
        """By batch: the largest time up to ``lag`` batches before it."""
        known = {k: self.up_to(k - lag) for k in range(BATCHES)}
        return F.element_at(F.create_map(*(F.lit(x) for k, at in known.items() if at is not None for x in (k, at))), F.col("batch")) if any(at is not None for at in known.values()) else F.lit(None).cast("bigint")


def _has(**flags: Column) -> Column:
    """The sum of the flags whose columns aren't null."""
    bits = {"id": HAS_ID, "client": HAS_CLIENT, "at": HAS_TIME, "cents": HAS_CENTS}
    return sum((F.when(column.isNotNull(), F.lit(bits[name])).otherwise(F.lit(0)) for name, column in flags.items()), F.lit(0))


def _fed(rows: DataFrame, peaks: Peaks, kind: Column) -> DataFrame:
    """Rows (batch, id, client, at, and what else the table has) as FED has them, numbers without nulls."""
    has = _has(**{c: F.col(c) for c in ("id", "client", "at", "cents") if c in rows.columns})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in rows.columns else F.lit(0).cast("bigint")
    peak = F.when(F.col("batch") >= BATCHES - 1, F.lit(END_MS * 1000)).otherwise(F.least(F.greatest(F.coalesce(peaks.column(0), F.lit(0)), F.lit(0)), F.lit(END_MS * 1000 - 1000)))
    peak = F.when(kind == TICK, F.timestamp_micros(peak))
    op = F.col("op").cast("string") if "op" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        "batch", kind.cast("int").alias("kind"), has.cast("int").alias("has"), zero("uid").alias("uid"), zero("id").alias("id"), zero("client").alias("client"), zero("at").alias("at"), op.alias("op"), zero("cents").alias("cents"),
        (F.col("side") > 1).alias("wide"), F.col("bucket").cast("bigint").alias("bucket"), F.col("grid_row").cast("int").alias("grid_row"), F.col("grid_column").cast("int").alias("grid_column"), peak.alias("peak"),
    )


def _ticks(spark: SparkSession, peaks: Peaks, batches: int) -> DataFrame:
    """A row for each batch, so that none is empty; its event time becomes the table's watermark."""
    rows = spark.range(batches).select(F.col("id").cast("int").alias("batch"), F.lit(1).alias("side"), *(F.lit(0).alias(c) for c in ("bucket", "grid_row", "grid_column")))
    return _fed(rows, peaks, F.lit(TICK))


def _cut(spark: SparkSession, sales: DataFrame, changes: DataFrame, folder: str) -> None:
    """Write both tables by batch, each row with its slot, and a tick for each batch."""
    changed = changes.select("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance").where(F.col("valid_at").isNotNull())
    sold = sales.select(F.monotonically_increasing_id().alias("uid"), F.col("sale_id").cast("bigint").alias("id"), F.col("client_id").cast("bigint").alias("client"), micros(sales, "sold_at").alias("at"), batch_of(day_of(micros(sales, "arrived_at"))).alias("batch"))
    shift = F.crc32(F.col("change_id").cast("string").cast("binary")) % 4
    at = micros(changes, "valid_at")
    batch = batch_of(day_of(at) + F.coalesce(shift, F.lit(0)))
    rows = changed.distinct().select(F.col("change_id").cast("bigint").alias("id"), F.col("client_id").cast("bigint").alias("client"), "op", at.alias("at"), F.floor(100 * F.col("balance") + 0.5).cast("bigint").alias("cents"), batch.alias("batch"))
    sale_peaks, change_peaks = Peaks.of(sold), Peaks.of(changed.select(at.alias("at"), batch.alias("batch")))
    sizes = sold.select("client").unionAll(changed.select(F.col("client_id").cast("bigint"))).groupBy("client").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = F.lit(-(-total // SLOT_ROWS) or 1)
    wide = sizes.where(F.col("client").isNotNull() & (F.col("n") > SLOT_ROWS)).select("client", F.ceil(F.sqrt(F.col("n") / SLOT_ROWS)).cast("int").alias("side"))
    wide = materialize(wide, "wide-clients")  # few and of a known size: Spark broadcasts them where they are small enough
    late = F.col("at") < change_peaks.column(1)
    alone = F.col("client").isNull() | F.coalesce(F.col("late"), F.lit(False))  # asks no version, or isn't one
    bucket = F.when(alone, F.pmod(F.xxhash64("id", "at"), buckets)).when(F.col("side") > 1, F.xxhash64("client")).otherwise(F.pmod(F.xxhash64("client"), buckets))

    def dealt(df: DataFrame, name: str, by: Column, along: str, across: str) -> None:
        side = F.when(alone, 1).otherwise(F.coalesce("side", F.lit(1)))
        out = df.join(wide, "client", "left").withColumn("side", side).withColumn("bucket", bucket)
        out = out.withColumn(along, F.pmod(by, F.col("side"))).withColumn(across, F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
        peaks, kind, batches = (sale_peaks, F.lit(SALE), BATCHES + 1) if name == "sales" else (change_peaks, F.when(F.col("late"), LATE).otherwise(VERSION), BATCHES)
        out = _fed(out, peaks, kind).unionByName(_ticks(spark, peaks, batches))
        out.hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{folder}/cut/{name}")

    dealt(sold.withColumn("late", F.lit(False)), "sales", F.xxhash64("uid"), "grid_row", "grid_column")
    dealt(rows.withColumn("late", F.coalesce(late, F.lit(False))).where("late or client is not null"), "changes", F.xxhash64("id", "at"), "grid_column", "grid_row")
    release(wide)


def _moved(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path(source)):
        files.mkdirs(path(target).getParent())
        if not files.rename(path(source), path(target)):
            raise OSError(f"{source} can't be moved to {target}")


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stream(spark: SparkSession, folder: str, last: bool) -> DataFrame:
    """SAID for what arrives in the folders of fed rows."""
    tables = [spark.readStream.schema(FED).option("recursiveFileLookup", "true").parquet(f"{folder}/fed/{name}").withWatermark("peak", "0 seconds") for name in ("sales", "changes")]
    slots = tables[0].unionByName(tables[1]).groupBy("bucket", "grid_row", "grid_column")
    return slots.applyInPandasWithState(functools.partial(advance, last=last), SAID, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def enrich(sales: DataFrame, changes: DataFrame) -> DataFrame:
    """rec, id, batch, n_held, change_id, balance_cents and op of every sale and every late change; valid_at, in microseconds, is that of the version."""
    spark = sales.sparkSession
    ship(spark)
    folder = f"{shared_root(spark)}/sievework/enrichment-{uuid.uuid4().hex}"
    _cut(spark, sales, changes, folder)
    with settings(spark, STREAMING):
        for batch in range(BATCHES + 1):
            for name in ("sales", "changes"):
                _moved(spark, f"{folder}/cut/{name}/batch={batch}", f"{folder}/fed/{name}/{batch}")
            out = stream(spark, folder, batch == BATCHES).withColumn("batch", F.lit(batch).cast("bigint"))
            query = out.writeStream.format("parquet").option("path", f"{folder}/said").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    for part in ("cut", "fed", "checkpoint"):
        _deleted(spark, f"{folder}/{part}")
    return _told(spark.read.schema(f"{SAID}, batch bigint").parquet(f"{folder}/said"))


def _told(said_: DataFrame) -> DataFrame:
    """One row for each sale of what its slots have said, and the late changes."""
    version = lambda p: F.struct(F.col(f"{p}_at").alias("at"), F.col(f"{p}_id").alias("id"), F.col(f"{p}_op").alias("op"), F.col(f"{p}_cents").alias("cents"))
    asked = said_.where("wide").select("rec", "id", "uid", "batch", "at", "held", *(F.when(F.col(f"{p}_at").isNotNull(), version(p)).alias(p) for p in "vp"))
    whole = asked.groupBy("rec", "id", "uid", "batch", "at").agg(F.sum("held").alias("held"), F.max("v").alias("v"), F.max("p").alias("p"))
    valid = F.when(F.col("p.at") <= F.col("at"), F.col("p"))
    whole = whole.select("rec", "id", "batch", (F.col("held") + F.col("p").isNotNull().cast("int")).alias("n_held"), F.greatest("v", valid).alias("v"))
    single = said_.where("not wide").select("rec", "id", "batch", F.col("held").alias("n_held"), version("v").alias("v"))
    return single.unionByName(whole).select("rec", "id", "batch", "n_held", F.col("v.id").alias("change_id"), F.col("v.cents").alias("balance_cents"), F.col("v.op").alias("op"), F.col("v.at").alias("version_at"))


def op13_enrichment(spark, sf_dir: str) -> DataFrame:
    """All ``sales`` with the versions of ``client_changes`` that were held when they were emitted, and the late changes."""
    return enrich(spark.read.parquet(f"{sf_dir}/sales.parquet"), spark.read.parquet(f"{sf_dir}/client_changes.parquet"))


OP13_SQL = r"""
WITH changes AS (
  SELECT DISTINCT change_id, client_id, seq, op, valid_at, source, segment, city, balance,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(change_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM client_changes WHERE valid_at IS NOT NULL
),
arrived AS (
  SELECT change_id AS id, client_id AS client, op, valid_at AS moment, CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents,
         CAST(greatest(0, least(11, floor((floor(epoch(valid_at) / 86400) + CASE WHEN change_id IS NULL THEN 0 ELSE (xor(crc, 4294967295) % 4) END - 19723) * 12 / 152))) AS BIGINT) AS batch
  FROM changes
),
sold AS (
  SELECT row_number() OVER () AS uid, sale_id AS id, client_id AS client, sold_at AS moment,
         CAST(greatest(0, least(11, floor((floor(epoch(arrived_at) / 86400) - 19723) * 12 / 152))) AS BIGINT) AS batch
  FROM sales
),
peaks AS (
  SELECT k, (SELECT max(moment) FROM arrived WHERE batch < k) AS changed, (SELECT max(moment) FROM sold WHERE batch < k) AS bought FROM range(13) r(k)
),
horizons AS (SELECT *, CASE WHEN changed IS NOT NULL AND bought IS NOT NULL THEN least(changed, bought) END AS h FROM peaks),
versions AS (SELECT a.*, row_number() OVER () AS v FROM arrived a JOIN horizons ON k = batch WHERE NOT coalesce(moment < changed, false)),
released AS (
  SELECT s.*, coalesce((SELECT min(k) FROM horizons WHERE k >= s.batch AND k < 12 AND (s.moment IS NULL OR s.moment < h)), 12) AS out FROM sold s
),
-- pruned after batch k: all that had come by then, up to its H, but each client's last
kept AS (
  SELECT v, k FROM (
    SELECT v, k, moment > h OR h IS NULL AS above, row_number() OVER (PARTITION BY client, k, coalesce(moment > h, true) ORDER BY moment DESC, id DESC NULLS LAST, op DESC NULLS LAST, cents DESC NULLS LAST) AS n
    FROM versions JOIN horizons ON k >= batch AND k < 12
  ) WHERE above OR n = 1
),
held AS (SELECT k + 1 AS out, v FROM kept UNION SELECT batch, v FROM versions),
pairs AS (
  SELECT s.uid, w.*, row_number() OVER (PARTITION BY s.uid ORDER BY w.moment <= s.moment DESC NULLS LAST, w.moment DESC, w.id DESC NULLS LAST, w.op DESC NULLS LAST, w.cents DESC NULLS LAST) AS n, count(*) OVER (PARTITION BY s.uid) AS n_held,
         coalesce(w.moment <= s.moment, false) AS fits
  FROM released s JOIN versions w USING (client) JOIN held h ON h.v = w.v AND h.out = s.out
)
SELECT 'sale' AS rec, s.id, s.out AS batch, CAST(coalesce(p.n_held, 0) AS BIGINT) AS n_held,
       CASE WHEN fits THEN p.id END AS change_id, CASE WHEN fits THEN p.cents END AS balance_cents, CASE WHEN fits THEN p.op END AS op, CASE WHEN fits THEN epoch_us(p.moment) END AS version_at
FROM released s LEFT JOIN pairs p ON p.uid = s.uid AND p.n = 1
UNION ALL
SELECT 'late', id, batch, NULL, NULL, NULL, NULL, NULL FROM arrived JOIN horizons ON k = batch WHERE moment < changed
"""
