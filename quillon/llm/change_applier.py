"""Sequenced change applier: a stateful stream that applies each client's changes in the order of their numbers.

Changes arrive out of order.  A bucket is a hash of clients and the key of one ``transformWithStateInPandas`` group;
each batch brings it its new rows and one tick, so that waiting ends even where nothing arrives.  Held changes are
entries of one map state by (client, number), clients of another.  A tick takes all clients of its bucket together:
one lexsort of held and new rows, first rows of each number, runs from where each client stands, and segmented scans
that carry city and balance along a client's rows.  No loop goes over clients or rows but where state is read and
written, and then only over entries that change.

Defined results: rows equal in all columns that count are one; rows without a time or an id vanish after numbering;
rows without a client form one client of their own; a missing ``seq`` comes before all others; an unknown or missing
``op`` is applied and changes nothing; a balance that is no number gives null cents; rows that tie on day and id follow
a hash of their columns.  Days before the first batch belong to it.  No rows give no rows.  Further columns are not read.

The unit that is not split is a client: its rows of one batch and its held rows meet in one task, as its order asks.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.llm.store import durable, remove, shared_folder
from quillon.operators.tokens import ranked

#: Columns that tell rows apart.
COLUMNS = ("change_id", "client_id", "seq", "op", "valid_at", "source", "segment", "city", "balance")
BATCHES, FIRST_DAY, DAYS = 8, 19723, 160
#: Days that a held change waits for those before it, counted against the largest day of earlier batches.
PATIENCE = 5
#: Rows of the whole input for each bucket; bounds what one tick reads, but for a client that is larger itself.
BUCKET_ROWS = 20_000
NEVER = -(1 << 31)
STATE = "spark.sql.streaming.stateStore."
#: State lies in RocksDB; a start takes one batch, so a store is closed, and its local files go, when it has committed.
SETTINGS = {f"{STATE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{STATE}unloadOnCommit": "true"}

#: ``absent`` marks the client of rows without a client_id, ``known`` a balance that is not null; n = 0 is a tick,
#: whose day is the largest day of earlier batches and whose change_id tells whether it is the last one.
FED = "bucket int, absent int, client long, n long, change_id long, day int, batch int, op string, city string, balance double, known int, tie long"
OUT = "absent int, client long, n long, change_id long, op string, applied boolean, batch int, missed long, city string, balance double"
KEY = ["absent", "client"]


def sequenced(changes: DataFrame) -> DataFrame:
    """Distinct changes with n, the dense rank of seq among those of their client, and the day and batch in which they
    arrive.  Ranks go over ranges, so that a client with very many changes is numbered by many tasks."""
    rows = changes.select(*COLUMNS).distinct().withColumns({
        "absent": F.col("client_id").isNull().cast("int"), "client": F.coalesce(F.col("client_id").cast("long"), F.lit(0)),
        "placed": F.col("seq").isNotNull().cast("int"), "place": F.coalesce(F.col("seq").cast("long"), F.lit(0)),
    })
    spot = ["placed", "place"]
    rows = durable(rows)
    places = ranked(rows.select(*KEY, *spot).distinct(), KEY, spot, "n")
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    day = (F.unix_date(F.to_date("valid_at")) + 2 * (h % 4)).cast("int")
    arriving = rows.withColumn("day", day).where(F.col("day").isNotNull() & (h % 11 != 0))
    batch = F.least(F.lit(BATCHES), F.greatest(F.lit(1), 1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / DAYS))).cast("int")
    return arriving.join(places, [*KEY, *spot]).select(
        *KEY, F.col("n").cast("long").alias("n"), F.col("change_id").cast("long").alias("change_id"), "day", batch.alias("batch"), "op", "city",
        F.coalesce(F.col("balance").cast("double"), F.lit(0.0)).alias("balance"), F.col("balance").isNotNull().cast("int").alias("known"),
        F.xxhash64(*COLUMNS).alias("tie"),
    )


def carried(setter: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the latest row at or before it that sets a value, within its segment; -1 where none does.
    ``first`` has the first row of each row's segment."""
    last = np.maximum.accumulate(np.where(setter, np.arange(len(setter)), -1))
    return np.where(last >= first, last, -1)


def segment_starts(code: np.ndarray) -> np.ndarray:
    """For each row of sorted codes the first row with its code."""
    new = np.r_[True, code[1:] != code[:-1]] if len(code) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(code)), 0)) if len(code) else np.zeros(0, int)


def advance(clients: pd.DataFrame, held: pd.DataFrame, new: pd.DataFrame, largest: int, last: bool) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """One tick of many clients: (applied, rejected, to hold, clients that moved).

    A client whose held rows have waited too long goes on to the last of these that has, which is where repeated jumps
    to its least held number end; from there, and from where the others stand, the run of numbers without a gap is applied.
    """
    rows = pd.concat([part.assign(fresh=k) for k, part in ((0, held), (1, new)) if len(part)] or [held.assign(fresh=0)], ignore_index=True)
    pairs = np.concatenate([clients[KEY].to_numpy(np.int64), rows[KEY].to_numpy(np.int64)])
    who, code = np.unique(pairs, axis=0, return_inverse=True)
    code = code.reshape(-1)
    known, code = code[: len(clients)], code[len(clients) :]
    following = np.ones(len(who), np.int64)
    following[known] = clients["next"].to_numpy()
    n, fresh, day = (rows[c].to_numpy(np.int64) for c in ("n", "fresh", "day"))
    due = (fresh == 0) & (last | (day + PATIENCE <= largest))
    reach = following.copy()
    np.maximum.at(reach, code[due], n[due] + 1)

    order = np.lexsort((rows["tie"].to_numpy(), rows["change_id"].to_numpy(), day, fresh, n, code))
    rows, code, n, fresh = rows.iloc[order].reset_index(drop=True), code[order], n[order], fresh[order]
    first = np.r_[True, (code[1:] != code[:-1]) | (n[1:] != n[:-1])] if len(n) else np.zeros(0, bool)
    pool = first & ((fresh == 0) | (n >= reach[code]))
    rejected = rows[~pool]
    rows, code, n, fresh = rows[pool].reset_index(drop=True), code[pool], n[pool], fresh[pool]

    start = segment_starts(code)
    behind = n < reach[code]
    passed = np.bincount(code, weights=behind, minlength=len(who)).astype(np.int64)
    at = np.arange(len(n)) - start - passed[code]
    done = behind | (n - reach[code] == at)
    waiting = rows[~done & (fresh == 1)]
    rows, code, n = rows[done].reset_index(drop=True), code[done], n[done]

    start = segment_starts(code)
    opens = start == np.arange(len(n))
    before = np.where(opens, following[code] - 1, np.r_[0, n[:-1]] if len(n) else n)
    rows["missed"] = n - before - 1
    op, city, sure = rows["op"].to_numpy(object), rows["city"].to_numpy(object), rows["known"].to_numpy() == 1
    was = {c: np.full(len(who), None, object) for c in ("city", "balance")}
    for c in was:
        was[c][known] = clients[c].to_numpy(object)
    given = np.where(sure, rows["balance"].to_numpy(object), None)
    for name, value in (("city", city), ("balance", given)):
        value = np.where(op == "D", None, value)
        from_row = carried((op == "I") | (op == "D") | ((op == "U") & ~pd.isna(value) if name == "city" else (op == "U") & sure), start)
        rows[name] = pd.Series(np.where(from_row >= 0, value[from_row], was[name][code]) if len(n) else value, dtype=object)
    ends = np.r_[code[1:] != code[:-1], True] if len(n) else np.zeros(0, bool)
    moved = rows.loc[ends, [*KEY, "city", "balance"]].assign(next=n[ends] + 1)
    return rows, rejected, waiting, moved


class Applier(StatefulProcessor):
    """The clients of one bucket."""

    HELD = ("change_id", "day", "op", "city", "balance", "known", "tie")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "absent int, client long, n long", "change_id long, day int, op string, city string, balance double, known int, tie long")
        self.clients = handle.getMapState("clients", "absent int, client long", "next long, city string, balance double, known int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fed = pd.concat(list(rows), ignore_index=True)
        tick = fed[fed["n"] == 0].iloc[0]
        held = pd.DataFrame([(*k, *v) for k, v in self.held.iterator()], columns=[*KEY, "n", *self.HELD])
        known = [(*k, v[0], v[1], v[2] if v[3] else None) for k, v in self.clients.iterator()]
        clients = pd.DataFrame(known, columns=[*KEY, "next", "city", "balance"])
        clients["balance"] = pd.Series([k[-1] for k in known], dtype=object)
        done, rejected, waiting, moved = advance(clients, held, fed[fed["n"] > 0], int(tick["day"]), bool(tick["change_id"]))
        text = lambda x: None if pd.isna(x) else x
        for r in done[done["fresh"] == 0][[*KEY, "n"]].itertuples(index=False):
            self.held.removeKey(tuple(map(int, r)))
        for a, c, n, change, day, op, city, balance, sure, tie in waiting[[*KEY, "n", *self.HELD]].itertuples(index=False):
            self.held.updateValue((int(a), int(c), int(n)), (int(change), int(day), text(op), text(city), float(balance), int(sure), int(tie)))
        for a, c, city, balance, following in moved[[*KEY, "city", "balance", "next"]].itertuples(index=False):
            self.clients.updateValue((int(a), int(c)), (int(following), text(city), 0.0 if balance is None else float(balance), int(balance is not None)))
        lost = rejected.assign(missed=0, city=None, balance=None)
        out = pd.concat([part.assign(applied=ok) for part, ok in ((done, True), (lost, False)) if len(part)] or [done.assign(applied=True)])
        yield out.assign(batch=int(tick["batch"]))[[c.split()[0] for c in OUT.split(", ")]]

    def close(self) -> None:
        pass


def fold(spark: SparkSession, top: str) -> None:
    """Starts the query on its one checkpoint, lets it take what was fed since, and ends it."""
    own = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(own)  # the planner's worker on the driver does not see files added to the session
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        fed = spark.readStream.schema(FED).parquet(f"{top}/in")
        out = fed.groupBy("bucket").transformWithStateInPandas(Applier(), OUT, "append", "none")
        sink = out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state")
        sink.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
        cloudpickle.unregister_pickle_by_value(own)


def apply_changes(changes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """change_id, client_id, n, op, status, batch, missed, city, balance and current of each change that arrives.

    Batches are written under the checkpoint folder and fed one after another; each starts the query anew, and one more
    start after the last lets all held changes go.  A start that is repeated after a failure finds what it had fed in the
    source's log and its results in the sink's, so nothing is applied twice.
    """
    spark = changes.sparkSession
    top = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    sequenced(changes).write.partitionBy("batch").parquet(f"{top}/staged")
    fields = [f for f in FED.split(", ") if not f.startswith("bucket ")]
    staged = spark.read.schema(", ".join(fields)).parquet(f"{top}/staged")
    days = {r["batch"]: (r["day"], r["n"]) for r in staged.groupBy("batch").agg(F.max("day").alias("day"), F.count("*").alias("n")).collect()}
    buckets = max(1, -(-sum(n for _, n in days.values()) // bucket_rows))
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int").alias("bucket")
    names = [f.split()[0] for f in fields]
    largest = NEVER
    for b in range(1, BATCHES + 2):
        blank = {"batch": b, "day": largest, "change_id": int(b > BATCHES)}
        numbers = {"int", "long", "double"}
        tick = [F.lit(blank.get(c, 0 if kind in numbers else None)).cast(kind).alias(c) for c, kind in map(str.split, fields)]
        ticks = spark.range(0, buckets, 1, -(-buckets // 100_000)).select(F.col("id").cast("int").alias("bucket"), *tick)
        staged.where(F.col("batch") == b).select(bucket, *names).union(ticks).write.mode("append").parquet(f"{top}/in")
        fold(spark, top)
        largest = max(largest, days.get(b, (NEVER, 0))[0])
    out = spark.read.schema(OUT).parquet(f"{top}/out")
    final = out.where("applied").groupBy(*KEY).agg(F.max("n").alias("n")).withColumn("final", F.lit(True))
    current = F.col("applied") & F.coalesce("final", F.lit(False)) & ~F.col("op").eqNullSafe("D")
    told = out.join(final, [*KEY, "n"], "left").select(
        "change_id", F.when(F.col("absent") == 0, F.col("client")).alias("client_id"), "n", "op",
        F.when(F.col("applied"), "applied").otherwise("rejected").alias("status"), "batch", "missed", "city", "balance", current.alias("current"),
    )
    told = durable(told)
    remove(spark, top)
    return told
