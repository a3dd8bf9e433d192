"""The change applier against a row-by-row simulation."""

import datetime as dt
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillon.llm import change_applier as C
from quillon.llm.queries import cents

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
EPOCH = dt.date(1970, 1, 1)


def simulate(rows, patience=5):
    """Every rule as it is told, one row after another."""
    rows = list(dict.fromkeys(rows))
    places = defaultdict(set)
    for r in rows:
        places[r[1]].add((r[2] is not None, r[2] or 0))
    rank = {c: {p: i + 1 for i, p in enumerate(sorted(s))} for c, s in places.items()}
    batches = defaultdict(list)
    for r in rows:
        if r[0] is None or r[4] is None:
            continue
        h = zlib.crc32(str(r[0]).encode())
        if h % 11 == 0:
            continue
        day = (r[4].date() - EPOCH).days + 2 * (h % 4)
        batches[min(8, max(1, 1 + math.floor((day - 19723) * 8 / 160)))].append((day, r[0], rank[r[1]][(r[2] is not None, r[2] or 0)], r))
    following, held, state, out, final = defaultdict(lambda: 1), defaultdict(dict), {}, [], {}

    def apply_ready(c, batch, missed):
        while following[c] in held[c]:
            day, change, n, r = held[c].pop(following[c])
            city, balance = state.get(c, (None, None))
            if r[3] == "I":
                city, balance = r[7], r[8]
            elif r[3] == "U":
                city, balance = (city if r[7] is None else r[7]), (balance if r[8] is None else r[8])
            elif r[3] == "D":
                city = balance = None
            state[c] = city, balance
            following[c] += 1
            final[c] = len(out)
            out.append([change, c, "applied", batch, missed, city, None if balance is None or not math.isfinite(balance) else math.floor(100 * balance + 0.5), r[3]])
            missed = 0

    largest = -math.inf
    for b in range(1, 10):
        for c in list(held):
            while held[c] and (b == 9 or min(x[0] for x in held[c].values()) + patience <= largest):
                least = min(held[c])
                missed, following[c] = least - following[c], least
                apply_ready(c, b, missed)
        for day, change, n, r in sorted(batches[b], key=lambda x: x[:2]):
            c = r[1]
            if n < following[c] or n in held[c]:
                out.append([change, c, "rejected", b, 0, None, None, r[3]])
            else:
                held[c][n] = (day, change, n, r)
                apply_ready(c, b, 0)
        largest = max([largest, *(x[0] for x in batches[b])])
    return [(*o[:7], o[2] == "applied" and final[o[1]] == i and o[7] != "D") for i, o in enumerate(out)]


def table(rng, n, clients):
    rows = []
    for i in range(n):
        c = rng.choice([7] * 6 + list(range(clients)) + [None])
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 130))
        seq = rng.choice([(at - dt.datetime(2024, 1, 1)).days // 3 + rng.randint(0, 2), rng.randrange(60), None if i % 50 == 0 else 5])
        rows.append((None if i % 97 == 0 else i * 13, c, seq, rng.choice(["I", "U", "U", "U", "D", "X", None]), None if i % 41 == 0 else at, "s", None, rng.choice(["A", "B", "Ö", "", None]), rng.choice([1.005, -2.5, 0.0, None, float("inf"), 1e6])))
    return rows + rows[::9]


def got(df):
    return sorted(((*r[:-1], r[-1]) for r in df.select("change_id", "client_id", "status", "batch", "missed", "city", cents("balance"), "current").collect()), key=str)


def test_changes_follow_the_rules_row_by_row(spark):
    rows = table(random.Random(3), 900, 40)
    more = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", `next` string").withColumn("a.b", F.lit(1)).withColumn("bucket", F.lit(2))
    assert got(C.apply_changes(more, bucket_rows=200)) == sorted(simulate(rows), key=str)


def test_no_changes_give_no_rows(spark):
    assert C.apply_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbers_go_over_ranges(spark):
    """No window gathers the changes of one client."""
    rows = spark.createDataFrame(table(random.Random(4), 300, 5), SCHEMA)
    plan = C.sequenced(rows)._jdf.queryExecution().toString()
    assert "dense_rank" not in plan


def test_ticks_equal_the_simulation_at_every_size():
    """The vectorised tick alone, over a few thousand random clients and many ticks, against one client at a time."""
    rng = random.Random(8)
    columns = [*C.KEY, "n", *C.Applier.HELD]
    empty = pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
    held, clients = empty, pd.DataFrame({c: pd.Series([], dtype="int64") for c in (*C.KEY, "next", "city", "balance")})
    at, kept, want, have = defaultdict(lambda: 1), defaultdict(dict), set(), set()
    for tick in range(1, 8):
        largest = (tick - 1) * 10
        new = [(0, rng.randrange(300), rng.randrange(1, 12), k * 10 + tick, tick * 10 - rng.randrange(10), "U", None, 0.0, 0, 0) for k in range(400)]
        for c in list(kept):
            while kept[c] and (tick == 7 or min(kept[c].values()) + C.PATIENCE <= largest):
                at[c] = min(kept[c])
                while at[c] in kept[c]:
                    kept[c].pop(at[c])
                    want.add((c, at[c], tick))
                    at[c] += 1
        for r in sorted(new, key=lambda r: (r[4], r[3])):
            c, n = r[1], r[2]
            if n >= at[c] and n not in kept[c]:
                kept[c][n] = r[4]
            while at[c] in kept[c]:
                kept[c].pop(at[c])
                want.add((c, at[c], tick))
                at[c] += 1
        done, _, waiting, moved = C.advance(clients, held, pd.DataFrame(new, columns=columns), largest, tick == 7)
        have |= {(int(c), int(n), tick) for c, n in zip(done["client"], done["n"], strict=True)}
        keys = set(zip(done["client"], done["n"], strict=True))
        left = held[[k not in keys for k in zip(held["client"], held["n"], strict=True)]]
        held = pd.concat([left, waiting[columns]], ignore_index=True)
        clients = pd.concat([clients[~clients["client"].isin(moved["client"])], moved], ignore_index=True)
    assert have == want and np.all(held["n"] > 0)
