"""Folds of an operation log into tables, transactions and optimistic locks."""

from __future__ import annotations

import re
from bisect import insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.sources.model import KEY


#: An integer as it may be stored; also what an argument must look like.
_CANONICAL = re.compile(r"0|-?[1-9][0-9]*|-0")


def ordered_strings(ops: DataFrame) -> DataFrame:
    """Conditional string commands of a log, applied to each key in the order of ``seq``.

    ``ops`` has (db, key, seq, cmd, arg): SET, SETNX, SETXX, GETSET, GETDEL, APPEND, INCRBY, DECRBY, DEL,
    DELIFEQ.  Returns each command with its ``reply`` and ``err`` and the ``value`` after it.  Such
    commands don't commute, so a key's commands are folded in a row, in batches of whole keys; keys that
    only overwrite or only count should use the aggregates of ``strings`` instead.
    """
    schema = "db int, key string, seq bigint, cmd string, reply string, err string, value string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value, rows = None, []
        for r in pdf.sort_values("seq").itertuples(index=False):
            reply, err, cmd, arg = None, None, r.cmd, r.arg
            if cmd in ("SET", "SETNX", "SETXX"):
                go = cmd == "SET" or (value is None) == (cmd == "SETNX")
                reply, value = (("OK" if cmd != "SETNX" else "1"), arg) if go else ("0" if cmd == "SETNX" else None, value)
            elif cmd == "GETSET":
                reply, value = value, arg
            elif cmd == "GETDEL":
                reply, value = value, None
            elif cmd == "APPEND":
                value = (value or "") + arg
                reply = str(len(value.encode()))
            elif cmd in ("INCRBY", "DECRBY"):
                old = value if value is not None else "0"
                canonical = _CANONICAL.fullmatch(old) and -(2**63) <= int(old) < 2**63
                step = int(arg) if _CANONICAL.fullmatch(arg) and -(2**63) <= int(arg) < 2**63 else None
                n = int(old) + step * (1 if cmd == "INCRBY" else -1) if canonical and step is not None else None
                if n is None:
                    err = "ERR value is not an integer or out of range"
                elif not -(2**63) <= n < 2**63:
                    err = "ERR increment or decrement would overflow"
                else:
                    reply = value = str(n)
            elif cmd == "DEL":
                reply, value = str(int(value is not None)), None
            elif cmd == "DELIFEQ":
                hit = value is not None and value == arg
                reply, value = str(int(hit)), None if hit else value
            else:
                err = f"ERR unknown command '{cmd}'"
            rows.append((r.db, r.key, r.seq, cmd, reply, err, value))
        return pd.DataFrame(rows, columns=["db", "key", "seq", "cmd", "reply", "err", "value"])

    return ops.groupBy(*KEY).applyInPandas(run, schema)


def exec_transactions(ops: DataFrame, watches: DataFrame | None = None) -> DataFrame:
    """MULTI and EXEC: (txn, seq, ...) rows with the fate of their transaction.

    A transaction with an error from queueing (``queue_err``) or a watched key that changed is ``aborted``;
    else all its commands run, at one time (``now``), and an error of one doesn't stop the others.  With a column
    ``discard``, a transaction that has it true was given up by DISCARD: none of its commands run.
    """
    if "discard" in ops.columns:
        given_up = ops.groupBy("txn").agg(F.max(F.col("discard").cast("int")).alias("gone"))
        fates = exec_transactions(ops.drop("discard"), watches).join(given_up, "txn")
        return fates.withColumn("fate", F.when(F.col("gone") == 1, "discarded").otherwise(F.col("fate"))).drop("gone")
    marks = ops.groupBy("txn").agg(
        F.count(F.lit(1)).alias("n_commands"), F.max("ts").alias("now"), F.max(F.col("queue_err").cast("int")).alias("bad")
    )
    if watches is not None:
        dirty = watches.where("dirty").select("txn").distinct().withColumn("dirty", F.lit(1))
        marks = marks.join(dirty, "txn", "left")
    else:
        marks = marks.withColumn("dirty", F.lit(None).cast("int"))
    fate = F.when(F.col("bad") == 1, "EXECABORT").when(F.col("dirty") == 1, "aborted").otherwise("done")
    return marks.select("txn", "n_commands", "now", fate.alias("fate"))


def watch_dirty(watches: DataFrame, writes: DataFrame) -> DataFrame:
    """WATCH: (txn, db, key, seq, exec_seq) is dirty if a write of the key lies between watch and EXEC.

    With a column ``unwatch_seq``, watches that UNWATCH forgot between the two are dropped.
    """
    if "unwatch_seq" in watches.columns:
        forgot = F.col("unwatch_seq").between(F.col("seq"), F.col("exec_seq"))
        watches = watches.where(~F.coalesce(forgot, F.lit(False))).drop("unwatch_seq")
    w = writes.select(*KEY, F.col("seq").alias("write_seq"))
    hit = (F.col("write_seq") > F.col("seq")) & (F.col("write_seq") < F.col("exec_seq"))
    got = watches.join(w, KEY, "left").groupBy("txn", *KEY)
    return got.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("dirty"))


def invalidations(reads: DataFrame, writes: DataFrame, prefixes: tuple[str, ...] = (), noloop: bool = False, mode: str = "default") -> DataFrame:
    """CLIENT TRACKING: (conn, key, read seq) with the first later write of the key.

    With prefixes, connections hear of every write under them instead (BCAST).  Under ``optin`` only reads with
    ``caching`` true are remembered, under ``optout`` all but those with ``caching`` false.  A column ``redirect``
    of the reads names the connection that is told instead.
    """
    w = writes.select("db", "key", F.col("seq").alias("write_seq"), F.col("conn").alias("writer"))
    if prefixes:
        under = F.lit(False)
        for p in prefixes:
            under = under | F.col("key").startswith(p)
        return w.where(under)
    if mode != "default":
        reads = reads.where(F.col("caching").eqNullSafe(F.lit(True)) if mode == "optin" else ~F.col("caching").eqNullSafe(F.lit(False)))
    told = F.coalesce("redirect", "conn") if "redirect" in reads.columns else F.col("conn")
    log = reads.select(*KEY, "seq", "conn", told.alias("told"), F.lit(True).alias("is_read")).unionByName(
        w.select(*KEY, F.col("write_seq").alias("seq"), F.col("writer").alias("conn"), F.col("writer").alias("told"), F.lit(False).alias("is_read"))
    )
    # the first later write of a key is the next write in its own log: no join of reads with writes
    ahead = Window.partitionBy(*KEY).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(~F.col("is_read"), F.struct("seq", "conn")), ignorenulls=True).over(ahead)
    got = log.withColumn("w", nxt).where("is_read and w is not null")
    got = got.where("conn <> w.conn") if noloop else got
    return got.select(*KEY, F.col("told").alias("conn"), "seq", F.col("w.seq").alias("write_seq"), F.col("w.conn").alias("writer"))


def match_waiters(waits: DataFrame, pushes: DataFrame) -> DataFrame:
    """Blocking pops without deadlines in batch: the k-th waiter of a key gets its k-th element.

    ``waits`` is (db, key, conn, seq), ``pushes`` (db, key, seq, value); an element may be there already or
    follow; a waiter that gets none has nulls.  Waiters with deadlines need ``blocking``.
    """
    nth = lambda c: F.row_number().over(Window.partitionBy(*KEY).orderBy(c))
    a = waits.withColumn("k", nth("seq"))
    b = pushes.select(*KEY, F.col("seq").alias("push_seq"), "value").withColumn("k", nth("push_seq"))
    return a.join(b, [*KEY, "k"], "left")


def blocking(events: DataFrame, last: bool = False, count: int = 1) -> DataFrame:
    """BLPOP, BRPOP, BLMPOP, BZPOPMIN, BZPOPMAX and BZMPOP with deadlines, replayed key by key.

    ``events`` is (db, key, seq, kind, conn, deadline, place, value): a ``push`` puts ``value`` at ``place``
    (its order in the list, or its score), a ``wait`` takes up to ``count`` from the front, or from the back
    with ``last``, at once or when a push comes by ``deadline`` (a ``seq``; null waits forever).  Waiters are
    served first come, first served; pushes of one ``seq`` are one command.  Returns (db, key, seq, conn,
    push_seq, value, nth) of all that was handed out.  Who gets what depends on all that came before, so a
    key's events are folded together.
    """
    schema = "db int, key string, seq bigint, conn bigint, push_seq bigint, value string, nth int"
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, waiting, rows = [], deque(), []

        def serve(db, key, seq, conn):
            taken = items[-count:][::-1] if last else items[:count]
            if last:
                del items[len(items) - len(taken) :]
            else:
                del items[: len(taken)]
            rows.extend((db, key, seq, conn, at, value, nth) for nth, (_, at, value) in enumerate(taken))

        for seq, group in pdf.sort_values(["seq", "place"]).groupby("seq", sort=True):
            for r in group.itertuples(index=False):
                if r.kind == "push":
                    insort(items, (r.place, seq, r.value))
                elif items:
                    serve(r.db, r.key, seq, r.conn)
                else:
                    waiting.append((seq, r.db, r.key, r.conn, r.deadline))
            while items and waiting:
                began, db, key, conn, deadline = waiting.popleft()
                if pd.isna(deadline) or deadline >= seq:
                    serve(db, key, began, conn)
        return pd.DataFrame(rows, columns=columns)

    return events.groupBy(*KEY).applyInPandas(run, schema)


def blocking_move(events: DataFrame, target: str, from_left: bool, to_left: bool, existing: DataFrame | None = None) -> DataFrame:
    """BLMOVE and BRPOPLPUSH: the target list after all that waiters were handed has been pushed onto it."""
    from keyloom.operators.lists import push

    moved = blocking(events, last=not from_left)
    # an element is pushed when it is handed over: when the later of the waiter and the element came
    pushes = moved.select("db", F.lit(target).alias("key"), F.greatest("seq", "push_seq").alias("seq"), F.col("seq").alias("arg"), "value")
    return push(pushes, to_left, existing)
