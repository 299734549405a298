"""What connections carry from one command to the next, and the settings of a server."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import glob_match


def session_state(ops: DataFrame) -> DataFrame:
    """SELECT, READONLY, READWRITE, MULTI, RESET and QUIT: the state in which each command of a log runs.

    ``ops`` is (conn, seq, cmd, arg).  Adds ``session_db`` (the last one selected, 0 at first and after RESET),
    ``readonly``, ``queued`` (between MULTI and EXEC or DISCARD) and ``closed`` (after QUIT), all as they are before
    the command.  One window by connection; a state is the last command that set it.
    """
    cmd = F.upper("cmd")
    before = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

    def latest(marks, otherwise):
        return F.coalesce(F.last(marks, ignorenulls=True).over(before), F.lit(otherwise))

    db = F.when(cmd == "SELECT", F.col("arg").try_cast("int")).when(cmd == "RESET", F.lit(0))
    readonly = F.when(cmd == "READONLY", F.lit(True)).when(cmd.isin("READWRITE", "RESET"), F.lit(False))
    queued = F.when(cmd == "MULTI", F.lit(True)).when(cmd.isin("EXEC", "DISCARD", "RESET"), F.lit(False))
    return ops.withColumns(
        {
            "session_db": latest(db, 0),
            "readonly": latest(readonly, False),
            "queued": latest(queued, False),
            "closed": latest(F.when(cmd == "QUIT", F.lit(True)), False),
        }
    )


def session_replies(ops: DataFrame, databases: int = 16) -> DataFrame:
    """Replies to PING, ECHO, SELECT, READONLY, READWRITE, RESET and QUIT; null for other commands and after QUIT.

    A command that is queued is answered with ``QUEUED``; a database out of range is an error.
    """
    cmd, arg, n = F.upper("cmd"), F.col("arg"), F.col("arg").try_cast("int")
    known = cmd.isin("PING", "ECHO", "SELECT", "READONLY", "READWRITE")
    reply = (
        F.when(F.col("closed"), F.lit(None).cast("string"))
        .when(cmd == "RESET", "RESET")
        .when(cmd == "QUIT", "OK")
        .when(F.col("queued") & known, "QUEUED")
        .when(cmd == "PING", F.coalesce(arg, F.lit("PONG")))
        .when(cmd == "ECHO", arg)
        .when((cmd == "SELECT") & n.isNull(), "ERR value is not an integer or out of range")
        .when((cmd == "SELECT") & ~n.between(0, databases - 1), "ERR DB index is out of range")
        .when(cmd.isin("SELECT", "READONLY", "READWRITE"), "OK")
    )
    return session_state(ops).withColumn("reply", reply)


def config_get(settings: DataFrame, *patterns: str) -> DataFrame:
    """CONFIG GET: settings (name, value) whose name matches any of the patterns, whatever their case."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | glob_match(F.lower("name"), p.lower())
    return settings.where(hit)


def config_set(settings: DataFrame, writes: DataFrame) -> DataFrame:
    """CONFIG SET of a log (seq, name, value): the last write of a setting counts.

    A command (all rows of a ``seq``) that names an unknown setting changes nothing.
    """
    known = settings.select("name").withColumn("known", F.lit(True))
    marked = writes.withColumn("name", F.lower("name")).join(known, "name", "left")
    good = marked.groupBy("seq").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("ok")).where("ok").select("seq")
    last = marked.join(good, "seq", "left_semi").groupBy("name").agg(F.max_by("value", "seq").alias("new"))
    return settings.join(last, "name", "left").select("name", F.coalesce("new", "value").alias("value"))
