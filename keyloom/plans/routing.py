"""Keys of raw commands, and where they are routed to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import col, key_slot

#: Commands by where their keys stand; of any other command the first argument is the key.
PATTERNS = {
    "all": "DEL UNLINK EXISTS TOUCH MGET SINTER SUNION SDIFF PFCOUNT PFMERGE SINTERSTORE SUNIONSTORE SDIFFSTORE",
    "pairs": "MSET MSETNX",
    "two": "RENAME RENAMENX COPY SMOVE LMOVE RPOPLPUSH ZRANGESTORE",
    "after_operation": "BITOP",
    "counted": "ZUNION ZINTER ZDIFF ZINTERCARD SINTERCARD LMPOP ZMPOP",
    "counted_pairs": "MSETEX",
    "target_counted": "ZUNIONSTORE ZINTERSTORE ZDIFFSTORE",
    "second": "OBJECT",
    "sort": "SORT SORT_RO",
    "none": "PING ECHO MULTI EXEC DISCARD UNWATCH DBSIZE RANDOMKEY FLUSHALL FLUSHDB",
}


def command_keys(cmd, args) -> Column:
    """Keys among the arguments of a command (its name not included); none if it is malformed."""
    cmd, args = F.upper(col(cmd)), col(args)
    n = F.size(args)
    none = F.array().cast("array<string>")
    at = lambda i: F.try_element_at(args, F.lit(i))
    number = lambda i: F.when(at(i).rlike(r"^[0-9]{1,9}\z"), at(i).cast("int"))
    stride = lambda first, count: F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.element_at(args, k * 2 + first))

    def counted(place, first, width=1):
        """``width`` arguments for each of the keys that the argument at ``place`` counts, if there are so many."""
        k = number(place)
        return F.coalesce((k > 0) & (k * width + first - 1 <= n), F.lit(False)), k

    fits, k = counted(1, 2)
    fits_pairs, pairs = counted(1, 2, 2)
    fits_target, sources = counted(2, 3)
    stores = F.array_position(F.transform(args, lambda a: F.upper(a)), "STORE").cast("int")
    target = F.when(stores > 1, F.try_element_at(args, F.greatest(stores + 1, F.lit(1))))
    found = {
        "all": args,
        "pairs": F.when((n >= 2) & (n % 2 == 0), stride(1, (n / 2).cast("int"))),
        "two": F.when(n >= 2, F.slice(args, 1, 2)),
        "after_operation": F.when(n >= 3, F.slice(args, F.lit(2), F.greatest(n - 1, F.lit(0)))),
        "counted": F.when(fits, F.slice(args, F.lit(2), F.greatest(k, F.lit(0)))),
        "counted_pairs": F.when(fits_pairs, stride(2, F.greatest(pairs, F.lit(1)))),
        "target_counted": F.when(fits_target, F.concat(F.slice(args, 1, 1), F.slice(args, F.lit(3), F.greatest(sources, F.lit(0))))),
        "second": F.when(n >= 2, F.slice(args, 2, 1)),
        "sort": F.when(n >= 1, F.array_compact(F.array(at(1), target))),
        "none": none,
    }
    out = F.when(n >= 1, F.slice(args, 1, 1))
    for pattern, names in PATTERNS.items():
        out = F.when(cmd.isin(names.split()), found[pattern]).otherwise(out)
    return F.coalesce(out, none)


def routed(ops: DataFrame, cmd: str = "cmd", args: str = "args") -> DataFrame:
    """A row for each key of each command, with its ``nth`` place among them and its ``slot``."""
    rows = ops.select("*", F.posexplode(command_keys(cmd, args)).alias("nth", "key"))
    return rows.withColumn("slot", key_slot("key"))
