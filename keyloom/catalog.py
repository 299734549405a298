"""Catalog of the commands that the operators cover, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each family with its commands as name:arity:class:flags.  An arity is exact (=) or least (>=);
#: classes are 1 (one key), M (several), W (whole keyspace), H (connection); flags W (write), D (may grow).
COMMANDS = {
    "Strings and numerics": (
        "GET:=2:1:- SET:>=3:1:WD SETNX:=3:1:WD GETSET:=3:1:WD GETDEL:=2:1:W GETEX:>=2:1:W SETEX:=4:1:WD "
        "PSETEX:=4:1:WD STRLEN:=2:1:- APPEND:=3:1:WD GETRANGE:=4:1:- SUBSTR:=4:1:- SETRANGE:=4:1:WD INCR:=2:1:WD "
        "DECR:=2:1:WD INCRBY:=3:1:WD DECRBY:=3:1:WD INCRBYFLOAT:=3:1:WD MGET:>=2:M:- MSET:>=3:M:WD MSETNX:>=3:M:WD "
        "MSETEX:>=4:M:WD DELIFEQ:=3:1:W"
    ),
    "Generic keyspace": (
        "DEL:>=2:M:W UNLINK:>=2:M:W EXISTS:>=2:M:- TYPE:=2:1:- TOUCH:>=2:M:- KEYS:=2:W:- SCAN:>=2:W:- DBSIZE:=1:W:- "
        "RANDOMKEY:=1:W:- RENAME:=3:M:WD RENAMENX:=3:M:WD COPY:>=3:M:WD MOVE:=3:M:W SWAPDB:=3:H:W FLUSHDB:>=1:W:W "
        "FLUSHALL:>=1:W:W SORT:>=2:M:WD SORT_RO:>=2:1:- DUMP:=2:1:- RESTORE:>=4:1:WD OBJECT:>=2:M:-"
    ),
    "TTL / expiry": (
        "EXPIRE:>=3:1:W PEXPIRE:>=3:1:W EXPIREAT:>=3:1:W PEXPIREAT:>=3:1:W TTL:=2:1:- PTTL:=2:1:- EXPIRETIME:=2:1:- "
        "PEXPIRETIME:=2:1:- PERSIST:=2:1:W"
    ),
    "Lists": (
        "LPUSH:>=3:1:WD RPUSH:>=3:1:WD LPUSHX:>=3:1:WD RPUSHX:>=3:1:WD LPOP:>=2:1:W RPOP:>=2:1:W LLEN:=2:1:- "
        "LRANGE:=4:1:- LINDEX:=3:1:- LSET:=4:1:WD LINSERT:=5:1:WD LREM:=4:1:W LTRIM:=4:1:W LPOS:>=3:1:- LMOVE:=5:M:WD "
        "RPOPLPUSH:=3:M:WD LMPOP:>=4:M:W"
    ),
    "Hashes": (
        "HSET:>=4:1:WD HMSET:>=4:1:WD HSETNX:=4:1:WD HGET:=3:1:- HMGET:>=3:1:- HGETALL:=2:1:- HKEYS:=2:1:- "
        "HVALS:=2:1:- HLEN:=2:1:- HEXISTS:=3:1:- HSTRLEN:=3:1:- HDEL:>=3:1:W HINCRBY:=4:1:WD HINCRBYFLOAT:=4:1:WD "
        "HRANDFIELD:>=2:1:- HSCAN:>=3:1:- HGETDEL:>=5:1:W HGETEX:>=5:1:W HSETEX:>=6:1:WD"
    ),
    "Hash-field TTL": (
        "HEXPIRE:>=6:1:W HPEXPIRE:>=6:1:W HEXPIREAT:>=6:1:W HPEXPIREAT:>=6:1:W HTTL:>=5:1:- HPTTL:>=5:1:- "
        "HEXPIRETIME:>=5:1:- HPEXPIRETIME:>=5:1:- HPERSIST:>=5:1:W"
    ),
    "Sets": (
        "SADD:>=3:1:WD SREM:>=3:1:W SMEMBERS:=2:1:- SISMEMBER:=3:1:- SMISMEMBER:>=3:1:- SCARD:=2:1:- SPOP:>=2:1:W "
        "SRANDMEMBER:>=2:1:- SMOVE:=4:M:W SINTER:>=2:M:- SUNION:>=2:M:- SDIFF:>=2:M:- SINTERCARD:>=3:M:- "
        "SINTERSTORE:>=3:M:WD SUNIONSTORE:>=3:M:WD SDIFFSTORE:>=3:M:WD SSCAN:>=3:1:-"
    ),
    "Sorted sets": (
        "ZADD:>=4:1:WD ZINCRBY:=4:1:WD ZREM:>=3:1:W ZSCORE:=3:1:- ZMSCORE:>=3:1:- ZCARD:=2:1:- ZRANK:>=3:1:- "
        "ZREVRANK:>=3:1:- ZCOUNT:=4:1:- ZLEXCOUNT:=4:1:- ZRANGE:>=4:1:- ZREVRANGE:>=4:1:- ZRANGEBYSCORE:>=4:1:- "
        "ZREVRANGEBYSCORE:>=4:1:- ZRANGEBYLEX:>=4:1:- ZREVRANGEBYLEX:>=4:1:- ZREMRANGEBYRANK:=4:1:W "
        "ZREMRANGEBYSCORE:=4:1:W ZREMRANGEBYLEX:=4:1:W ZPOPMIN:>=2:1:W ZPOPMAX:>=2:1:W ZMPOP:>=4:M:W "
        "ZRANDMEMBER:>=2:1:- ZSCAN:>=3:1:- ZRANGESTORE:>=5:M:WD ZUNION:>=3:M:- ZINTER:>=3:M:- ZDIFF:>=3:M:- "
        "ZUNIONSTORE:>=4:M:WD ZINTERSTORE:>=4:M:WD ZDIFFSTORE:>=4:M:WD ZINTERCARD:>=3:M:-"
    ),
    "Bitmaps": (
        "SETBIT:=4:1:WD GETBIT:=3:1:- BITCOUNT:>=2:1:- BITPOS:>=3:1:- BITOP:>=4:M:WD BITFIELD:>=2:1:WD "
        "BITFIELD_RO:>=2:1:-"
    ),
    "HyperLogLog": (
        "PFADD:>=2:1:WD PFCOUNT:>=2:M:- PFMERGE:>=2:M:WD PFDEBUG:>=3:M:WD"
    ),
    "Transactions": (
        "MULTI:=1:H:- EXEC:=1:H:- DISCARD:=1:H:- WATCH:>=2:H:- UNWATCH:=1:H:-"
    ),
    "Blocking": (
        "BLPOP:>=3:H:W BRPOP:>=3:H:W BLMOVE:=6:H:W BRPOPLPUSH:=4:H:W BLMPOP:>=5:H:W BZPOPMIN:>=3:H:W BZPOPMAX:>=3:H:W "
        "BZMPOP:>=5:H:W WAIT:=3:H:-"
    ),
    "Connection": (
        "PING:>=1:H:- ECHO:=2:H:- LOLWUT:>=1:H:- HELLO:>=1:H:- AUTH:>=2:H:- SELECT:=2:H:- QUIT:>=1:H:- RESET:=1:H:- "
        "READONLY:=1:H:- READWRITE:=1:H:- CLIENT:>=2:H:-"
    ),
    "Server / introspection": (
        "COMMAND:>=1:H:- INFO:>=1:H:- CONFIG:>=2:H:- SLOWLOG:>=2:H:- MEMORY:>=2:H:- LATENCY:>=2:H:- HOTKEYS:>=2:H:- "
        "DEBUG:>=2:H:- CLUSTER:>=2:H:- SAVE:=1:H:- BGSAVE:>=1:H:- LASTSAVE:=1:H:- SHUTDOWN:>=1:H:-"
    ),
}
#: Where a command's data semantics live; the rest concern a connection or a server process only.
MODULES = {
    "operators.strings": (
        "GET MGET SET SETNX GETSET GETDEL GETEX SETEX PSETEX STRLEN APPEND GETRANGE SUBSTR SETRANGE INCR DECR INCRBY DECRBY "
        "INCRBYFLOAT MSET MSETNX MSETEX DELIFEQ"
    ),
    "operators.ttl": (
        "EXPIRE PEXPIRE EXPIREAT PEXPIREAT TTL PTTL EXPIRETIME PEXPIRETIME PERSIST HEXPIRE HPEXPIRE HEXPIREAT "
        "HPEXPIREAT HTTL HPTTL HEXPIRETIME HPEXPIRETIME HPERSIST"
    ),
    "operators.generic": (
        "DEL UNLINK EXISTS TYPE TOUCH KEYS SCAN DBSIZE RANDOMKEY RENAME RENAMENX COPY MOVE SWAPDB FLUSHDB FLUSHALL "
        "DUMP RESTORE OBJECT HRANDFIELD HSCAN SPOP SRANDMEMBER SSCAN ZRANDMEMBER ZSCAN MEMORY SELECT"
    ),
    "operators.sort": (
        "SORT SORT_RO"
    ),
    "operators.lists": (
        "LPUSH RPUSH LPUSHX RPUSHX LPOP RPOP LLEN LRANGE LINDEX LSET LINSERT LREM LTRIM LPOS LMOVE RPOPLPUSH LMPOP"
    ),
    "operators.hashes": (
        "HSET HMSET HSETNX HGET HMGET HGETALL HKEYS HVALS HLEN HEXISTS HSTRLEN HDEL HINCRBY HINCRBYFLOAT HGETDEL "
        "HGETEX HSETEX"
    ),
    "operators.sets": (
        "SADD SREM SMEMBERS SISMEMBER SMISMEMBER SCARD SMOVE SINTER SUNION SDIFF SINTERCARD SINTERSTORE SUNIONSTORE "
        "SDIFFSTORE"
    ),
    "operators.zsets": (
        "ZADD ZINCRBY ZREM ZSCORE ZMSCORE ZCARD ZRANK ZREVRANK ZCOUNT ZLEXCOUNT ZRANGE ZREVRANGE ZRANGEBYSCORE "
        "ZREVRANGEBYSCORE ZRANGEBYLEX ZREVRANGEBYLEX ZREMRANGEBYRANK ZREMRANGEBYSCORE ZREMRANGEBYLEX ZPOPMIN ZPOPMAX "
        "ZMPOP ZRANGESTORE ZUNION ZINTER ZDIFF ZUNIONSTORE ZINTERSTORE ZDIFFSTORE ZINTERCARD"
    ),
    "operators.bitmaps": (
        "SETBIT GETBIT BITCOUNT BITPOS BITOP BITFIELD BITFIELD_RO"
    ),
    "operators.hll": (
        "PFADD PFCOUNT PFMERGE PFDEBUG"
    ),
    "plans.fold": (
        "MULTI EXEC DISCARD WATCH UNWATCH CLIENT BLPOP BRPOP BLMOVE BRPOPLPUSH BLMPOP BZPOPMIN BZPOPMAX BZMPOP"
    ),
    "plans.persist": (
        "WAIT CLUSTER SAVE BGSAVE LASTSAVE"
    ),
    "plans.stats": (
        "INFO SLOWLOG LATENCY HOTKEYS"
    ),
    "plans.session": (
        "PING ECHO QUIT RESET READONLY READWRITE CONFIG"
    ),
    "catalog": (
        "COMMAND"
    ),
}


def catalog_rows() -> list[tuple]:
    """(name, family, arity, exact, class, writes, may_grow, module) of each command; module is None where none is needed."""
    where = {name: module for module, names in MODULES.items() for name in names.split()}
    rows = []
    for family, names in COMMANDS.items():
        for entry in names.split():
            name, arity, kind, flags = entry.split(":")
            exact, least = arity.startswith("="), int(arity.lstrip(">="))
            rows.append((name, family, least, exact, kind, "W" in flags, "D" in flags, where.get(name)))
    return rows


def catalog(spark: SparkSession) -> DataFrame:
    """COMMAND: the catalog as a table."""
    schema = "name string, family string, arity int, exact boolean, class string, writes boolean, may_grow boolean, module string"
    return spark.createDataFrame(catalog_rows(), schema)
