"""What a server answers to commands that do not touch the keyspace, and its error texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlog.functions import resp

# The verbs with the least and most arguments, the verb included (null is no upper
# bound), the error texts and the fields of the handshake are those that clients know.
COMMANDS = [("ping", 1, 2), ("quit", 1, 1), ("get", 2, 2), ("set", 3, 5), ("del", 2, None), ("exists", 2, None), ("ttl", 2, 2), ("pttl", 2, 2), ("hello", 1, None), ("command", 1, None), ("config", 2, None), ("select", 2, 2)]
SYNTAX = "ERR syntax error"
NOT_INTEGER = "ERR value is not an integer or out of range"
BAD_EXPIRE = "ERR invalid expire time in 'set' command"
OUT_OF_MEMORY = "OOM command not allowed when used memory > 'maxmemory'"
NO_PROTOCOL = "NOPROTO unsupported protocol version"
NO_PASSWORD = "ERR Client sent AUTH, but no password is set"
BAD_INDEX = "ERR DB index is out of range"
BAD_COMMAND = "ERR Unknown COMMAND subcommand or wrong number of arguments"
BAD_CONFIG = "ERR Unknown CONFIG subcommand or wrong number of arguments"
#: Bytes of a client's text that an error repeats at most.
ECHO = 128


def sanitized(text: Column) -> Column:
    """The bytes of a client's text that an error repeats, one character a byte: ECHO of them, control
    bytes as question marks. A character that the cut parts keeps its first bytes."""
    return F.regexp_replace(F.decode(F.substring(text.cast("binary"), 1, ECHO), "ISO-8859-1"), "[\\x00-\\x1f\\x7f]", "?")


def as_bytes(text: Column) -> Column:
    """Such a text as bytes again."""
    return F.encode(text, "ISO-8859-1")


def unknown_command(raw: Column) -> Column:
    return F.concat(F.lit("ERR unknown command '"), sanitized(raw), F.lit("', with args beginning with: "))


def wrong_arity(verb: Column) -> Column:
    return F.concat(F.lit("ERR wrong number of arguments for '"), F.lower(verb), F.lit("'"))


def engine_error(text: Column) -> Column:
    return F.concat(F.lit("ERR "), sanitized(text))


def arity(verb: Column) -> Column:
    """(least, most) of a verb in any case; null for no verb."""
    known = F.create_map(*[x for v, least, most in COMMANDS for x in (F.lit(v), F.struct(F.lit(least).alias("least"), F.lit(most).cast("int").alias("most")))])
    return known[F.lower(verb)]


def _bulk(text: Column | str) -> Column:
    return resp.bulk(F.lit(text) if isinstance(text, str) else text)


def hello_map(proto: Column, name: Column, version: Column, conn: Column) -> Column:
    """The server's map of seven fields, an array of twice as many before protocol 3."""
    fields = [("server", _bulk(name)), ("version", _bulk(version)), ("proto", resp.integer(proto)), ("id", resp.integer(conn)), ("mode", _bulk("standalone")), ("role", _bulk("master")), ("modules", resp.array_header(F.lit(0)))]
    return F.concat(resp.map_header(F.lit(len(fields)), proto), *[x for k, v in fields for x in (_bulk(k), v)])


def replies(requests: DataFrame, name: str, version: str) -> DataFrame:
    """(conn, n, proto, reply, closes) of each of `requests` (conn, n, args array<string>): what
    connection `conn` is answered to its n-th command. `proto` is the dialect after it, reply is
    null for the verbs that touch the keyspace and for an empty array of arguments, which none
    is sent for. A connection's dialect is that of its last handshake, so its commands are in one
    task, in order."""
    args, verb, argc = F.col("args"), F.upper(F.get("args", F.lit(0))), F.size("args")
    first, second = F.get(args, F.lit(1)), F.upper(F.get(args, F.lit(1)))
    whole = lambda x: F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("bigint"))
    known = arity(verb)
    wrong = (argc < known["least"]) | (argc > known["most"])
    # options of the handshake after its version, read by twos until one is not a name with its value
    rest = F.slice(args, 3, F.greatest(argc - 2, F.lit(0)))
    odd = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(rest) - 1), F.lit(2))
    option = lambda i: F.upper(F.get(rest, i))
    fault = F.get(F.filter(F.transform(odd, lambda i: F.when(option(i) == "AUTH", F.lit(NO_PASSWORD)).when((option(i) == "SETNAME") & (i + 1 < F.size(rest)), F.lit(None).cast("string")).otherwise(F.lit(SYNTAX))), lambda x: x.isNotNull()), F.lit(0))
    asked = whole(first)
    bad_hello = F.when((argc > 1) & ~F.coalesce(asked.isin(2, 3), F.lit(False)), F.lit(NO_PROTOCOL)).when(F.size(rest) > 0, fault)
    flips = F.when((verb == "HELLO") & (argc > 1) & bad_hello.isNull(), asked.cast("int"))
    order = Window.partitionBy("conn").orderBy("n")
    rows = requests.withColumns({"_bad": bad_hello, "_flips": flips}).withColumn("proto", F.coalesce(F.last("_flips", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(2)))
    error = resp.error
    config = F.when((second == "GET") & (argc == 3) | (second == "SET") & (argc == 4), F.lit(None).cast("string")).otherwise(error(F.lit(BAD_CONFIG)))
    reply = (
        F.when(argc == 0, F.lit(None).cast("string"))
        .when(known.isNull(), error(unknown_command(F.get(args, F.lit(0)))))
        .when(wrong, error(wrong_arity(verb)))
        .when(verb == "PING", F.when(argc == 2, resp.bulk(first)).otherwise(resp.simple(F.lit("PONG"))))
        .when(verb == "QUIT", resp.simple(F.lit("OK")))
        .when(verb == "COMMAND", F.when((argc == 1) | (second == "DOCS"), resp.array_header(F.lit(0))).when(second == "COUNT", resp.integer(F.lit(len(COMMANDS)))).otherwise(error(F.lit(BAD_COMMAND))))
        .when(verb == "SELECT", F.when(asked == 0, resp.simple(F.lit("OK"))).when(asked.isNotNull(), error(F.lit(BAD_INDEX))).otherwise(error(F.lit(NOT_INTEGER))))
        .when(verb == "HELLO", F.when(F.col("_bad").isNotNull(), error(F.col("_bad"))).otherwise(hello_map(F.col("proto"), F.lit(name), F.lit(version), F.col("conn"))))
        .when(verb == "CONFIG", config)
    )
    return rows.select("conn", "n", "proto", reply.alias("reply"), (F.coalesce(verb == "QUIT", F.lit(False)) & ~F.coalesce(wrong, F.lit(False))).alias("closes"))
