"""The wire protocol: replies and requests as columns, and a decoder of request frames."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"


def bulk(text: Column) -> Column:
    """A bulk string; lengths are in bytes, and the empty one is not null."""
    return F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit(CRLF), text, F.lit(CRLF))


def request(*args: Column) -> Column:
    """An array of bulk strings; arguments that are null are left out."""
    parts = F.array_compact(F.array(*args))
    return F.concat(F.lit("*"), F.size(parts).cast("string"), F.lit(CRLF), F.array_join(F.transform(parts, bulk), ""))


def simple(text: Column) -> Column:
    return F.concat(F.lit("+"), text, F.lit(CRLF))


def error(text: Column) -> Column:
    return F.concat(F.lit("-"), text, F.lit(CRLF))


def integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit(CRLF))


def protocol(version: Column) -> Column:
    """Versions below 2 are 2, above 3 are 3."""
    return F.greatest(F.lit(2), F.least(F.lit(3), version))


def null(version: Column) -> Column:
    return F.when(protocol(version) == 3, F.lit("_" + CRLF)).otherwise(F.lit("$-1" + CRLF))


def boolean(value: Column, version: Column) -> Column:
    return F.when(protocol(version) == 3, F.when(value, F.lit("#t" + CRLF)).otherwise(F.lit("#f" + CRLF))).otherwise(integer(value.cast("int")))


def array_header(n: Column) -> Column:
    return F.concat(F.lit("*"), n.cast("string"), F.lit(CRLF))


def map_header(n: Column, version: Column) -> Column:
    """Of n pairs; the older protocol has an array of twice as many."""
    return F.when(protocol(version) == 3, F.concat(F.lit("%"), n.cast("string"), F.lit(CRLF))).otherwise(array_header(n * 2))


def double_text(x: Column) -> Column:
    """The shortest digits that read back as the same double; with an exponent of two digits or more
    below the fourth place after the point and from a million upwards, plainly in between."""
    parts = F.split(F.abs(x).cast("string"), "E")
    mantissa, e = F.element_at(parts, 1), F.coalesce(F.get(parts, F.lit(1)).cast("int"), F.lit(0))
    every = F.regexp_replace(mantissa, r"\.", "")
    tail = F.regexp_replace(every, "^0+", "")
    digits = F.regexp_replace(tail, "0+$", "")
    exp = e + F.length(F.substring_index(mantissa, ".", 1)) - 1 - (F.length(every) - F.length(tail))
    n, after = F.length(digits), F.abs(exp).cast("string")
    fraction = lambda at: F.when(n > at, F.concat(F.lit("."), F.substring(digits, at + 1, n))).otherwise(F.lit(""))
    sized = F.concat(F.substring(digits, 1, 1), fraction(F.lit(1)), F.when(exp < 0, "e-").otherwise("e+"), F.when(F.length(after) < 2, F.concat(F.lit("0"), after)).otherwise(after))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    plain = F.concat(F.rpad(F.substring(digits, F.lit(1), exp + 1), exp + 1, "0"), fraction(exp + 1))
    spelled = F.when(x == 0, F.lit("0")).when((exp < -4) | (exp >= 6), sized).when(exp < 0, small).otherwise(plain)
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(F.concat(sign, spelled))


def double(x: Column, version: Column) -> Column:
    return F.when(protocol(version) == 3, F.concat(F.lit(","), double_text(x), F.lit(CRLF))).otherwise(bulk(double_text(x)))


def big_number(digits: Column, version: Column) -> Column:
    return F.when(protocol(version) == 3, F.concat(F.lit("("), digits, F.lit(CRLF))).otherwise(bulk(digits))


@dataclass(frozen=True)
class DecodeLimits:
    """Limits on frames; zero and less mean the defaults."""

    bulk: int = 512 << 20
    array: int = 1 << 20
    header: int = 64

    def of(self, name: str) -> int:
        own = getattr(self, name)
        return own if own > 0 else getattr(DecodeLimits(), name)


# What clients are told of a malformed frame.
TOO_LONG = {"bulk": "bulk length exceeds configured limit", "array": "multibulk count exceeds configured limit"}
ENDS = ("end", "truncated", "transport")


class BadFrame(Exception):
    pass


class _Short(Exception):
    pass


def _line(data: bytes, at: int, limits: DecodeLimits) -> tuple[bytes, int]:
    end = data.find(b"\n", at, at + limits.of("header"))
    if end < 0:
        if len(data) - at >= limits.of("header"):
            raise BadFrame("header line exceeds limit")
        raise _Short
    if end == at or data[end - 1 : end] != b"\r":
        raise BadFrame("expected CRLF terminator")
    return data[at : end - 1], end + 1


def _length(text: bytes, most: int, what: str) -> int:
    if not text.isdigit() or not text.isascii() or text != b"0" and text[:1] == b"0":
        raise BadFrame("invalid length")
    if int(text) > most:
        raise BadFrame(TOO_LONG[what])
    return int(text)


def decode(data: bytes, limits: DecodeLimits = DecodeLimits()) -> list[tuple[int, list[bytes] | None, str]]:
    """(bytes consumed so far, arguments, outcome) of each command of a buffer. The outcome is
    ok, or, of the last, truncated or what is wrong. Sizes are checked before they are read."""
    out, at = [], 0
    while at < len(data):
        start = at
        try:
            if data[at : at + 1] != b"*":
                raise BadFrame("expected '*' array header")
            head, at = _line(data, at, limits)
            args = []
            for _ in range(_length(head[1:], limits.of("array"), "array")):
                if at >= len(data):
                    raise _Short
                if data[at : at + 1] != b"$":
                    raise BadFrame("expected '$' bulk-string header")
                head, at = _line(data, at, limits)
                size = _length(head[1:], limits.of("bulk"), "bulk")
                if len(data) < at + size + 2:
                    if len(data) > at + size and data[at + size : at + size + 1] != b"\r":
                        raise BadFrame("expected CRLF terminator")
                    raise _Short
                if data[at + size : at + size + 2] != b"\r\n":
                    raise BadFrame("expected CRLF terminator")
                args.append(data[at : at + size])
                at += size + 2
            out.append((at, args, "ok"))
        except _Short:
            return [*out, (start, None, "truncated")]
        except BadFrame as bad:
            return [*out, (start, None, str(bad))]
    return out


def decoded(frames: DataFrame, limits: DecodeLimits = DecodeLimits()) -> DataFrame:
    """(id, pos, consumed, args, outcome): the commands of each row of `frames` (id, frame). A
    null frame has none."""

    def run(batches):
        for batch in batches:
            rows = [(i, p, *r) for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p, r in enumerate(decode(f or b"", limits))]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["id", "pos", "consumed", "args", "outcome"])

    return frames.select(F.col("id").cast("long"), F.col("frame").cast("binary")).mapInArrow(run, "id long, pos long, consumed long, args array<binary>, outcome string")


def disposition(outcome: Column) -> Column:
    """What a server does after reading: dispatch the command, close silently where input ends, in
    the middle of a command or not, or fails, or tell what is wrong and then close."""
    return F.when(outcome == "ok", "dispatch").when(outcome.isin(*ENDS), "close").otherwise("error then close")


def protocol_error(outcome: Column) -> Column:
    """The reply to a malformed frame; null where there is none."""
    return F.when(disposition(outcome) == "error then close", error(F.concat(F.lit("ERR Protocol error: "), outcome)))
