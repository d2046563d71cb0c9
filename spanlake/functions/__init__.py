"""Scalar functions of the trace model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the trace format and their labels.
LOG_VERBOSITY = {0: "NoLogging", 1: "Fatal", 2: "Error", 3: "Warning", 4: "Display", 5: "Log", 6: "Verbose", 7: "VeryVerbose"}
BUILD_CONFIGURATION = {0: "Unknown", 1: "Debug", 2: "DebugGame", 3: "Development", 4: "Shipping", 5: "Test"}
BUILD_TARGET = {0: "Unknown", 1: "Game", 2: "Server", 3: "Client", 4: "Editor", 5: "Program"}
COUNTER_KIND = {0: "int", 1: "float"}
FRAME_TYPE = {0: "game", 1: "rendering"}
ROOT_HEAP = {0: "System memory", 1: "Video memory"}
#: Largest signed 64-bit integer, where sums saturate.
MAX_LONG = (1 << 63) - 1


def label(code: Column, names: dict[int, str], unknown: str = "unknown") -> Column:
    """The code's label; unknown codes never fail."""
    out = F.lit(unknown)
    for k, v in names.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def log_verbosity(code: Column) -> Column:
    return label(code.bitwiseAND(F.lit(0x0F)), LOG_VERBOSITY)


def cycles_to_seconds(cycles: Column, frequency: Column) -> Column:
    """Null unless the frequency is positive."""
    return F.when(frequency > 0, cycles / frequency)


def cycles_to_ms(cycles: Column, frequency: Column) -> Column:
    return F.when(frequency > 0, cycles * 1000 / frequency)


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(MAX_LONG))


def serial_distance(serial: Column, origin: Column) -> Column:
    """Forward distance of 24-bit serials."""
    return F.pmod(serial - origin, F.lit(1 << 24))


def packed_size(high: Column, low: Column, shift: int) -> Column:
    """(high << shift) OR (low AND mask)."""
    return F.shiftleft(high, shift).bitwiseOR(low.bitwiseAND(F.lit((1 << shift) - 1)))


def queue_parts(queue: Column) -> tuple[Column, Column, Column]:
    """Type, gpu and index of a GPU queue id: bytes 0, 1 and 2."""
    byte = lambda n: F.shiftright(queue, 8 * n).bitwiseAND(F.lit(0xFF))
    return byte(0), byte(1), byte(2)


def hex_prefix(data: Column, n: int = 32) -> Column:
    return F.lower(F.hex(F.substring(data, 1, n)))


def address_text(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def guid_text(data: Column) -> Column:
    """8-4-4-4-12 with the first three groups little-endian; plain hexadecimal unless there are 16 bytes."""
    digits = F.lower(F.hex(data))
    pair = lambda i: F.substring(digits, 2 * i + 1, 2)
    group = lambda *at: F.concat(*map(pair, at))
    text = F.concat_ws("-", group(3, 2, 1, 0), group(5, 4), group(7, 6), group(8, 9), group(10, 11, 12, 13, 14, 15))
    return F.when(F.octet_length(data) == 16, text).otherwise(digits)


def latin1_text(data: Column) -> Column:
    """Bytes as Latin-1 without one trailing NUL."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), "\\x00$", "")


def ascii_runs(text: Column) -> Column:
    """Runs of at least four printable ASCII characters."""
    return F.regexp_extract_all(text, F.lit("([ -~]{4,})"), 1)


def frame_number(name: Column) -> Column:
    """The number in ``Frame <n>`` if it fits 32 unsigned bits."""
    n = F.regexp_extract(name, r"^Frame (\d+)", 1).try_cast("long")
    return F.when(n < 1 << 32, n)


def split_paths(text: Column) -> Column:
    return F.filter(F.split(text, ";"), lambda s: s != "")


def named_values(names: Column, values: Column) -> Column:
    """Field name to value; fields without a name are ``value_<i>``."""
    n = F.greatest(F.size(names), F.size(values))
    at = F.sequence(F.lit(0), n - 1)
    return F.map_from_entries(F.transform(at, lambda i: F.struct(F.coalesce(F.get(names, i), F.concat(F.lit("value_"), i)), F.get(values, i))))


def percent_s(template: Column, args: Column) -> Column:
    """Fill ``%s`` in order; null if there are more arguments than slots."""
    parts = F.split(template, "%s", -1)
    filled = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(""), lambda acc, i: F.concat(acc, F.element_at(parts, i), F.when(i < F.size(parts), F.coalesce(F.get(args, i - 1), F.lit("%s"))).otherwise("")))
    return F.when(F.size(args) <= F.size(parts) - 1, filled)


def elapsed_text(seconds: Column) -> Column:
    """HH:MM:SS.mmm; negative is zero."""
    ms = F.floor(F.greatest(seconds, F.lit(0)) * 1000 + 0.5).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def bytes_text(n: Column) -> Column:
    """Bytes with the unit that fits; one decimal of KiB, two of MiB and GiB."""
    size = F.abs(n)
    return (
        F.when(size < 1 << 10, F.concat(n.cast("long"), F.lit(" B")))
        .when(size < 1 << 20, F.format_string("%.1f KiB", n / (1 << 10)))
        .when(size < 1 << 30, F.format_string("%.2f MiB", n / (1 << 20)))
        .otherwise(F.format_string("%.2f GiB", n / (1 << 30)))
    )


def compact_text(n: Column) -> Column:
    """A number with K, M or B and at most one decimal."""
    size = F.abs(n)
    short = lambda unit, letter: F.concat(F.regexp_replace(F.format_string("%.1f", n / unit), r"\.0$", ""), F.lit(letter))
    return F.when(size < 1000, F.regexp_replace(F.format_string("%.1f", n.cast("double")), r"\.0$", "")).when(size < 1e6, short(1e3, "K")).when(size < 1e9, short(1e6, "M")).otherwise(short(1e9, "B"))


def ms_text(seconds: Column) -> Column:
    return F.when(seconds.isNotNull() & ~F.isnan(seconds.cast("double")), F.format_string("%.2f ms", seconds.cast("double") * 1000)).otherwise("—")
