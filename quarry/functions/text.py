"""Scalar functions over strings and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separator characters of a line; a newline is a class of its own, all else is content (fixed values).
SEPARATORS = r",; \t|:"


def bound(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_class(c: Column) -> Column:
    """0 separator, 2 newline, 1 content; of a character (F1)."""
    return F.when(c == "\n", 2).when(c.isin(*",; \t|:"), 0).otherwise(1)


#: Character classes 0..7 and how to find them (fixed values, F2).
CHAR_CLASSES = {"digit": "[0-9]", "lower": "[a-z]", "upper": "[A-Z]", "blank": r"[ \t]", "line": r"[\n\r]", "mark": '[",:=.]', "wide": r"[^\x00-\x7F]"}


def char_class(c: Column) -> Column:
    """The name of a character's class, other if it has none of these (F2)."""
    found = F.lit("other")
    for name, pattern in reversed(CHAR_CLASSES.items()):
        found = F.when(c.rlike(pattern), name).otherwise(found)
    return found


def count_of(text: Column, pattern: str) -> Column:
    """Characters that match; by what their removal takes away, which is cheaper than listing them."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def bytes_of(text: Column, pattern: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))


def varint_len(v: Column) -> Column:
    """Bytes of a variable-length unsigned number."""
    return F.when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).when(v < 1 << 28, 4).otherwise(5)


def varint(v: Column) -> Column:
    """A number from 0 as its bytes: seven bits to the byte from the lowest, the high bit where more follow."""
    rest = [F.shiftrightunsigned(v.cast("long"), 7 * i) for i in range(10)]
    parts = [F.lpad(F.hex(r.bitwiseAND(F.lit(127)) + F.when(after > 0, 128).otherwise(0)), 2, "0") for r, after in zip(rest, [*rest[1:], F.lit(0)], strict=True)]
    return F.unhex(F.concat(parts[0], *(F.when(r > 0, part).otherwise("") for r, part in zip(rest[1:], parts[1:], strict=True))))


def read_varint(body: Column) -> Column:
    """The number that varint was given."""
    digits = F.regexp_extract_all(F.hex(body), F.lit("[0-9A-F]{2}"), 0)
    bits = F.transform(digits, lambda d: F.conv(d, 16, 10).cast("long").bitwiseAND(F.lit(127)))
    return F.aggregate(F.reverse(bits), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 7).bitwiseOR(b))


def prefixed_len(n: Column) -> Column:
    """Bytes of a string of n bytes with its length before it."""
    return varint_len(n) + n


def zigzag(v: Column) -> Column:
    """Signed to unsigned with small values for small sizes."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1)))


def _common_prefix(a: Column, b: Column, n: Column) -> Column:
    """The largest m up to n for which the first m places agree, found bit by bit from the highest one."""

    def longest(x: Column) -> Column:
        def grown(m: Column, k: Column) -> Column:
            step = F.pow(F.lit(2.0), k).cast("int")
            fits = (m + step <= x["n"]) & (F.substring(x["a"], m + 1, step) == F.substring(x["b"], m + 1, step))
            return F.when(fits, m + step).otherwise(m)

        powers = F.sequence(F.floor(F.log2(x["n"].cast("double"))).cast("int"), F.lit(0), F.lit(-1))
        return F.aggregate(powers, F.lit(0), grown)

    some = a.isNotNull() & b.isNotNull() & (n > 0)
    return F.when(some, bound(F.struct(a.alias("a"), b.alias("b"), n.alias("n")), longest)).otherwise(0)


def lcp(a: Column, b: Column) -> Column:
    """Characters of the longest common prefix; 0 if either is null."""
    return _common_prefix(a, b, F.least(F.length(a), F.length(b)))


def common_prefix_bytes(a: Column, b: Column) -> Column:
    """The same in bytes: of binary values a place costs nothing to reach, so the whole is linear."""
    a, b = F.encode(a, "UTF-8"), F.encode(b, "UTF-8")
    return _common_prefix(a, b, F.least(F.octet_length(a), F.octet_length(b)))


def common_suffix(a: Column, b: Column, most: int) -> Column:
    """Characters of the longest common suffix, up to most (F8)."""
    return lcp(F.reverse(F.right(a, F.lit(most))), F.reverse(F.right(b, F.lit(most))))


def padded(v: Column, width: Column) -> Column:
    """A number as text, zeros before it up to width and never cut."""
    text = v.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def longest_digits(text: Column) -> Column:
    """The longest run of digits, the first of equals; null without one."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), 0), lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r")))
    return F.array_max(runs)["r"]


def is_number(text: Column) -> Column:
    """All digits and not empty."""
    return F.coalesce(text.rlike("^[0-9]+$"), F.lit(False))


def hex_lane(text: Column) -> Column:
    """lower, upper or none: hexadecimal identifiers with letters and digits well mixed."""
    n, digits = F.length(text), count_of(text, "[0-9]")

    def of(letters: Column) -> Column:
        return (n >= 10) & (digits >= 2) & (letters * 10 >= n * 3) & ((letters + digits) * 20 >= n * 17)

    return F.when(of(count_of(text, "[a-f]")), "lower").when(of(count_of(text, "[A-F]")), "upper").otherwise("none")


#: Milliseconds from 0001-01-01 to 1970-01-01 (fixed value).
EPOCH_MS = 719162 * 86400000


def parse_ts(text: Column) -> Column:
    """Milliseconds since 0001-01-01 of a strict YYYY-MM-DDTHH:MM:SS.mmmZ, else null; days must exist."""
    shape = (F.octet_length(text) == 24) & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$")
    day = F.when(shape, F.substring(text, 1, 10).try_cast("date"))
    h, m, s, ms = (F.substring(text, a, n).try_cast("long") for a, n in ((12, 2), (15, 2), (18, 2), (21, 3)))
    value = F.datediff(day, F.lit("0001-01-01").cast("date")).cast("long") * 86400000 + h * 3600000 + m * 60000 + s * 1000 + ms
    return F.when(shape & day.isNotNull() & (h < 24) & (m < 60) & (s < 60), value)


def format_ts(ms: Column) -> Column:
    """The text of which parse_ts gives ms."""
    day = F.date_add(F.lit("0001-01-01").cast("date"), F.floor(ms / 86400000).cast("int"))
    rest = F.pmod(ms, F.lit(86400000))
    two = lambda v: padded(v, F.lit(2))
    part = lambda per, n: F.floor(rest / per).cast("long") % n
    return F.concat(F.lpad(F.date_format(day, "yyyy-MM-dd"), 10, "0"), F.lit("T"), two(part(3600000, 24)), F.lit(":"), two(part(60000, 60)), F.lit(":"), two(part(1000, 60)), F.lit("."), padded(rest % 1000, F.lit(3)), F.lit("Z"))


def stretch(p: Column) -> Column:
    """Logit (F19)."""
    return F.log(p / (1 - p))


def squash(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bucket_len(n: Column) -> Column:
    """Lengths above 28 are one bucket."""
    return F.least(n, F.lit(28))


def object_name(h1: Column, h2: Column) -> Column:
    """Name of a stored object: two 64-bit halves in hexadecimal."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (h1, h2)), F.lit(".obj"))


def fold_case(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_value(c: Column) -> Column:
    """0..15 of a hexadecimal digit."""
    return F.conv(c, 16, 10).cast("int")


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def base64_value(c: Column) -> Column:
    """0..63 of a base64 symbol, -1 for anything else."""
    return F.instr(F.lit(BASE64), c) - 1
