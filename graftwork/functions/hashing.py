"""64-bit FNV-1a as a native expression (OP-60, OP-60b, OP-61).

BIGINT products overflow under ANSI mode, so the state is two halves of 32
bits. As the prime is 2^40 + 435, a step is two products below 2^41 and a
shift.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 0xCBF29CE484222325
PRIME_LOW = 435
MODULUS = 1 << 64
HALF = 0xFFFFFFFF


def _halves(text: Column, state: int) -> Column:
    """STRUCT<hi, lo> of the hash of a text's UTF-8 bytes."""
    # a byte string read as Latin-1 has a character for each byte
    octets = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")
    octets = F.when(F.length(text) > 0, octets).otherwise(F.array().cast("array<string>"))
    pair = lambda hi, lo: F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))

    def step(h: Column, c: Column) -> Column:
        low = h["lo"].bitwiseXOR(F.ascii(c).cast("bigint"))
        product = low * PRIME_LOW
        high = h["hi"] * PRIME_LOW + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return pair(high.bitwiseAND(F.lit(HALF)), product.bitwiseAND(F.lit(HALF)))

    return F.aggregate(octets, pair(F.lit(state >> 32), F.lit(state & HALF)), step)


def fnv1a64(text: Column, state: int = OFFSET) -> Column:
    """Unsigned hash of the UTF-8 bytes as DECIMAL(20,0); null for null."""
    number = F.aggregate(F.array(_halves(text, state)), F.lit(0).cast("decimal(20,0)"), lambda _, h: (h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + h["lo"]).cast("decimal(20,0)"))
    return F.when(text.isNotNull(), number)


def fingerprint(text: Column) -> Column:
    """Printed FNV fingerprint of a text: 16 lower-case hexadecimal digits."""
    return F.when(text.isNotNull(), F.aggregate(F.array(_halves(text, OFFSET)), F.lit(""), lambda _, h: F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))))


def cache_key(parts: list[Column]) -> Column:
    """Fingerprint over NUL-terminated parts."""
    return fingerprint(F.concat(*[F.concat(p, F.lit("\0")) for p in parts]))


def seeded_score(ident: Column, seed: int) -> Column:
    """FNV-1a whose first state is the seed XOR the usual one."""
    return fnv1a64(ident, (seed & (MODULUS - 1)) ^ OFFSET)


def short_digest(text: Column) -> Column:
    """The first 16 digits of SHA-256: the runner's keys, which don't mix with FNV ones."""
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)
