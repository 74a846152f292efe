"""FNV-1a, 64 bits, as a Column expression that never overflows: the hash is kept as two halves of 32 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of FNV-1a: the offset basis by halves; the prime is 2**40 + 0x1b3.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
_HALF = (1 << 32) - 1


def _step(high: Column, low: Column, byte: Column) -> tuple[Column, Column]:
    """Both halves after one more byte (0 to 255, as a long)."""
    low = low.bitwiseXOR(byte)
    product = low * PRIME_LOW
    return (high * PRIME_LOW + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(_HALF)), product.bitwiseAND(F.lit(_HALF))


def _of_string(c: Column) -> Column:
    """``struct(high, low)`` of the UTF-8 bytes of a string, each taken as a character of its own."""
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("high"), F.lit(BASIS_LOW).cast("long").alias("low"))
    single = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")

    def step(h: Column, ch: Column) -> Column:
        high, low = _step(h["high"], h["low"], F.ascii(ch).cast("long"))
        return F.struct(high.alias("high"), low.alias("low"))

    return F.aggregate(F.when(F.length(single) > 0, F.split(single, "")).otherwise(F.array().cast("array<string>")), start, step)


def bytes_of_long(c: Column) -> Column:
    """Eight bytes, least significant first."""
    return F.array(*[F.shiftrightunsigned(c.cast("long"), 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(8)])


def bytes_of_double(c: Column) -> Column:
    """The bits of a double, least significant byte first. There is no bit cast; the layout is computed: sign, exponent,
    fraction (normal and subnormal numbers, zeros and infinities; any NaN is the quiet one)."""
    a = F.abs(c)
    e = F.greatest(F.floor(F.log2(a)).cast("long"), F.lit(-1022).cast("long"))
    e = F.when(F.pow(F.lit(2.0), e.cast("double")) > a, e - 1).when(F.pow(F.lit(2.0), (e + 1).cast("double")) <= a, e + 1).otherwise(e)
    scaled = a / F.pow(F.lit(2.0), e.cast("double"))
    normal = F.shiftleft(e + 1023, 52) + ((scaled - 1) * F.lit(float(1 << 52))).cast("long")
    tiny = (a * F.pow(F.lit(2.0), F.lit(537.0)) * F.pow(F.lit(2.0), F.lit(537.0))).cast("long")
    bits = F.when(F.isnan(c), F.lit(0x7FF8000000000001)).when(a == float("inf"), F.lit(0x7FF0000000000000)).when(a == 0, F.lit(0).cast("long")).when(
        a < F.lit(2.2250738585072014e-308), tiny).otherwise(normal)
    negative = c.cast("string").startswith("-")
    return bytes_of_long(F.when(negative, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits))


def with_fnv1a_mod(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``df`` with FNV-1a of a key modulo ``n`` (null for a null key): strings by their bytes, numbers by eight bytes, anything
    else by its text. A number's bytes are taken one projection each, all of them in one piece of generated code. The result
    is exploded from an array of one: a filter on it reads it, where Spark would else move the filter below the projections
    and spell all of them out in it, three times as often with each byte."""
    kind, c = df.schema[key].dataType.simpleString(), F.col(f"`{key}`")
    high, low = f"_{name}_high", f"_{name}_low"
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        data = f"_{name}_bytes"
        out = df.withColumns({data: bytes_of_double(c.cast("double")) if kind in ("float", "double") else c.cast("long"),
                              high: F.lit(BASIS_HIGH).cast("long"), low: F.lit(BASIS_LOW).cast("long")})
        for i in range(8):
            byte = F.get(data, F.lit(i)).cast("long") if kind in ("float", "double") else F.shiftrightunsigned(data, 8 * i).bitwiseAND(F.lit(255))
            h, w = _step(F.col(high), F.col(low), byte)
            out = out.withColumns({high: h, low: w})
        out = out.drop(data)
    else:
        hashed = f"_{name}_hash"
        out = df.withColumn(hashed, _of_string(c.cast("string")))
        out = out.withColumns({high: F.col(hashed)["high"], low: F.col(hashed)["low"]}).drop(hashed)
    value = (((F.col(high) % n) * ((1 << 32) % n) + F.col(low) % n) % n).cast("int")
    kept = [F.col(f"`{x}`") for x in df.columns if x != name]
    return out.select(*kept, F.explode(F.array(F.when(c.isNotNull(), value))).alias(name))
