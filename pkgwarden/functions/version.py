"""Version ordering as Column expressions.

A version is cut into segments, and each segment becomes a number of four bytes, the most significant
first. The bytes of all segments, one after another, are the version's key: keys are compared byte by
byte, so the segments are compared in turn, and a shorter version that is a prefix of a longer one is the
smaller. A segment that is no number gets a number above the integer range, as versions need it after
every number. A key is a plain binary value: stored, it has statistics, and a comparison with a
literal key is pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The two characters that separate version segments, and the number that stands for
# a segment that is no 32-bit integer (one above the largest).
DOT, DASH = ".", "-"
UNPARSABLE_SEGMENT = 2147483648
#: Segments that are computed without a lambda; most versions have no more.
WRITTEN_OUT = 4


def _digits(segment: Column, unparsable: Column) -> Column:
    number = F.coalesce(segment.try_cast("int").cast("bigint"), unparsable)
    return F.lpad(F.hex(number), 8, "0")


def version_key(version: Column) -> Column:
    """``binary`` that sorts like the version; null for a null version.

    The first segments are written out: what needs no lambda is compiled. Make the version null where
    no key is wanted: below a condition the segments would be cut anew for every use.
    """
    # With one separator the split needs no regular expression.
    segments = F.split(F.replace(version, F.lit(DASH), F.lit(DOT)), rf"\{DOT}", -1)
    unparsable, count = F.lit(UNPARSABLE_SEGMENT), F.array_size(segments)

    def number(i: int) -> Column:
        absent = F.when(count > i, unparsable).otherwise(F.lit(0).cast("bigint"))
        return F.coalesce(F.get(segments, i).try_cast("int").cast("bigint"), absent)

    def pair(i: int) -> Column:
        """Two segments are one number of eight bytes; what is absent is cut off below."""
        return F.lpad(F.hex(F.shiftleft(number(i), 32).bitwiseOR(number(i + 1))), 16, "0")

    second = F.when(count > 2, pair(2)).otherwise(F.lit(""))
    first = F.substring(F.unhex(F.concat(pair(0), second)), F.lit(1), 4 * count)
    others = F.slice(segments, WRITTEN_OUT + 1, count)
    rest = F.array_join(F.transform(others, lambda segment: _digits(segment, unparsable)), "")
    return F.concat(first, F.when(count > WRITTEN_OUT, F.unhex(rest)).otherwise(F.lit(bytearray())))


def version_literal(spark: SparkSession, version: str | None) -> Column:
    """The key of one version as a literal, which a scan of stored keys can be filtered by."""
    key = spark.range(1).select(version_key(F.lit(version).cast("string"))).first()[0]
    return F.lit(None if key is None else bytearray(key)).cast("binary")


def version_at_least(version: Column, other: Column) -> Column:
    """True where ``version`` equals ``other`` or comes after it."""
    return version_key(version) >= version_key(other)


def version_key_text(key: Column) -> Column:
    """The key as comma-separated numbers, with an empty field for an unparsable segment."""
    places = F.sequence(F.lit(1), F.octet_length(key), F.lit(4))
    numbers = F.transform(places, lambda at: F.conv(F.hex(F.substring(key, at, F.lit(4))), 16, 10))
    return F.array_join(
        F.transform(
            numbers, lambda n: F.when(n == str(UNPARSABLE_SEGMENT), F.lit("")).otherwise(n)
        ),
        ",",
    )


def register_version_function(spark: SparkSession, name: str = "r_ver") -> None:
    """Make the version key callable from SQL text in this session.

    The first segments are written out: an expression without a lambda is computed once for a literal
    version, and compiled for a column.
    """
    segments = f"split(replace(v, '{DASH}', '{DOT}'), '\\\\{DOT}', -1)"

    def digits(segment: str, unparsable: str) -> str:
        return f"lpad(hex(coalesce(CAST(try_cast({segment} AS INT) AS BIGINT), {unparsable})), 8, '0')"

    first = []
    for i in range(WRITTEN_OUT):
        segment = f"get({segments}, {i})"
        unparsable = f"if({segment} IS NULL, NULL, {UNPARSABLE_SEGMENT}L)"
        first.append(f"coalesce({digits(segment, unparsable)}, '')")
    others = f"slice({segments}, {WRITTEN_OUT + 1}, size({segments}))"
    rest = f"array_join(transform({others}, segment -> {digits('segment', f'{UNPARSABLE_SEGMENT}L')}), '')"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS BINARY RETURN "
        f"unhex(concat({', '.join(first)}, CASE WHEN size({segments}) > {WRITTEN_OUT} THEN {rest}"
        f" WHEN v IS NOT NULL THEN '' END))"
    )
