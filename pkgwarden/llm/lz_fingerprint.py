"""Lempel-Ziv phrase fingerprints: how much of one text a dictionary made from another explains.

A text is parsed from left to right; each phrase is the longest one already in the dictionary plus
one character, and enters the dictionary. The phrases' hashes form a set, of which the
``SIGNATURE`` smallest are kept. Texts that share passages share phrases, so the share of common
minimum hashes estimates the Jaccard likeness of the phrase sets.

An empty or null text has the empty fingerprint; two empty fingerprints are alike (1.0), an empty
and another are not (0.0). Equal texts have equal fingerprints. Sets smaller than the signature
are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pkgwarden.llm.codes import U64, SliceHasher, code_points, mix
from pkgwarden.llm.ordering import map_with_next

#: Minimum hashes kept of a text; the standard error of a likeness is at most 0.5 / sqrt(128).
SIGNATURE = 128


class PhraseParser:
    """An incremental parse: feed text piece by piece; a copy goes on from the same state."""

    __slots__ = ("ends", "phrase", "seen", "size")

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.ends: list[int] = []
        self.phrase, self.size = "", 0

    def copy(self) -> PhraseParser:
        other = PhraseParser()
        other.seen, other.ends = self.seen.copy(), self.ends.copy()
        other.phrase, other.size = self.phrase, self.size
        return other

    def feed(self, text: str) -> PhraseParser:
        seen, phrase = self.seen, self.phrase
        learn, put = seen.add, self.ends.append
        for end, character in enumerate(text, self.size + 1):
            phrase += character
            if phrase not in seen:
                learn(phrase)
                put(end)
                phrase = ""
        self.phrase = phrase
        self.size += len(text)
        return self

    def phrase_ends(self) -> list[int]:
        """Where each phrase ends; the last may be a phrase met before."""
        return [*self.ends, self.size] if self.phrase else self.ends


def phrase_ends(text: str) -> list[int]:
    return PhraseParser().feed(text).phrase_ends()


def signature(text: str, ends: list[int]) -> bytes:
    """The minimum hashes of the phrases, ascending, as packed 32-bit numbers."""
    cuts = np.array([0, *ends], np.int64)
    hasher = SliceHasher(mix(code_points(text).astype(U64)))
    hashes = (hasher(cuts[:-1], cuts[1:]) >> U64(32)).astype(np.uint32)
    return np.unique(hashes)[:SIGNATURE].tobytes()


def signature_of(text: str | None) -> bytes:
    text = text or ""
    return signature(text, phrase_ends(text))


def likeness_of(a: bytes | None, b: bytes | None) -> float:
    """Share of the smallest hashes of both sets that are in both."""
    a, b = a or b"", b or b""
    if a == b:
        return 1.0
    joined = np.concatenate((np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)))
    joined.sort()
    twice = joined[1:] == joined[:-1]
    first = np.concatenate(([True], ~twice))
    distinct = min(int(first.sum()), SIGNATURE)
    last = joined[first][distinct - 1]
    return float((joined[1:][twice] <= last).sum()) / distinct


@F.pandas_udf(T.BinaryType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([signature_of(t) for t in texts], dtype=object)


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as binary."""
    return _fingerprint(text)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    return _likeness(a, b)


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text."""
    return docs.withColumn(name, fingerprint(F.col(text)))


def edit_tails(
    docs: DataFrame, key: str = "doc_id", text: str = "text", quarter: int = 4
) -> DataFrame:
    """Fingerprint each text, and the text whose last ``1 / quarter`` is replaced by the head of
    the next row's text, in ascending order of the key (after the last comes the first).

    Returns the key, ``n_chars``, ``edited`` (the edited text), ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``. Rows without a key come last; rows
    of one key follow each other by text. The edited text goes on from the parse of the unchanged
    part. A task holds two texts at a time.
    """
    frame = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("t"))

    def start(row: tuple) -> tuple:
        text = row[1]
        kept = len(text) - len(text) // quarter
        parser = PhraseParser().feed(text[:kept])
        ends = parser.copy().feed(text[kept:]).phrase_ends()
        return row[0], text, kept, parser, signature(text, ends)

    def finish(own: tuple, following: tuple) -> tuple:
        key, text, kept, parser, mark = own
        tail = following[1][: len(text) - kept]
        edited = text[:kept] + tail
        edited_mark = signature(edited, parser.feed(tail).phrase_ends())
        return (
            key,
            len(text),
            edited,
            mark,
            edited_mark,
            likeness_of(mark, edited_mark),
            likeness_of(mark, following[4]),
        )

    schema = T.StructType(
        [
            T.StructField(key, T.LongType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited", T.StringType()),
            T.StructField("fingerprint", T.BinaryType()),
            T.StructField("edited_fingerprint", T.BinaryType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    return map_with_next(frame, "id", ["t"], start, finish, schema)
