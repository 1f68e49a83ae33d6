"""Ids, set and sequence digests, perceptual hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def keyframe_uid(video_id: Column, shot_id: Column, index: Column) -> Column:
    """Positive 63-bit id: the first 8 bytes of BLAKE2b of ``video:shot:index``, shifted right once.

    No built-in has BLAKE2b, so this is one of the library's few Arrow functions.
    """

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") >> 1)

    return F.pandas_udf(run, "long")(F.concat_ws(UID_SEPARATOR, video_id, shot_id, index.cast("string")))


#: Parts of an id's text are joined by this (fixed value).
UID_SEPARATOR = ":"


def set_digest(ids: Column) -> Column:
    """Order-free digest of a column of ids in a group: sha256 of the sorted distinct ids, a line each.

    The sorted list is made in one place per group, so groups are sets of a bounded size (a
    batch, a shard); ``combine_digest`` is for sets of any size.
    """
    lines = F.array_join(F.transform(F.array_sort(F.collect_set(ids)), lambda x: x.cast("string")), "\n")
    return F.sha2(F.concat(lines, F.lit("\n")), 256)


def sequence_digest(position: Column, ids: Column) -> Column:
    listed = F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), ids.alias("i")))), lambda x: x["i"].cast("string"))
    return F.sha2(F.concat(F.array_join(listed, "\n"), F.lit("\n")), 256)


def combine_digest(ids: Column) -> Column:
    """Order-free digest that is summed piece by piece: for sets that no task can hold."""
    return F.sum(F.conv(F.substring(F.md5(ids.cast("string")), 1, 12), 16, 10).cast("decimal(20,0)"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    return F.bit_count(number(a).bitwiseXOR(number(b)))


def request_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)
