"""Digests of a sequence's frame names, from hashes that are summed and never gathered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hashes of 64 bits that a digest is made of.
LANES = 4


def sequence_digest(idx: Column, name: Column) -> Column:
    """64 hex digits for the names of a group in their order, as an aggregate of fixed size.

    Each name is hashed with its idx, so an exchange of two changes the digest, and hashes are combined by exclusive
    or, so that the stretches of a sequence are combined wherever they lie. The count goes in at the end.
    """
    lanes = [F.lpad(F.hex(F.bit_xor(F.xxhash64(F.lit(k), idx, name))), 16, "0") for k in range(LANES)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *lanes), 256)
