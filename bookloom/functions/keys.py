"""A hash of the order id that any engine can compute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of a stored table by this hash.
SLOTS = 100


def order_hash(order_id: Column | str) -> Column:
    """The first 32 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(order_id), 1, 8), 16, 10).cast("bigint")


def key_slot(order_id: Column | str) -> Column:
    return (order_hash(order_id) % SLOTS).cast("int")
