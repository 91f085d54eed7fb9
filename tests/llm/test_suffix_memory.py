"""Memory that op4 takes for the texts of one batch."""

import random
import tracemalloc

import pyarrow as pa

from tideline.llm import suffix_dedup


def test_anchors_of_a_batch_take_little_memory():
    rng = random.Random(1)
    body = pa.array([bytes(rng.choices(b"abcdefgh ", k=2000)) for _ in range(5000)], pa.binary())
    keys = pa.array(range(5000), pa.int64())
    suffix_dedup.anchor_rows(body[:10], keys[:10], keys[:10])
    tracemalloc.start()
    try:
        suffix_dedup.anchor_rows(body, keys, keys)
        assert tracemalloc.get_traced_memory()[1] < 160 << 20
    finally:
        tracemalloc.stop()
