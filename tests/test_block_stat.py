"""BlockStore.stat() hashes bytes where they are read."""

import hashlib

from lodestone.sources.block_store import BlockStore


def test_no_bytes_are_shuffled_for_stat(spark, tmp_path):
    """Before, rows with their bytes were shuffled to the versions that are visible."""
    store = BlockStore(spark, f"file://{tmp_path}/blocks")
    make = lambda *rows: spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id string, data binary")
    store.put(make(("a", b"1"), ("b", b""), ("c", b"3"), ("c", b"4")))
    one = {r.id: (r.size, r.checksum) for r in store.stat().collect()}
    store.put(make(("a", b"new")))
    store.delete(make(("b", b""), ("c", b""), ("none", b"")))
    store.put(make(("c", b"again")))
    sums = lambda **x: {i: (len(b), hashlib.sha256(b).hexdigest()) for i, b in x.items()}
    least = min(b"3", b"4", key=lambda b: hashlib.sha256(b).hexdigest())
    assert one == sums(a=b"1", b=b"", c=least)
    plan = store.stat()._jdf.queryExecution().executedPlan().toString()
    assert {r.id: (r.size, r.checksum) for r in store.stat().collect()} == sums(a=b"new", c=b"again")
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
