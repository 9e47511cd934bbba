"""File manifests: any bytes, any dealing, any change."""

import random

from candlework.sources import readers as rd


def test_manifest_tells_every_change(spark, tmp_path):
    rng = random.Random(1)
    first, second = tmp_path / "first", tmp_path / "second"
    for folder in (first, second):
        (folder / "sub").mkdir(parents=True)
    blob = bytes(rng.randrange(256) for _ in range(200_000))
    files = {"a.bin": blob, "sub/b.bin": blob[:50_000], "c.txt": b"x\ny\n", "empty": b"", "nofeed": b"\x00" * 5000, "gone": b"1"}
    for name, data in files.items():
        (first / name).write_bytes(data)
    changed = {
        "a.bin": blob[:100_000] + bytes([blob[100_000] ^ 1]) + blob[100_001:],  # one bit
        "sub/b.bin": blob[:50_000],
        "c.txt": b"y\nx\n",  # the same pieces in another order
        "empty": b"\n",
        "nofeed": b"\x00" * 5001,
        "new": b"1",
    }
    for name, data in changed.items():
        (second / name).write_bytes(data)
    take = lambda path, **more: {r["file"]: (r["length"], r["sha256"]) for r in rd.file_manifest(spark, str(path), **more).collect()}
    before = take(first)
    assert {k: v[0] for k, v in before.items()} == {k: len(v) for k, v in files.items() if v}
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert take(first) == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    states = {r["file"]: r["state"] for r in rd.manifest_changes(rd.file_manifest(spark, str(first)), rd.file_manifest(spark, str(second))).collect()}
    assert states == {"a.bin": "changed", "sub/b.bin": "same", "c.txt": "changed", "empty": "added", "nofeed": "changed", "gone": "removed", "new": "added"}
    assert set(take(first, pattern="*.bin")) == {"a.bin", "sub/b.bin"}
