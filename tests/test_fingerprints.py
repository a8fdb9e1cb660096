"""Fingerprints of files longer than one value may be, against hashlib."""

import gzip
import hashlib
import os
import random

import pytest

from strataline.functions.digest import Sha256
from strataline.plans import sc
from strataline.sources import log as L

MOST = 50_000
MARK = b"\xef\xbb\xbf"


def contents():
    rng = random.Random(5)
    some = rng.randbytes(400_003)
    return {
        "random": some, "ends_with_feed": some[:200_000] + b"\n", "ends_without": some[:200_000] + b"x", "two_feeds": some[:99_999] + b"\n\n",
        "marked": MARK + some[:150_000] + b"x", "marked_with_feed": MARK + some[:150_000] + b"\n", "mark_later": b"\n" + MARK + some[:90_000], "mark_twice": MARK + MARK + some[:90_000],
        "feeds": b"\n" * 70_001, "returns": b"\r\n" * 40_000 + b"\r", "zeros": bytes(300_000), "late_feed": bytes(250_000) + b"\n" + some[:60_000],
        "at_most": some[:MOST], "over_most": some[: MOST + 1], "short": b"a\nb", "packed.gz": gzip.compress(some[:120_000]), "not_packed.gz.parquet": gzip.compress(some[:120_000]), "a b%20c=d": some[:80_000],
    }


@pytest.fixture
def bounded(spark):
    """A session in which no value may be over MOST bytes, as none may be over 2 GB, with splits of 64 KB."""
    conf = {"spark.sql.sources.binaryFile.maxLength": str(MOST), "spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(folder, files):
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as out:
            out.write(data)
    return {os.path.basename(name): (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}


@pytest.mark.parametrize("stretch", [90_000, 128 << 20])
def test_files_over_the_bound_of_a_value(bounded, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(L, "STRETCH", stretch, raising=False)
    files = {k: v for k, v in contents().items() if k != "packed.gz"}
    want = written(tmp_path / "in", files)
    got = L.file_fingerprints(bounded, f"file://{tmp_path}/in").collect()
    assert len(got) == len(want)
    names = {f"file:{tmp_path}/in/{k}": v for k, v in want.items()}
    assert {r.path.replace("file:///", "file:/"): (r.length, r.sha256) for r in got} == names


def test_query_over_tables_in_parts(bounded, tmp_path):
    some = random.Random(6).randbytes(200_000)
    written(tmp_path, {"orders.parquet": some, "part.parquet": some[:10], "lineitem.parquet/part-0.parquet": some[:130_000], "lineitem.parquet/part-1.parquet": some[:20_000]})
    got = {r.file: (r.length, r.sha256) for r in sc.QUERIES["fn23_file_fingerprint"](bounded, str(tmp_path)).collect()}
    sizes = {"orders.parquet": 200_000, "part.parquet": 10, "lineitem.parquet/part-0.parquet": 130_000, "lineitem.parquet/part-1.parquet": 20_000}
    assert got == {k: (n, hashlib.sha256(some[:n]).hexdigest()) for k, n in sizes.items()}


def test_packed_files_are_hashed_as_they_lie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "WHOLE", 1000, raising=False)
    some = random.Random(7).randbytes(30_000)
    want = written(tmp_path, {"a.gz": gzip.compress(some), "b.deflate": some, "c.parquet": some})
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in L.file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == want
    # of a codec that the list of names lacks: what comes is not the file, so it is read whole
    monkeypatch.setattr(L, "_CODED", (".none",), raising=False)
    monkeypatch.setattr(L, "STRETCH", 7000, raising=False)
    written(tmp_path, {"b.deflate": b"x\x9c"})  # too short to be unpacked
    want = {k: v for k, v in want.items() if k != "b.deflate"}
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in L.file_fingerprints(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in want} == want


def test_a_state_goes_on():
    data = random.Random(8).randbytes(10_007)
    for cut in (0, 1, 63, 64, 65, 5000, 10_007):
        first = Sha256()
        first.update(data[:cut])
        rest = Sha256(first.state())
        rest.update(data[cut:])
        assert rest.hexdigest() == hashlib.sha256(data).hexdigest() and first.hexdigest() == hashlib.sha256(data[:cut]).hexdigest()
