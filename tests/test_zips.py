"""Zip packages by ranges of entries against the zipfile module."""

import io
import zipfile

from conftest import rows
from shipyard.operators import scripts as X
from shipyard.sources import zips as Z


def make(path, entries, method=zipfile.ZIP_DEFLATED, cut=None):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    path.write_bytes(raw.getvalue()[:cut] if cut else raw.getvalue())


def test_contents_by_range_equal_zipfile(spark, tmp_path):
    import random

    rng = random.Random(1)
    want = {}
    for k, method in enumerate([zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED]):
        entries = [(f"d/{i}.sql", rng.randbytes(rng.randrange(0, 3000)) * rng.randrange(1, 9)) for i in range(300)]
        entries.append(("d/big.sql", b"x" * (9 << 20)))
        make(tmp_path / f"z{k}.zip", [("d/", b""), *entries], method)
        want |= {(f"z{k}.zip", n): d for n, d in entries}
    make(tmp_path / "empty.zip", [])
    make(tmp_path / "cut.zip", [("a", b"b" * 500)], cut=60)
    found = Z.zip_contents(Z.zip_index(spark, str(tmp_path)), partitions=7)
    got = {(r.path.rsplit("/", 1)[1], r.entry_name): bytes(r.content) if r.content is not None else r._error for r in found.collect()}
    assert got.pop(("cut.zip", None)) == "unreadable package: BadZipFile"
    assert got == want


def test_damaged_entry_is_an_error_row(spark, tmp_path):
    make(tmp_path / "a.zip", [("x", b"first" * 50), ("y", b"second" * 50)], zipfile.ZIP_STORED)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[data.index(b"firstfirst") + 3] ^= 1
    (tmp_path / "a.zip").write_bytes(bytes(data))
    got = {r.entry_name: (r.content and bytes(r.content), r._error) for r in Z.zip_contents(Z.zip_index(spark, str(tmp_path))).collect()}
    assert got == {"x": (None, "unreadable entry: entry does not match its checksum"), "y": (b"second" * 50, None)}


def test_packages_equal_the_whole_file_scan(spark, tmp_path):
    pre = "products/A/database/pre/"
    make(tmp_path / "one.zip", [(pre + "b.sql", "old é".encode("latin-1")), (pre + "sub/a.sql", b"1"), ("products/B/database/pre/c.sql", b"2"),
                                (pre + "b.sql", b"new"), ("other.txt", b"3")])
    make(tmp_path / "bad.zip", [("a", b"b" * 500)], cut=40)
    packages = spark.createDataFrame([("m1", "one.zip", "A", "s1", "1"), ("m2", "one.zip", "B", "s2", "1"), ("m1", "bad.zip", "A", "s3", "1")],
                                     "msg_id string, filename string, productName string, scriptId string, version string")
    got = X.scan_packages(spark, str(tmp_path), packages)
    old = X.scan_script_packages(spark, str(tmp_path), packages)
    cols = ["msg_id", "filename", "productName", "scriptId", "version", "name", "phase", "content"]
    assert rows(got, *cols) == rows(old, *cols)
    assert rows(X.package_scripts(got), "msg_id", "filename", "name", "name_pos", "content") == [
        ("m1", "one.zip", "b.sql", 0, "new"), ("m1", "one.zip", "sub/a.sql", 1, "1"), ("m2", "one.zip", "c.sql", 0, "2")]
    assert rows(X.scripts_per_package(got), "filename", "scriptId", "n_scripts") == [("bad.zip", "s3", 0), ("one.zip", "s1", 3), ("one.zip", "s2", 1)]
