"""Trees of digests over copies of a given table: equal, changed, cut, and missing files; empty ones are passed over."""

import hashlib
import os
import shutil

from docsift.operators import files

PART = "/root/testdata/sf0.01/part.parquet"


def test_stores_are_compared_by_digests(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    data = open(PART, "rb").read()
    for store in (a, b):
        os.makedirs(store / "deep")
        shutil.copyfile(PART, store / "deep" / "part.parquet")
        (store / "changed").write_bytes(data)
        (store / "cut").write_bytes(data)
        (store / "empty").write_bytes(b"")
    size = 1000
    tree = lambda p: files.digests(spark, str(p), size)
    assert {r.state for r in files.compare(tree(a), tree(b), size).collect()} == {"equal"}
    assert files.root(files.of_files(tree(a))) == files.root(files.of_files(tree(b)))
    at = 7 * size + 12
    (b / "changed").write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    (b / "cut").write_bytes(data[: len(data) - 5])
    (b / "more").write_bytes(b"x")
    os.remove(b / "deep" / "part.parquet")
    got = {r.file: (r.state, r.first_chunk, r.at) for r in files.compare(tree(a), tree(b), size).collect()}
    last = (len(data) - 1) // size
    assert got == {"changed": ("differs", 7, 7 * size), "cut": ("differs", last, last * size), "more": ("only_b", None, None), "deep/part.parquet": ("only_a", None, None)}
    assert files.root(files.of_files(tree(a))) != files.root(files.of_files(tree(b)))
    chunks = {r.chunk: r.digest for r in tree(a).where("file = 'cut'").collect()}
    assert chunks == {i: hashlib.sha256(data[i * size : (i + 1) * size]).hexdigest() for i in range(last + 1)}
