"""File tables walked in rounds, nested and empty files, archives streamed member by member."""

import os
import resource
import tarfile
import zipfile

import pytest

from corpusrisk.sources import files
from corpusrisk.sources import readers as rd


def _w(path, data=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_file_table_of_nested_folders(spark, tmp):
    for name, data in (("a.c", b"1"), ("x/b.c", b""), ("x/y/z/c d.c", b"333"), ("x/y/e", b"")):
        _w(f"{tmp}/t/{name}", data)
    os.makedirs(f"{tmp}/t/none/at/all")
    want = [(f"{tmp}/t/a.c", 1), (f"{tmp}/t/x/b.c", 0), (f"{tmp}/t/x/y/e", 0), (f"{tmp}/t/x/y/z/c d.c", 3)]
    for form in (f"{tmp}/t", f"file:{tmp}/t", f"file://{tmp}/t/"):
        assert sorted((r["path"], r["size"]) for r in files.file_table(spark, form).collect()) == want
    assert [r["path"] for r in files.file_table(spark, f"{tmp}/t", recursive=False).collect()] == [f"{tmp}/t/a.c"]
    with pytest.raises(Exception):
        files.file_table(spark, f"{tmp}/missing").count()


def test_content_keeps_nested_and_empty_files(spark, tmp):
    _w(f"{tmp}/content/a", b"int x;")
    _w(f"{tmp}/content/b")
    _w(f"{tmp}/content/d/e", "é".encode())
    _w(f"{tmp}/content/d/f")
    got = {r["file"]: r["content"] for r in rd.read_content(spark, f"{tmp}/content").collect()}
    assert got == {"a": "int x;", "b": "", "d/e": "é", "d/f": ""}


def test_tree_keeps_empty_sources(spark, tmp):
    _w(f"{tmp}/tree/a/x.c", b"int a;")
    _w(f"{tmp}/tree/a/empty.c")
    _w(f"{tmp}/tree/a/empty.h")
    got = {os.path.basename(r["path"]): r["content"] for r in rd.read_tree(spark, f"{tmp}/tree").collect()}
    assert got == {"x.c": "int a;", "empty.c": ""}


def test_archives_are_streamed(spark, tmp, monkeypatch):
    monkeypatch.setattr(files, "BATCH_BYTES", 100)
    os.makedirs(f"{tmp}/arch")
    with zipfile.ZipFile(f"{tmp}/arch/p.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"p/{i}.c", f"f{i}();" * 9)
        z.writestr("p/no.txt", "x")
    with tarfile.open(f"{tmp}/arch/q.tar.gz", "w:gz") as t:
        for i in range(40):
            _w(f"{tmp}/src/{i}.c", f"g{i}();".encode())
            t.add(f"{tmp}/src/{i}.c", arcname=f"q/{i}.c")
    with zipfile.ZipFile(f"{tmp}/arch/empty.zip", "w"):
        pass
    got = {(os.path.basename(r["archive"]), r["path"]): r["content"] for r in rd.read_archives(spark, f"{tmp}/arch").collect()}
    assert got == {**{("p.zip", f"p/{i}.c"): f"f{i}();" * 9 for i in range(40)}, **{("q.tar.gz", f"q/{i}.c"): f"g{i}();" for i in range(40)}}
    _w(f"{tmp}/arch/r.rar", b"junk")
    with pytest.raises(Exception, match="unsupported archive"):
        rd.read_archives(spark, f"{tmp}/arch").collect()


def test_more_than_two_gigabytes_of_members_in_bounded_memory(tmp):
    """Read as a task reads them: one member is in memory at a time."""
    member = b"int x;\n" * (5 << 20)
    n = (2 << 30) // len(member) + 1
    with zipfile.ZipFile(f"{tmp}/big.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for i in range(n):
            z.writestr(f"m/{i}.c", member)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(len(data) for _, data in files._members(f"{tmp}/big.zip", ".c")) == n * len(member) > 2 << 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB
