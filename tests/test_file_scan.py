"""Files read by tasks: the same records as Spark's CSV reader gives, without a
listing on the driver."""

import os
import random

import pytest

from feedmerge.plans import feed_files as ff
from feedmerge.sources import feeds, files as fl

ODD = {
    "plain.csv": b"sku,qty\na,1\nb,2\n", "no end.csv": b"sku,qty\na,1\nb,", "blank.csv": b"\n\nsku,qty\n\n\na,1\n\n",
    "empty.csv": b"", "newlines.csv": b"\n\n", "head.csv": b"sku,qty\n", "long.csv": b"sku\na,b,c,d\n",
    "commas.csv": b"sku,qty\n,\n,,\n", "cr.csv": b"sku,qty\r\na,1\r\nb,2\r\n", "oldmac.csv": b"sku,qty\ra,1\r",
    "bom.csv": b"\xef\xbb\xbfsku,qty\na,1\n", "bytes.csv": b"sku,qty\n\xff\xfe,1\n", "spaces.csv": b"sku,qty\n  \n a , 1 \n\t\n",
    "quoted.csv": b'sku,"q,ty"\n"a ""x"", b",1\n"",""\n"b",2\n', "lines.csv": b'sku,qty\n"a\nb",1\nc,2\n',
    "inch.csv": b'sku,qty\nscrew 5",1\n6" nail,2" x\n', "open.csv": b'sku,qty\n"a,1\nb,2\n', "after.csv": b'sku,qty\n"a" b,1\nc,2\n',
    "zero.csv": b"sku,qty\na\0b,1\n", "wide.csv": (",".join(f"c{i}" for i in range(16)) + "\n" + "1," * 15 + "1\n").encode(),
    "ulm ü%41#+a.csv": "sku,qty\nüber,1\n ,2\n".encode(), "hash.csv": b"#sku,qty\n#a,1\n\\,2\n", "one.csv": b"x",
    "rows wide.csv": b"a,b\n" + b"1," * 40 + b"\n",
}


def _records(found):
    files, rows = found
    return (sorted((r.source_file, r.header) for r in files.select("source_file", "header").collect()),
            sorted((r.source_file, r.row_number, [v for v in r["values"][:40]] + [None] * (40 - len(r["values"])))
                   for r in rows.collect()) if rows.limit(1).count() else [])


def _key(records):
    return (records[0], sorted((f, n, [(v is None, v or "") for v in vs]) for f, n, vs in records[1]))


def _write(root, contents):
    os.makedirs(root)
    for name, data in contents.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(data)
    return [os.path.join(root, n) for n in contents]


@pytest.mark.parametrize("sep", [",", ";", "|"])
def test_records_are_those_of_the_csv_reader(spark, tmp_path, sep):
    rng = random.Random(7)
    made = {n: d.replace(b",", sep.encode()) for n, d in ODD.items()}
    for k in range(40):
        made[f"r{k}.csv"] = "".join(rng.choices(["a", "b", sep, sep, "\n", "\n", '"', " ", "7", "é", '"x"', f'{sep}"y"{sep}'],
                                                [9, 9, 9, 9, 6, 6, k % 3, 2, 9, 2, 4, 4], k=60)).encode()
    paths = _write(str(tmp_path / "in"), made)
    want = _key(_records(feeds._read_feeds(spark, paths, delimiter=sep)))
    assert _key(_records(feeds.scan_feeds(spark, paths, delimiter=sep))) == want
    # many of them without that reader
    read = fl.plain_texts(fl.list_tree(spark, paths), sep, 16).collect()
    plain = {os.path.basename(r.source_file) for r in read if r._text is not None}
    assert {"plain.csv", "no end.csv", "blank.csv", "commas.csv", "quoted.csv"} <= plain
    assert not plain & {"cr.csv", "bom.csv", "bytes.csv", "spaces.csv", "lines.csv", "inch.csv", "open.csv", "after.csv", "wide.csv"}


def test_the_csv_reader_gets_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    _write(root, {f"{k}.csv": b'sku,qty\n"a\nb",%d\n' % k for k in range(7)} | {"plain.csv": b"sku,qty\nx,9\n"})
    calls, read = [], feeds.read_positional
    monkeypatch.setattr(feeds, "READ_AT_ONCE", 3)
    monkeypatch.setattr(feeds, "read_positional", lambda s, p, **o: calls.append(p) or read(s, p, **o))
    found = feeds.scan(spark, root)
    assert sorted(map(len, calls)) == [1, 3, 3] and found.files.count() == 8
    want = sorted(("a\nb", str(k)) for k in range(7)) + [("x", "9")]
    assert sorted(tuple(r["values"][:2]) for r in found.rows.collect()) == want
    layout = found.files.selectExpr("source_file", "size(header) n")
    assert sorted((*r["values"][:2], r.n, r.row_number) for r in found.rows_of(layout).collect()) == [(*w, 2, 2) for w in want]


def test_feed_files_are_scanned_without_a_file_index(spark, tmp_path, monkeypatch):
    """Spark's index of files lies on the driver, a few kilobytes a file."""
    root = ff.write_feed_files(spark, "/root/testdata/sf0.001", str(tmp_path / "feeds"))
    monkeypatch.setattr(feeds, "read_positional", None)
    found = feeds.scan(spark, root)
    n = sum(len(names) for _, _, names in os.walk(root))
    assert found.files.count() == n
    assert found.rows.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    # layouts are joined to files, not to rows
    plan = found.rows_of(found.files)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_tree_is_listed_as_spark_lists_it(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "in")
    for folder in ("a=1/b=x", "a=1/b=y/c=3", "a=2", "_temporary/0", ".hidden", "_p=7/q"):
        _write(os.path.join(root, folder), {"f.csv": b"12345", "_SUCCESS": b"", ".f.csv.crc": b"x", "empty": b""})
    want = sorted((r.path, r.length) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True)
                  .load(root).select("path", "length").collect())  # this reader leaves out empty files
    for tasks in (64, 1):  # level by level, and whole subtrees
        monkeypatch.setattr(fl, "tasks_for", lambda s, n=None: tasks)
        got = sorted(map(tuple, fl.list_tree(spark, root).collect()))
        assert [x for x in got if x[1]] == want and len(want) == 4 and len(got) == 8
    assert fl.list_tree(spark, [f"file://{root}/a=2/f.csv"]).first().path == f"file:{root}/a=2/f.csv"
    with pytest.raises(Exception, match="FileNotFound"):
        fl.list_tree(spark, root + "/none")


def test_digests_and_lines_of_files(spark, tmp_path, monkeypatch):
    import hashlib
    monkeypatch.setattr(fl, "STEP", 3)  # ends of lines fall on the ends of what is read
    made = {n: d for n, d in ODD.items() if d}
    paths = _write(str(tmp_path / "in"), made)
    got = {os.path.basename(r.path): r for r in fl.digests(fl.list_tree(spark, paths)).collect()}
    text = spark.read.text(paths).select(feeds.file_path().alias("n"))
    lines = {os.path.basename(r.n): r["count"] for r in text.groupBy("n").count().collect()}
    for name, data in made.items():
        assert (got[name].n_bytes, got[name].sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert got[name].n_lines == lines[name], name


def test_copies_are_checked_without_a_file_index(spark, monkeypatch):
    """Four scans of all files and copies held each file's status on the driver four times."""
    from feedmerge.plans.catalog import REGISTRY
    from pyspark.sql.readwriter import DataFrameReader
    loads, load = [], DataFrameReader.load
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **o: loads.append(a) or load(self, *a, **o))
    monkeypatch.setattr(DataFrameReader, "text", None)
    rows = REGISTRY["bronze_copy"](spark, "/root/testdata/sf0.001").collect()
    assert rows and not loads and all(r.same_bytes and r.n_lines > 1 for r in rows)
    assert sum(r.n_lines - 1 for r in rows) == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_a_copy_that_is_not_the_file_is_found(spark, monkeypatch):
    from feedmerge.plans import catalog
    copy = catalog.copies.copy_files

    def spoiled(files, root, **o):
        done = copy(files, root, **o)
        path = sorted(os.path.join(d, n) for d, _, names in os.walk(root.removeprefix("file://")) for n in names)[0]
        with open(path, "r+b") as f:
            f.write(b"#")
        return done
    monkeypatch.setattr(catalog.copies, "copy_files", spoiled)
    rows = catalog.REGISTRY["bronze_copy"](spark, "/root/testdata/sf0.001").collect()
    assert [r.same_bytes for r in rows].count(False) == 1
