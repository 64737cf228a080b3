"""Archives read by runs of entries."""

import io
import zipfile

from pyspark.sql import functions as F

from folioforge.sources import files, zipped


def archive(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_one_archive_is_read_by_several_tasks_as_unzip_reads_it(spark, tmp_path):
    spark.dataSource.register(zipped.ZippedSource)
    odd = [("../up.md", "x"), ("/root.md", "x"), ("a.exe", "x"), ("A.md", "1"), ("a.md", "2"), ("#U4e2d.txt", "y"), ("dir/", "")]
    data = archive([(f"d/{i}.md", f"{i} " * 2000 + str(hash(i) % 97) * i) for i in range(60)] + odd)
    (tmp_path / "big.zip").write_bytes(data)
    (tmp_path / "stored.ZIP").write_bytes(archive([("s.md", "stored"), ("z.md", "")], zipfile.ZIP_STORED))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_bytes(data)
    got = spark.read.format("zipped").option("bytesPerPartition", 500).load(str(tmp_path))
    tasks = got.filter("archive = 'big.zip'").withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task")).first()[0]
    assert tasks > 3
    whole = [(p, bytearray((tmp_path / p).read_bytes())) for p in ("big.zip", "stored.ZIP", "broken.zip")]
    want = files.unzip(spark.createDataFrame(whole, "relativePath string, content binary"))
    rows = lambda df: sorted((r.archive, r.entry, r.size, None if r.content is None else bytes(r.content), r.skipped or "") for r in df.collect())
    assert rows(got) == rows(want)
    one = spark.read.format("zipped").option("maxEntries", 2).option("head", 4).load(f"file://{tmp_path}/big.zip")
    assert sorted((r.entry, bytes(r.content)) for r in one.filter("content IS NOT NULL").collect()) == [("d/0.md", b"0 0 "), ("d/1.md", b"1 1 ")]
    assert one.filter("skipped = 'over the limit'").count() > 50


def test_damaged_entries_and_empty_folders(spark, tmp_path):
    spark.dataSource.register(zipped.ZippedSource)
    data = bytearray(archive([("a.md", "plain text here"), ("b.md", "more")], zipfile.ZIP_STORED))
    data[data.index(b"plain")] = 0
    (tmp_path / "x.zip").write_bytes(bytes(data))
    got = {r.entry: (r.content and bytes(r.content), r.skipped) for r in spark.read.format("zipped").load(str(tmp_path)).collect()}
    assert got["b.md"] == (b"more", None) and got["a.md"][0] is None and "BadZipFile" in got["a.md"][1]
    (tmp_path / "empty").mkdir()
    assert spark.read.format("zipped").load(str(tmp_path / "empty")).collect() == []


def test_many_small_archives_cost_few_tasks(spark, tmp_path):
    spark.dataSource.register(zipped.ZippedSource)
    for i in range(60):
        (tmp_path / f"{i:02}.zip").write_bytes(archive([(f"{j}.md", f"{i} {j}") for j in range(3)]))
    (tmp_path / "none.zip").write_bytes(archive([]))
    (tmp_path / "broken.zip").write_bytes(b"no archive at all, but longer than the shortest")
    got = spark.read.format("zipped").option("bytesPerPartition", 64).option("maxPartitions", 7).load(str(tmp_path))
    assert 3 < got.rdd.getNumPartitions() <= 2 * 7
    rows = sorted((r.archive, r.entry, r.content and bytes(r.content), r.skipped) for r in got.collect())
    assert rows == sorted([(f"{i:02}.zip", f"{j}.md", f"{i} {j}".encode(), None) for i in range(60) for j in range(3)] + [("broken.zip", "", None, "not an archive")])
    opened = zipped._read
    try:
        zipped._read = None  # planning does not open what one task reads whole
        assert len(zipped.ZippedReader({"path": str(tmp_path)}).partitions()) == 1
    finally:
        zipped._read = opened
