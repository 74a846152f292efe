"""Archives named ``.warc.gz``, of this and of other writers, are cut into byte ranges like any other."""

from __future__ import annotations

import gzip
import io
import random


import corpus_pipeline
from millrace.llm import warc


def foreign(i: int, body: bytes) -> bytes:
    """Members as other tools write them: a file name in the gzip header, other record types and digests, ids that are no numbers."""
    kind = ["warcinfo", "request", "response", "metadata", "resource"][i % 5]
    http = b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n" if kind == "response" else b""
    digest = ["sha1:" + "A" * 32, "sha256:" + "ab" * 32, "md5:xyz", ""][i % 4]
    head = [b"WARC/1.0", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:uuid:0000-{i}>".encode(), f"Content-Length: {len(http + body)}".encode(), b"X-Odd: \xff\xfe"]
    if digest:
        head.append(f"WARC-Payload-Digest: {digest}".encode())
    out = io.BytesIO()
    with gzip.GzipFile(filename=f"record-{i}.warc", mode="wb", fileobj=out) as z:
        z.write(b"\r\n".join(head) + b"\r\n\r\n" + http + body + b"\r\n\r\n")
    return out.getvalue()


def test_zipped_archives_are_split(spark, tmp_path):
    rng = random.Random(6)
    own = [warc.gzip_member(warc.record(i, f"http://h/{i}", body := rng.randbytes(rng.randint(0, 3000)), "00" * 20, len(body), None, False)) for i in range(120)]
    other = [foreign(i, rng.randbytes(700)) for i in range(60)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(x for pair in zip(own[:60], other) for x in pair))
    (tmp_path / "b.warc").write_bytes(b"".join(own[60:90]))
    (tmp_path / "c.WARC.GZ").write_bytes(b"".join(own[90:]))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("7000b", "0"), ("64m", "64m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            got = warc.read_warc(spark, str(tmp_path)).collect()
            mine = [r for r in got if r.row is not None]
            assert sorted(r.row for r in mine) == list(range(120)) and all(r.payload_bytes == len(r.payload) for r in mine)
            theirs = [r for r in got if r.row is None]
            assert len(theirs) == 60 and sorted({r.record_type for r in theirs}) == ["metadata", "request", "resource", "response", "warcinfo"]
            assert all(len(r.payload) == 700 for r in theirs if r.record_type == "response")
            blocks = warc._lines(spark, str(tmp_path)).select("file", "block").distinct().count()
            assert blocks == 3 if size == "64m" else blocks > 20
        assert warc.read_warc(spark, str(tmp_path / "a.warc.gz")).count() == 120 and warc.read_warc(spark, str(tmp_path / "*.warc*")).count() == 150
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_near_duplicates_do_not_depend_on_how_the_table_is_cut(spark, tmp_path):
    """Every read of the table is cut differently; one row of each group of copies stays all the same."""
    texts = [f"copy of the text number {i % 7} with enough words to be a document of its own" for i in range(200)]
    rows = [(None, t, "en", "s", len(t)) for t in texts]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(9).write.parquet(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    real = corpus_pipeline.jaccard_groups

    def groups(df, **options):
        out = real(df, **options)
        spark.conf.set("spark.sql.files.openCostInBytes", "64m")  # from here on, a file a task
        return out

    try:
        corpus_pipeline.jaccard_groups = groups
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(path), str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert sorted(r.text for r in out.collect()) == sorted(set(texts))
    finally:
        corpus_pipeline.jaccard_groups = real
        for k, v in old.items():
            spark.conf.set(k, v)
