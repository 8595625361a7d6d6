import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import pages as PG
from tessera.sinks import writers as W
from tessera.sources import dump as SD
from tessera.sources import files as SF

DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/">
  <page><title>Algebra</title><ns>0</ns><id>10</id><revision><id>99</id>
    <text xml:space="preserve">'''A''' [[Category:Math]] [1]</text></revision></page>
  <page><title>Geo</title><ns>0</ns><id>276</id><revision><id>10</id>
    <text xml:space="preserve">geo</text></revision></page>
  <page><title>NoText</title><ns>0</ns><id>277</id><revision><id>11</id>
    <text xml:space="preserve" /></revision></page>
</mediawiki>
"""


def test_dump_page_ids_and_incomplete(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "dump.xml")
    with open(p, "w") as f:
        f.write(DUMP)
    pages = SD.scan_dump(spark, p)
    got = sorted((r["id"], r["title"], r["text"]) for r in pages.collect())
    assert got == [(10, "Algebra", "'''A''' [[Category:Math]] [1]"), (276, "Geo", "geo")]
    # ids {10}: the revision id 10 of page 276 must not select page 276
    ids = spark.createDataFrame([(10,)], "id long")
    assert [r["id"] for r in PG.semi_join_ids(pages, ids, "id").collect()] == [10]


def test_id_list_and_doc_folder(spark, tmpdir_path):
    ids_path = os.path.join(tmpdir_path, "ids")
    df = spark.createDataFrame([(3,), (1,), (3,)], "page_id long")
    assert W.write_id_list(df, ids_path) == 3
    assert sorted(r["id"] for r in SF.scan_id_list(spark, ids_path).collect()) == [1, 3]
    folder = os.path.join(tmpdir_path, "docs")
    os.makedirs(folder)
    for doc_id, body in [(5, "Title five\nline a\n\nline b"), (12, "Twelve\nx")]:
        with open(os.path.join(folder, f"id_{doc_id}.txt"), "w") as f:
            f.write(body)
    docs = {r["doc_id"]: (r["title"], r["text"]) for r in SF.scan_documents(spark, folder).collect()}
    assert docs == {5: ("Title five", "line a\n\nline b"), 12: ("Twelve", "x")}
    lines = sorted((r["doc_id"], r["line_no"], r["line"]) for r in SF.scan_doc_lines(spark, folder).collect())
    assert lines[:4] == [(5, 0, "Title five"), (5, 1, "line a"), (5, 2, ""), (5, 3, "line b")]


def test_documents_text_round_trip_and_metrics(spark, tmpdir_path):
    docs = spark.createDataFrame([(1, "t1", "a\nb"), (2, "t2", "c")], "doc_id long, title string, text string")
    out = os.path.join(tmpdir_path, "docs")
    W.write_documents(docs, out, fmt="text")
    back = {r["doc_id"]: (r["title"], r["text"]) for r in
            SF.scan_documents(spark, out, id_from="partition", strip_final_newline=True).collect()}
    assert back == {1: ("t1", "a\nb"), 2: ("t2", "c")}
    m = os.path.join(tmpdir_path, "metrics")
    row = spark.createDataFrame([("r", 1, "loss", 0.5)], "run string, iteration long, metric string, value double")
    W.write_metrics(row, m)
    W.write_metrics(row.withColumn("iteration", F.lit(2)), m)
    assert spark.read.parquet(m).count() == 2


def test_streaming_folder(spark, tmpdir_path):
    from tessera.streaming import folder as ST
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for doc_id, body in [(1, "T1\nhello [1]\n \nCategory:X"), (2, "T2\nworld")]:
        with open(os.path.join(src, f"id_{doc_id}.txt"), "w") as f:
            f.write(body)
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    q = ST.clean_folder(spark, src, out, ck)
    q.awaitTermination(120)
    got = {r["doc_id"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "hello \nX", 2: "world"}


def test_streaming_running_word_counts(spark, tmpdir_path):
    from tessera.streaming import folder as ST
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "id_1.txt"), "w") as f:
        f.write("T\nthe cat the hat")
    counts = ST.running_word_counts(spark, src, stop_words=["the"])
    q = (counts.writeStream.format("memory").queryName("wc_test").outputMode("complete")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    q.processAllAvailable()
    with open(os.path.join(src, "id_2.txt"), "w") as f:
        f.write("U\ncat and dog")
    q.processAllAvailable()
    got = {r["word"]: r["count"] for r in spark.table("wc_test").collect()}
    q.stop()
    assert got == {"cat": 2, "hat": 1, "and": 1, "dog": 1}


def test_dump_first_or_last_revision(spark, tmpdir_path):
    xml = ("<mediawiki><page><title>P</title><ns>0</ns><id>1</id>"
           "<revision><id>5</id><text>old</text></revision>"
           "<revision><id>6</id><text>new</text></revision>"
           "<revision><id>7</id><text /></revision></page></mediawiki>")
    p = os.path.join(tmpdir_path, "d.xml")
    with open(p, "w") as f:
        f.write(xml)
    assert SD.scan_dump(spark, p).first()["text"] == "new"
    assert SD.scan_dump(spark, p, revision="first").first()["text"] == "old"


def test_malformed_pages_are_shown_or_fail(spark, tmpdir_path):
    page = "<page><title>{}</title><ns>0</ns><id>{}</id><revision><id>5</id><text>t</text></revision></page>"
    p = os.path.join(tmpdir_path, "m.xml")
    with open(p, "w") as f:
        f.write("<mediawiki>" + page.format("A", 1) + page.format("B", "oops") + "</mediawiki>")
    assert [r["id"] for r in SD.scan_dump(spark, p).collect()] == [1]
    bad = SD.malformed_pages(spark, p).collect()
    assert len(bad) == 1 and "oops" in bad[0]["source"]
    with pytest.raises(Exception):
        SD.scan_dump(spark, p, mode="FAILFAST").collect()


def test_drop_scratch(spark):
    from tessera.session import drop_scratch, materialize
    t = materialize(spark.range(3), "scratch-test")
    assert t.count() == 3
    assert drop_scratch(spark)


def test_one_file_per_document(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "files")
    long_text = "x\n" * 50_000
    docs = spark.createDataFrame([(1, "t1", "a\nb"), (2, "é", "c\n"), (3, "t", ""), (4, None, "no title"), (None, "t", "no id"), (5, "t", long_text)],
                                 "doc_id long, title string, text string").repartition(4)
    W.write_documents(docs, out, fmt="files")
    assert sorted(os.listdir(out)) == ["id_1.txt", "id_2.txt", "id_3.txt", "id_5.txt"]
    with open(os.path.join(out, "id_2.txt"), encoding="utf-8") as f:
        assert f.read() == "é\nc\n"
    back = {r["doc_id"]: (r["title"], r["text"]) for r in SF.scan_documents(spark, out).collect()}
    assert back == {1: ("t1", "a\nb"), 2: ("é", "c\n"), 3: ("t", ""), 5: ("t", long_text)}
    W.write_documents(docs.where("doc_id = 1"), out, fmt="files")  # overwrites
    assert os.listdir(out) == ["id_1.txt"]


def test_failed_file_job_leaves_nothing(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "files")
    docs = spark.createDataFrame([(i, "t", "x") for i in range(20)] + [(7, "t", "again")], "doc_id long, title string, text string")
    with pytest.raises(Exception, match="two documents with id 7"):
        W.write_documents(docs, out, fmt="files")
    assert not os.path.exists(out) or os.listdir(out) == []
    W.write_documents(docs.where("doc_id <> 7"), out, fmt="files")
    with pytest.raises(Exception, match="two documents with id 7"):
        W.write_documents(docs, out, fmt="files")
    assert len(os.listdir(out)) == 19  # what was there stays


def test_many_small_files_share_a_task(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "files")
    W.write_documents(spark.range(300).selectExpr("id AS doc_id", "'t' AS title", "'x' AS text"), out, fmt="files")
    docs = SF.scan_documents(spark, out)
    assert docs.count() == 300 and docs.rdd.getNumPartitions() < 100


def test_vector_store_reads_only_the_ranges_it_needs(spark, tmpdir_path):
    from tessera.sinks import vector_store as VS
    rows = [(i * 3, [float(i), 1.0]) for i in range(1000)]
    df = spark.createDataFrame([*rows, (30, [9.0, 9.0]), (None, [0.0, 0.0])], "doc_id long, features array<double>")
    VS.write_vectors(df, tmpdir_path, parts=8)
    assert sorted(tuple(r["features"]) for r in VS.read_vector(spark, tmpdir_path, 30).collect()) == [(9.0, 9.0), (10.0, 1.0)]
    assert VS.read_vector(spark, tmpdir_path, 31).count() == 0 and VS.read_vector(spark, tmpdir_path, 10**9).count() == 0
    after, seen = None, []
    while True:
        page = [r["doc_id"] for r in VS.read_page(spark, tmpdir_path, after, 170).collect()]
        if not page:
            break
        seen += page
        after = page[-1]
    assert seen == sorted([i * 3 for i in range(1000)] + [30])
    point = VS.read_vector(spark, tmpdir_path, 1500)
    page = VS.read_page(spark, tmpdir_path, 1500, 50)
    for df in (point, page):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and "PushedFilters: [IsNotNull(doc_id)" in plan
    files = lambda d: {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    assert len(files(point)) == 1 and len(files(VS.read_page(spark, tmpdir_path, 1500, 50).select("doc_id", "features"))) <= 2


def test_files_are_read_without_a_record_reader_each(spark, tmpdir_path):
    import gzip
    for name, body in [("id_1.txt", b"t\nx\r\ny\n"), ("id_2.txt", b""), ("id_3.txt", b"\xef\xbb\xbft\nnot utf-8 \xff\x00"), ("_hidden.txt", b"h\nh"), ("note.md", b"n")]:
        with open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(body)
    for name in ("id_4.txt.gz", "id_5.txt.GZ"):
        with gzip.open(os.path.join(tmpdir_path, name), "wb") as f:
            f.write(b"zip\nped")
    files = SF.read_whole_files(spark, tmpdir_path)
    raw = spark.read.text(tmpdir_path, wholetext=True)  # what the text source gives
    expect = raw.select(SF.T.doc_id_from_file_name(F.col("_metadata.file_name")).alias("doc_id"), F.hex("value").alias("v")).collect()
    assert sorted(map(str, files.select("doc_id", F.hex("value").alias("v")).collect())) == sorted(map(str, expect))
    assert {r["doc_id"]: r["title"] for r in SF.scan_documents(spark, tmpdir_path).where("doc_id > 3").collect()} == {4: "zip", 5: "zip"}
    for df in (SF.scan_documents(spark, tmpdir_path), SF.scan_doc_lines(spark, tmpdir_path)):
        assert "FileScan binaryFile" in df._jdf.queryExecution().executedPlan().toString()


def test_large_folder_is_listed_and_dealt_by_the_executors(spark, tmpdir_path, monkeypatch):
    import gzip
    plain = os.path.join(tmpdir_path, "plain")
    os.makedirs(plain)
    bodies = {"id_1.txt": b"t\nx\r\ny\n", "id_2.txt": b"", "id_3.txt": b"\xef\xbb\xbft\nnot utf-8 \xff\x00", "a b%20;#?é.txt": b"n", "_hidden.txt": b"h", ".dot": b"h",
              "_k=1.txt": b"seen", "id_6.txt._COPYING_": b"part", **{f"id_{i}.txt": b"t\n" + b"x" * i for i in range(10, 60)}}
    for name, body in bodies.items():
        with open(os.path.join(plain, name), "wb") as f:
            f.write(body)
    os.makedirs(os.path.join(plain, "_staging"))
    mixed = os.path.join(tmpdir_path, "mixed [1]")
    os.makedirs(mixed)
    with open(os.path.join(mixed, "id_1.txt"), "wb") as f:
        f.write(b"t\nx")
    for name in ("id_4.txt.gz", "id_5[x].txt.GZ"):
        with gzip.open(os.path.join(mixed, name), "wb") as f:
            f.write(b"zip\nped")
    nested = os.path.join(tmpdir_path, "nested")
    W.write_documents(spark.createDataFrame([(i, "t", "x") for i in range(5)], "doc_id long, title string, text string"), nested, fmt="text")

    def rows(path, id_from="file_name"):
        lines = SF.scan_doc_lines(spark, path, id_from, strip_final_newline=False).select("doc_id", "file_name", "line_no", F.hex("line"))
        return [sorted(map(str, df.collect())) for df in (SF.read_whole_files(spark, path, id_from), SF.scan_documents(spark, path, id_from), lines)]

    literal = mixed.replace("[", "\\[")
    before = [rows(plain), rows(f"file:{plain}/"), rows(nested, "partition")]
    assert [len(x) for x in before[0][:2]] == [54, 54] and len(before[2][0]) == 5
    few = rows(literal)
    monkeypatch.setattr(SF, "FILES_INDEXED", 2, raising=False)
    monkeypatch.setattr(SF, "FILES_PER_TASK", 10, raising=False)
    assert [rows(plain), rows(f"file:{plain}/"), rows(nested, "partition")] == before
    for df in (SF.scan_documents(spark, plain), SF.scan_doc_lines(spark, plain)):
        assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() >= 6
    assert rows(literal) == few and len(few[0]) == 3
    os.rename(mixed, os.path.join(tmpdir_path, "mixed"))
    path = lambda df: df.select("_file.file_path", "_file.file_name")
    dealt = sorted(map(tuple, path(SF._whole_files(spark, plain)).collect()))
    assert dealt == sorted(map(tuple, path(spark.read.text(plain, wholetext=True).select(F.col("_metadata").alias("_file"))).collect()))
    many = SF.read_whole_files(spark, os.path.join(tmpdir_path, "mixed"))
    assert sorted(map(str, many.collect())) == few[0]
    assert "FileScan binaryFile" not in many._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_to_write_files(spark, tmpdir_path):
    docs = spark.range(0, 4000, 1, 5).selectExpr("id AS doc_id", "'t' AS title", "repeat(sha2(string(id), 512), 20) AS text")
    tracker, group = spark.sparkContext.statusTracker(), "write-files"
    spark.sparkContext.setJobGroup(group, group)
    W.write_documents(docs, os.path.join(tmpdir_path, "files"), fmt="files")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    last = tracker.getJobInfo(max(tracker.getJobIdsForGroup(group)))  # the one that writes
    assert len(last.stageIds) == 1
    assert len(os.listdir(os.path.join(tmpdir_path, "files"))) == 4000
