"""Readers, writers and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import citations, lexical
from palimpsest.sources import files, indexes, records
from palimpsest.streaming import standing


def workbook(rows):
    cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheetData>{cells}</sheetData><hyperlinks><hyperlink ref="C2" r:id="a"/></hyperlinks></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships><Relationship Id="a" Target="http://x/"/></Relationships>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook([["Text", "Title", "Link", None, "Z"], ["one\ntwo", "t", "here"], [None, "u"]]))
    (tmp_path / "~$b.xlsx").write_bytes(b"lock")
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    got = {r.row: r for r in files.workbooks(spark, str(tmp_path)).withColumn("to", files.link_of(F.col("data"), F.col("links"), "link")).collect()}
    assert set(got) == {2, 3} and got[2].data == {"text": "one two", "title": "t", "link": "here"} and got[2].to == "http://x/" and got[3].data == {"title": "u"}
    assert [files.column_number(c) for c in ("A", "Z", "AA", "BA")] == [0, 25, 26, 52]


def test_word_and_html(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>a &amp;lt; b</w:t><w:tab/><w:t>c</w:t></w:p><w:p>d</w:p>")
    (tmp_path / "bad.docx").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: r.text for r in files.word_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "a < b\tc\nd\n", "bad.docx": None}
    (tmp_path / "p.html").write_bytes('<meta charset="latin-1">ação'.encode("cp1252"))
    assert files.html_files(spark, str(tmp_path)).first().html.endswith("ação")
    assert files.decoded("é".encode()) == "é" and files.decoded(b"\xef\xbb\xbfx") == "x" and files.decoded(b'charset="nope" \xe9').endswith("é")


def test_indexes(spark, tmp_path):
    corpus = spark.createDataFrame([("b1", 1, "Ação e energia"), ("b2", 2, "outra")], "book string, row int, text string")
    indexes.write_corpus(corpus, F.array("text"), "book", str(tmp_path / "corpus"))
    assert [r.row for r in lexical.search(spark.read.parquet(str(tmp_path / "corpus")), "acao").collect()] == [1]
    entries = citations.entries(corpus, "book", "row", "text")
    assert indexes.read_citations(spark, "s", str(tmp_path / "cite")) is None
    indexes.write_citations(entries, "s", str(tmp_path / "cite"))
    assert indexes.read_citations(spark, "other", str(tmp_path / "cite")) is None
    e, p = indexes.read_citations(spark, "s", str(tmp_path / "cite"))
    assert tuple(indexes.summary(e, p).first()) == (2, 2, 3)


def test_manifests(spark, tmp_path):
    for name, score in (("B", 0.7), ("a", "bad"), ("c", 3)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps({"id": name, "indexed_rows": 5, "recommended_min_score": score}, indent=1))
    assert [(r.id, r.recommended) for r in indexes.manifests(spark, str(tmp_path)).collect()] == [("a", 0.25), ("b", 0.7), ("c", 1.0)]
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "index_id string, pos int, text string")
    vectors = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0])], "index_id string, pos int, embedding array<double>")
    assert indexes.joined(rows, vectors).count() == 2
    with pytest.raises(ValueError):
        indexes.joined(rows.limit(1), vectors)


def test_records(spark):
    answers = spark.createDataFrame([(1, json.dumps({"items": [{"volumeInfo": {"title": "T", "authors": ["Ana B. Silva"], "publishedDate": "2001-05"}}]}), json.dumps({"message": {"items": [{"title": ["U"], "author": [{"given": "Rui", "family": "Sá"}], "issued": {"date-parts": [[1999]]}}]}}))], "q int, g string, c string")
    both = records.google_books(answers, "q", "g").unionByName(records.crossref(answers, "q", "c")).orderBy("titulo").collect()
    assert [(r.titulo, r.ano, r.autores[0].sobrenome, r.autores[0].nome) for r in both] == [("T", "2001", "Silva", "Ana B."), ("U", "1999", "Sá", "Rui")]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = standing.usage_windows(stream, "ts", "event_type", "value", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("usage").collect()}
    expected = {(r.s, r.event_type): r.n for r in events.groupBy(F.date_trunc("hour", "ts").alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == expected
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "docs"))
    rows = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    q = standing.standing_search(rows, F.array("text"), {"x": "eaux", "y": "eaux !que"}).select("doc_id", "query").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    batch = standing.standing_search(docs, F.array("text"), {"x": "eaux", "y": "eaux !que"}).select("doc_id", "query").collect()
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, batch)) and batch


def test_rebuilt_index(spark, tmp_path):
    from palimpsest.operators import semantic
    from palimpsest.sources import indexes, versions

    sheet = spark.createDataFrame([(2, {"text": " um texto ", "title": "T", "area": " "}), (3, {"text": " ", "title": "U"}), (4, {"text": " ".join(f"frase {i} do texto." for i in range(80)), "title": "V"})], "row int, data map<string,string>")
    rows, basis, warning = indexes.rows_to_rebuild(sheet, None, "a.xlsx", "Text", ["Title", "area"])
    assert basis == "source_file" and warning is None and [(r.row, r.metadata) for r in rows.orderBy("row").collect()] == [(2, {"Title": "T"}), (4, {"Title": "V"})]
    kept, basis, warning = indexes.rows_to_rebuild(None, rows, "a.xlsx")
    assert basis == "metadata_snapshot" and "metadata.json" in warning and kept is rows
    with pytest.raises(FileNotFoundError):
        indexes.rows_to_rebuild(None, rows, "a.xlsx", require=True)

    def embed(chunks):
        return chunks.withColumn("embedding", F.array(F.length("text").cast("double"), F.lit(3.0), F.col("pos").cast("double")))

    done = indexes.rebuild(rows, "ec", "EC", embed, str(tmp_path / "ec"), "m", basis, warning).first()
    folder = versions.current(spark, str(tmp_path / "ec"))
    stored = spark.read.parquet(f"{folder}/metadata")
    n = stored.count()
    assert n > 2 and (done.rows_before, done.rows_after, done.rebuild_basis) == (2, n, "metadata_snapshot") and 0.25 <= done.recommended_min_score <= 1
    manifest = spark.read.parquet(f"{folder}/manifest").first()
    assert manifest.dimensions == 3 and manifest.score_calibration.rows == n and manifest.score_calibration.samplePairs == 500 and manifest.score_calibration.method == "random_pair_p99_plus_margin" and manifest.chunking.rebuiltFromRows == 2
    assert sorted(r.pos for r in indexes.read_vectors(spark, str(tmp_path / "ec")).collect()) == list(range(n))
    assert [(r.id, r.rows) for r in indexes.manifests(spark, str(tmp_path)).collect()] == [("ec", n)]

    def broken(chunks):
        return chunks.withColumn("embedding", F.when(F.raise_error(F.lit("provider is down")).isNull(), F.array(F.lit(1.0))))

    with pytest.raises(Exception, match="provider is down"):
        indexes.rebuild(rows, "ec", "EC", broken, str(tmp_path / "ec"), "m", basis, warning)
    pinned = indexes.read_vectors(spark, str(tmp_path / "ec"))
    assert versions.current(spark, str(tmp_path / "ec")) == folder and pinned.count() == n
    indexes.rebuild(rows.limit(1), "ec", "EC", embed, str(tmp_path / "ec"), "m", basis, warning)
    assert indexes.read_vectors(spark, str(tmp_path / "ec")).count() == 1 and pinned.count() == n
    assert [(r.id, r.rows) for r in indexes.manifests(spark, str(tmp_path)).collect()] == [("ec", 1)]
    one = semantic.calibration_payload(semantic.calibration(semantic.sampled_pairs(spark.createDataFrame([("x", 0, [1.0])], "index_id string, pos int, embedding array<double>"))), spark.createDataFrame([("x", 1)], "index_id string, rows long"), F.current_timestamp()).first()
    assert one.score_calibration.samplePairs == 0 and one.score_calibration.maxSimilarity == 0.0


def test_sampled_pairs(spark):
    from palimpsest.operators import semantic

    v = spark.createDataFrame([("a", i, [float(i == j) for j in range(6)]) for i in range(6)], "index_id string, pos int, embedding array<double>")
    pairs = semantic.sampled_pairs(v).collect()
    assert len(pairs) == 500 and {r.similarity for r in pairs} == {0.0}  # no vector meets itself
    near = semantic.nearest(v.select(F.col("pos").cast("long").alias("id"), "embedding"), v.where("pos < 2").select(F.col("pos").cast("long").alias("query_id"), "embedding"), 2, block=2).collect()
    assert sorted((r.query_id, r.id, r.place) for r in near) == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1)]


def test_places_need_no_task_of_all_rows(spark):
    import random

    from palimpsest.operators.places import placed

    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.random()) for _ in range(2000)]
    got = placed(spark.createDataFrame(rows, "a int, b double").repartition(7), ["a", F.desc("b")], "pos", 5)
    assert [(r.a, r.b) for r in got.orderBy("pos").collect()] == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(r.pos for r in got.collect()) == list(range(5, 2005)) and "SinglePartition" not in got._jdf.queryExecution().toString()
    assert placed(spark.createDataFrame([], "a int"), ["a"], "pos").columns == ["a", "pos"]


def test_versions(spark, tmp_path):
    """A table is replaced while it is read, a dead writer leaves nothing, writers at once take different numbers."""
    from concurrent.futures import ThreadPoolExecutor

    from palimpsest.sources import versions

    path = str(tmp_path / "t")
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.replace(spark.range(3), path)
    old = versions.read(spark, path)
    versions.replace(old.selectExpr("id + 10 as id"), path)
    assert sorted(r.id for r in versions.read(spark, path).collect()) == [10, 11, 12] and old.count() == 3
    with pytest.raises(RuntimeError), versions.writing(spark, path) as folder:
        spark.range(99).write.parquet(f"{folder}/part")
        raise RuntimeError("killed")
    assert versions.read(spark, path).count() == 3
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: versions.commit(spark, path, f"version-{i:032x}"), range(6)))
    assert sorted(numbers) == list(range(3, 9))
    versions.replace(spark.range(7), path)
    assert versions.vacuum(spark, path, 1) == 8 and versions.read(spark, path).count() == 7 and versions.vacuum(spark, path, 1) == 0
