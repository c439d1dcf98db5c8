"""Readers and writers on small files of the shapes they are for."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from quarrystone.operators import retrieval
from quarrystone.sources import files, sinks, vectors


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False))
    return str(path)


def test_kb_records(spark, tmp_path):
    good = {"question_id": "a-1", "question": "q?", "answer": ["x"], "source": {"year": 2020}, "search_text": "q", "synonyms": {"a": ["b"]}}
    ok, bad = files.kb_records(spark, dump(tmp_path / "kb.json", [good, good | {"search_text": " ", "answer": []}]))
    assert [(r.question_id, r.source.year, r.synonyms) for r in ok.collect()] == [("a-1", 2020, {"a": ["b"]})]
    assert bad.first().violations == ["search_text", "answer"]


def test_questions(spark, tmp_path):
    good, bad = files.questions(spark, dump(tmp_path / "q.json", [{"question_id": "1", "question": "Is it?", "pico": {"P": "all", "C": "none"}}, {"question": " "}]))
    assert [(r.question, r.pico.P, r.pico.C) for r in good.collect()] == [("Is it?", "all", ["none"])] and bad.count() == 1


def test_pico_outcomes_as_lists_or_text(spark, tmp_path):
    p = dump(tmp_path / "p.json", [{"Index": "1", "C": ["a"], "O": {"a": ["x", "y"]}}, {"Index": "2", "C": ["a"], "O": {"a": "1. pain\n2. death"}}])
    assert files.pico(spark, p, "1").first().O == {"a": ["x", "y"]}
    assert files.pico(spark, p, "2").first().O == {"a": ["pain", "death"]}


def test_guideline_blocks(spark, tmp_path):
    block = {"index": 3, "type": "text", "lines": [{"spans": [{"content": "A &amp;"}]}], "blocks": [{"sub_blocks": [{"lines": [{"spans": [{"html": "B"}]}]}]}]}
    p = dump(tmp_path / "g.json", {"pdf_info": [{"page_idx": 1, "para_blocks": [block, {"index": 4, "lines": []}]}]})
    assert [(r.page_idx, r["index"], r.block_type, r.text) for r in files.guideline_blocks(spark, p).collect()] == [(1, 3, "text", "A & B")]


def test_newest_complete_screening_batch(spark, tmp_path):
    head = "Paper_Index,Title,Published,Abstract,Digital Object Identifier,Publication Types,paper,clinical_question,llm_record_screening_reason,llm_record_screening_verdict\n"
    for run, stamp in ((0, "2024"), (1, "2024"), (0, "2025")):
        dump(tmp_path / f"P1_exp_{run}-{stamp}.csv", head + f'{run},"a ""t""\nx",,,,,,,,Included\n')
    got = files.screening_runs(spark, str(tmp_path), "P1", 2).orderBy("run").collect()
    assert [(r.run, r.stamp, r.Title) for r in got] == [(0, "2024", 'a "t"\nx'), (1, "2024", 'a "t"\nx')]


MEDLINE = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article>
<ArticleTitle>[Not Available].</ArticleTitle><Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText Label="END">two</AbstractText></Abstract>
<ArticleDate><Year>2020</Year><Month>05</Month><Day>01</Day></ArticleDate><ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi">10.1/a</ELocationID><ELocationID EIdType="doi">10.1/b</ELocationID>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">8</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedBookArticle><BookDocument/></PubmedBookArticle></PubmedArticleSet>"""


def test_medline(spark, tmp_path):
    got = [list(r) for r in files.literature(spark, dump(tmp_path / "m.xml", MEDLINE)).orderBy("Paper_Index").collect()]
    assert got == [["7", None, "2020-05-01", "AIM: one\nEND: two", "10.1/b", ["Review"]], ["8", "T", None, None, None, []]]


def test_tei(spark, tmp_path):
    p = dump(tmp_path / "t.xml", '<TEI><div><head>Methods</head><p><s coords="1">A b.</s><s coords="2">C.</s></p><p><s coords="3">D.</s></p></div></TEI>')
    assert [(r.section_title, r.para, r.text) for r in files.tei_sections(spark, p).collect()] == [("Methods", 0, "A b."), ("Methods", 0, "C."), ("Methods", 1, "D.")]


def test_pairs_and_listing(spark, tmp_path):
    for n in ("paperinfo_a.json", "outcomeinfo_a.json", "paperinfo_b.json", "paperinfo_a_full_text_assessed_but_not_included.json"):
        dump(tmp_path / n, "[]")
    assert [r.postfix for r in files.paired_outputs(files.listing(spark, str(tmp_path), "*.json")).collect()] == ["a"]


def test_corrupt_json_is_null(spark):
    df = spark.createDataFrame([(1, "[1]"), (2, "{"), (3, "{}")], "i int, value string")
    got = files.valid_json(df).select("i", F.col("json").isNotNull().alias("ok")).collect()
    assert [r.ok for r in sorted(got)] == [True, False, False]


def test_designs(spark):
    df = spark.createDataFrame([("SYSTEMATIC_REVIEW",), ("randomized controlled trial",), ("Observational Study",)], "d string")
    assert [r[0] for r in df.select(files.study_design(F.col("d"))).collect()] == ["Systematic Review", "Randomized Controlled Trial", None]


def test_pages_cover_everything_once(spark):
    got = files.page_plan(spark, 20_000).collect()
    assert sorted(x for r in got for x in range(r.start, r.start + r.size)) == list(range(20_000))


def test_strategies(spark, tmp_path):
    lines = files.strategy_lines(spark, dump(tmp_path / "s.txt", "Search\n1 asthma\n2 exp lung/\n3 1 or 2\n4 or/1-3\n"))
    got = files.renumbered(lines, 10, "rct").orderBy("number").collect()
    assert [(r.number, r.line) for r in got] == [(11, "asthma"), (12, "exp lung/"), (13, "11 or 12"), (14, "or/11-13"), (15, "rct"), (16, "14 and 15")]


def test_feedback(spark):
    df = spark.createDataFrame([('{"esearchresult": {"count": "12", "querytranslation": "q", "warninglist": {"outputmessages": ["w"]}}}',), ("x",)], "t string")
    assert [tuple(r[0]) for r in df.select(files.search_feedback(F.col("t"))).collect()] == [(12, "q", ["w"]), (None, None, [])]


def test_documents_of_several_kinds(spark, tmp_path):
    dump(tmp_path / "a.txt", "x \n\n y")
    dump(tmp_path / "b.html", "<p>one</p><script>no</script><p>two</p>")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>hi</w:t></w:r></w:p><w:p/></w:document>')
    got = {r.file[-6:]: r.text for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {"/a.txt": "x\ny", "b.html": "one\ntwo", "c.docx": "hi"}


def test_databases(spark):
    assert {r.database for r in files.union_databases({"a": spark.range(1), "b": spark.range(2)}).collect()} == {"a", "b"}


def test_partition_overwrite_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("p", "a", 1), ("p", "b", 2)], "pico_idx string, comparator_postfix string, v int")
    sinks.write_partitioned(df, str(tmp_path / "t"))
    sinks.write_partitioned(df.where("v = 1").withColumn("v", F.lit(9)), str(tmp_path / "t"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 9]
    for stamp, v in (("1", 1), ("2", 2), ("3", 3)):
        sinks.snapshot(spark.createDataFrame([("k", v)], "k string, v int"), str(tmp_path / "s"), stamp)
    assert sinks.newest_snapshot(spark, str(tmp_path / "s"), ["k"], F.col("v") < 3).first().v == 2


def test_log_collection_and_exports(spark, tmp_path):
    log = sinks.KeyValueLog(spark, str(tmp_path / "log"), "a int")
    for _ in range(2):
        log.save(spark.createDataFrame([(1,)], "a int"))
    assert log.load().count() == 2
    log.clear()
    assert log.load().count() == 0
    sinks.create_collection(spark.range(3), str(tmp_path / "c"))
    sinks.create_collection(spark.range(5), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3
    sinks.array_export(spark.range(2), str(tmp_path / "x"))
    assert json.loads(next((tmp_path / "x").glob("part-*")).read_text()) == [{"id": 0}, {"id": 1}]
    sinks.write_csv(spark.createDataFrame([([1, 2],)], "l array<int>"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().l == "[1,2]"


def test_saved_bm25(spark, sf, tmp_path):
    sinks.save_bm25(spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "i"), "doc_id", "text")
    got = sinks.bm25_terms(spark, str(tmp_path / "i"), ["the"])
    assert got.count() > 10 and got.select("idf").distinct().count() == 1


def test_a_saved_index_answers_as_the_texts_do(spark, tmp_path):
    docs = spark.createDataFrame([(1, "heart attack"), (2, None), (3, ""), (4, "attack of the heart heart"), (5, "other")], "idx int, text string")
    asked = spark.createDataFrame([(1, "heart"), (2, "nothing"), (3, None), (4, "other attack attack")], "q int, question string")
    path = str(tmp_path / "i")
    sinks.save_bm25(docs, path, "idx", "text")
    want = sorted(map(tuple, retrieval.bm25_search(docs.fillna(""), asked, 3).select("q", "idx", "score", "rank").collect()))
    for pushed in (0, 100):
        got = sinks.search_bm25(spark, path, asked, 3, pushed=pushed).select("q", "idx", "score", "rank")
        assert sorted(map(tuple, got.collect())) == want and len(want) == 12
    plan = sinks.search_bm25(spark, path, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan.replace(" ", "") or "term IN" in plan


def test_vectors_are_made_unit_length(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "i int, v array<double>")
    got = {r.i: r.v for r in vectors.prepared(df, "v", 2).collect()}
    assert [round(x, 5) for x in got[1]] == [0.6, 0.8] and got[2] == [0.0, 0.0]
    assert vectors.add(df, df.where("i = 1"), "i").count() == 2 and vectors.clear(df).count() == 0
