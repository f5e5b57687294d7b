"""XML folders, dictionaries, tables and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from lexalia import schema
from lexalia.operators.people import apply_overrides
from lexalia.sources import dictionaries, tables, wordlists, xml_corpus
from lexalia.streaming import incremental

HEADER = ('<teiHeader xmlns="http://www.tei-c.org/ns/1.0"><fileDesc><sourceDesc><bibl>'
          "<title>T {n}</title>{author}<date>1999-03-0{n}</date></bibl></sourceDesc></fileDesc>"
          "</teiHeader>")
BODY = ('<teiCorpus xmlns="http://www.tei-c.org/ns/1.0"><TEI><text><body>{}</body></text></TEI>'
        "</teiCorpus>")


def write(root, period, kind, doc, header, body):
    folder = root / period / "sejm" / kind / doc
    folder.mkdir(parents=True)
    (folder / "header.xml").write_text(header, encoding="utf-8")
    (folder / "text_structure.xml").write_text(body, encoding="utf-8")


def test_questions(spark, tmp_path):
    kind = "interpelacje/ip"
    write(tmp_path, "1997-2001", kind, "d1",
          HEADER.format(n=1, author="<author>Ewa Lis</author><author>Jan Żak</author>"),
          BODY.format("<p>Ala &amp; kot</p>\n <div>x</div><p/><p><hi>em</hi> tail</p><p>ś</p>"))
    write(tmp_path, "2001-2005", kind, "d2", HEADER.format(n=2, author=""), BODY.format("<p>b</p>"))
    rows = {r.DOC: r for r in xml_corpus.read_questions(spark, str(tmp_path)).collect()}
    assert rows["d1"].AUTHOR == "Ewa Lis" and rows["d1"].TITLE == "T 1"
    assert rows["d1"].CONTENT == "Ala & kot   em ś"
    assert (rows["d2"].period, rows["d2"].AUTHOR) == ("2001-2005", "na")
    found = xml_corpus.periods_with_documents(spark, str(tmp_path))
    assert sorted(r.period for r in found.collect()) == ["1997-2001", "2001-2005"]


def test_sessions(spark, tmp_path):
    write(tmp_path, "1997-2001", "posiedzenia/pp", "s1", HEADER.format(n=3, author=""),
          BODY.format('<div><u xml:id="u1" who="#A">one</u><u xml:id="u2" who="#B">two</u></div>'
                      '<div><u xml:id="u3" who="#A">three</u></div>'))
    rows = xml_corpus.read_sessions(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.ID_INT, r.AUTHOR, r.CONTENT) for r in rows] == [
        ("u1", "#A", "one"), ("u2", "#B", "two"), ("u3", "#A", "three")]
    assert rows[0].DATE == dt.date(1999, 3, 3)


def test_dictionaries(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"p": {"X": ["Ewa Lis", "Jan Żak"]}, "q": {"Y": ["A"]}},
                                                indent=1), encoding="utf-8")
    roster = dictionaries.read_roster(spark, str(tmp_path / "r.json"))
    assert {tuple(r) for r in roster.collect()} == {
        ("Ewa Lis", "X", "p"), ("Jan Żak", "X", "p"), ("A", "Y", "q")}
    (tmp_path / "d.json").write_text(json.dumps({"d1": ["1 maja 2000 r."]}), encoding="utf-8")
    docs = spark.createDataFrame([("d1", "a"), ("d2", "b")], "DOC string, tail string")
    overrides = dictionaries.read_overrides(spark, str(tmp_path / "d.json"))
    rows = {r.DOC: r.tail for r in apply_overrides(docs, overrides, "DOC", "tail").collect()}
    assert rows == {"d1": "1 maja 2000 r.", "d2": "b"}


def test_word_list_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("ale\n aby \n\nale\n", encoding="utf-8")
    rows = wordlists.read_word_list(spark, str(tmp_path / "w.txt")).collect()
    assert sorted(r.lemma for r in rows) == ["aby", "ale"]


def test_tables_are_created_once_and_reset(spark, tmp_path):
    made = tables.create_tables(spark, schema.SESSION_TABLES, str(tmp_path), "tt_")
    assert sorted(made) == ["tt_metadata", "tt_pscontent"]
    assert tables.create_tables(spark, schema.SESSION_TABLES, str(tmp_path), "tt_") == []
    rows = spark.createDataFrame([("p", 1, dt.date(2000, 1, 1), "d")],
                                 schema.SESSION_METADATA)
    tables.append_rows(rows, "tt_metadata", schema.SESSION_METADATA)
    tables.append_rows(rows, "tt_metadata", schema.SESSION_METADATA)
    assert spark.table("tt_metadata").filter("period = 'p'").count() == 2
    tables.reset_tables(spark, made)
    assert not spark.catalog.tableExists("tt_metadata")


def test_stream_takes_each_file_once(spark, tmp_path):
    docs = spark.createDataFrame([("p", 1, "Ala ma kota"), ("p", 2, "Pies.")], schema.QUESTION_CONTENT)
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))

    def run():
        stream = incremental.stream_files(spark, source, schema.QUESTION_CONTENT)
        incremental.run_to_table(incremental.tagging_stream(stream), out, progress,
                                 partition_by=["period"])
        return spark.read.parquet(out).count()

    docs.coalesce(1).write.parquet(source)
    assert run() == 4
    assert run() == 4
    docs.withColumn("ID", F.col("ID") + 10).coalesce(1).write.mode("append").parquet(source)
    assert run() == 8


def test_batch_tagging_resumes(spark):
    docs = spark.createDataFrame([("p", i, "Ala ma kota") for i in range(4)], schema.QUESTION_CONTENT)
    done = docs.filter("ID < 2").select("period", "ID")
    first = incremental.tag_pending(docs, done, max_docs=1)
    assert {r.ID for r in first.collect()} == {2}
    assert incremental.tag_pending(docs, docs, max_docs=1).count() == 0


def test_batch_cap_holds_for_every_period(spark):
    docs = spark.createDataFrame([(p, i, "Ala") for p in "pq" for i in range(5)] + [("r", 9, "Ala")], schema.QUESTION_CONTENT)
    done = docs.where("period = 'p' and ID < 2").select("period", "ID")
    got = incremental.tag_pending(docs, done, max_docs=2).select("period", "ID").collect()
    assert sorted(map(tuple, got)) == [("p", 2), ("p", 3), ("q", 0), ("q", 1), ("r", 9)]


def _event(spark, folder, *days):
    rows = [(dt.datetime(2024, 1, d, 12),) for d in days]
    spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_closed_windows_come_once_and_late_rows_are_dropped(spark, tmp_path):
    source, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))

    def run():
        stream = incremental.stream_files(spark, source, "ts timestamp")
        return incremental.run_closed(incremental.windowed_counts(stream, "ts", "1 day", "1 day"), out, progress)

    def written():
        rows = spark.read.schema("st timestamp, et timestamp, count long").parquet(out).collect()
        return sorted((r.st.day, r["count"]) for r in rows)

    _event(spark, source, 1, 1, 2, 5)
    run()
    assert written() == [(1, 2), (2, 1)]  # the watermark stands at noon of the fourth
    _event(spark, source, 1, 5, 9)  # the first is too late
    seen = run()
    assert written() == [(1, 2), (2, 1), (5, 2)] and sum(s["late"] for s in seen) == 1
    assert seen[-1]["open"] == 1  # only the ninth is still open
    # A restart with nothing new adds nothing; a batch that has to run again is written over.
    run()
    assert written() == [(1, 2), (2, 1), (5, 2)]
    last = sorted((tmp_path / "progress" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))[-1]
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert written() == [(1, 2), (2, 1), (5, 2)]
