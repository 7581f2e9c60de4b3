"""The standoff data source against the column parser, and its stream against its batch."""

import os
import random

import pytest

from spanlab.sources import standoff, standoff_source as src

LINES = ["T1\tmorphologie 0 9\tPremière", "T1\ttopographie 3 4;6 9\tdouble\tblank", "T2\tx 4\tone", "T3\tx 9 3\tback",
         "T4\tx 1 99999999999\tfar", "T5\tx -1 4\tneg", "T6\tno_span", "T7\tx 0  5\ttwo", "T8\tx 5 5\t", "T", "T9 x 1 2",
         "T10\tx 1 2", "T11\t 1 2\tnolabel", "#1\tAnnotatorNotes T1\t8000/3", "#2\tAnnotatorNotes T1\t8000/6",
         "#3\tAnnotatorNotes T8\tC1\tC2", "#4\tAnnotatorNotes T77\tx", "#5\tAnnotatorNotes\tx", "# free comment", "#6\tN T1",
         "", "R1\trel Arg1:T1", "#7\tA T 8\tx", "#8\tA T8\t", "T8\tz 1 2;3 4;5 6\té"]


def write(folder, stem, text, ann):
    for kind, data in (("txt", text), ("ann", ann)):
        if data is not None:
            (folder / f"{stem}.{kind}").write_bytes(data if isinstance(data, bytes) else data.encode())


def load(spark, folder, **options):
    src.register(spark)
    return spark.read.format("standoff").options(**options).load(str(folder))


def plain(rows):
    return sorted(map(repr, (r.asDict(True) for r in rows)))


@pytest.fixture()
def corpus(tmp_path):
    rnd = random.Random(3)
    folder = tmp_path / "corpus"
    folder.mkdir()
    for d in range(40):
        lines = rnd.choices(LINES, k=rnd.randint(0, 25))
        write(folder, f"compte rendu {d} é+%20", f"Première ligne\r\n\nligne {d}\n", rnd.choice(["\n", "\r\n"]).join(lines))
    write(folder, "a.b", "deux points", "T1\tx 0 4\tdeux")
    write(folder, "empty", "", "")
    return folder


def test_equals_the_column_parser(spark, corpus):
    got = load(spark, corpus, partitionBytes=200)
    ents, bad = standoff.parse(standoff.read_lines(spark, str(corpus)))
    columns = ["doc_name", "id", "line_no", "label", "spans", "text", "icdo_code"]
    want = plain(ents.select(columns).collect())
    assert plain(src.entities(got).select(columns).collect()) == want and len(want) > 40
    assert plain(src.quarantine(got).collect()) == plain(bad.collect())
    texts = {r.doc_name: r.text for r in standoff.read_documents(spark, str(corpus)).collect()}
    # Spark's text reader leaves files of no bytes out
    assert {r.doc_name: r.text for r in got.collect()} == texts | {"empty": ""}
    assert all(os.path.exists(r.source_file) for r in got.collect())


def test_orphans_and_files_that_are_not_text(spark, corpus):
    write(corpus, "only text", "x", None)
    write(corpus, "only notes", None, "T1\tx 0 1\ta")
    write(corpus, "latin", "é".encode("latin-1"), "T1\tx 0 1\té")
    write(corpus, "latin too", "é", b"T1\tx 0 1\t\xe9")
    write(corpus, "_hidden", "x", "")
    got = load(spark, corpus)
    assert sorted(map(tuple, src.orphans(got).collect())) == [("only notes", "text"), ("only text", "annotation")]
    rows = {r.doc_name: r for r in got.collect()}
    assert "_hidden" not in rows and len(rows) == 46
    assert rows["latin"].text is None and rows["latin"].entities[0].text == "é"
    assert rows["latin too"].entities is None and rows["latin too"].text == "é"
    assert [r.reason for r in rows["latin"].rejected] == ["text file is not UTF-8 at byte 0"]
    assert rows["only notes"].source_file.endswith(".ann")


def test_partitions_by_bytes(spark, corpus):
    reader = src.StandoffReader({"path": str(corpus), "partitionbytes": "500"})
    pairs = reader.pairs()
    parts = reader.partitions()
    assert [p for part in parts for p in part.pairs] == pairs and len(pairs) == 42
    assert all(len(p.pairs) == 1 or sum(x[3] for x in p.pairs) <= 500 for p in parts)
    assert load(spark, corpus, partitionBytes=500).rdd.getNumPartitions() == len(parts)


def test_modes_folders_and_empty(spark, corpus, tmp_path):
    with pytest.raises(Exception, match="invalid annotation line"):
        load(spark, corpus, mode="FAILFAST").collect()
    with pytest.raises(Exception, match="mode must be"):
        load(spark, corpus, mode="DROP").collect()
    (corpus / "deep").mkdir()
    write(corpus / "deep", "empty", "same stem", None)
    assert load(spark, corpus).count() == 42
    assert load(spark, "file:" + str(corpus), recursive="true").where("doc_name = 'empty'").count() == 2
    (tmp_path / "none").mkdir()
    assert load(spark, tmp_path / "none").count() == 0


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, corpus, tmp_path):
    src.register(spark)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("standoff").option("settleSeconds", "0").load(str(corpus))
        q = stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.read.parquet(out)

    batch = plain(load(spark, corpus).collect())
    assert plain(run().collect()) == batch
    assert plain(run().collect()) == batch  # nothing new
    write(corpus, "late", "plus tard", None)
    assert run().where("doc_name = 'late'").select("entities").collect() == [(None,)]
    os.utime(corpus / "late.txt")
    write(corpus, "late", None, "T1\tx 0 4\tplus")
    late = run().where("doc_name = 'late'").collect()
    assert sorted(r.entities is None for r in late) == [False, True] and len(late) == 2
    assert plain(run().where("doc_name <> 'late'").collect()) == batch


def test_young_files_wait(corpus):
    reader = src.StandoffStreamReader({"path": str(corpus), "settleseconds": "3600"})
    assert reader.latestOffset() == reader.initialOffset()
    old = reader.pairs()[0]
    for path in old[1:3]:
        os.utime(path, (1_000_000, 1_000_000))
    assert reader.latestOffset() == {"ns": 1_000_000 * 10 ** 9}
    assert [p.pairs for p in reader.partitions({"ns": 0}, reader.latestOffset())] == [[(*old[:4], 1_000_000 * 10 ** 9)]]
    for path in old[1:3]:
        os.remove(path)
    assert reader.latestOffset() == {"ns": 1_000_000 * 10 ** 9}
