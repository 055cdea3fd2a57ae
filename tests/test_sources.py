from pyspark.sql import functions as F

from cloneloom.sources import readers
from cloneloom.streaming.sessions import sessions


def test_repertoires(spark, tmp_path):
    head = "nucleotide\taminoAcid\tcount (templates/reads)\tfrequencyCount (%)\tsequenceStatus\tvGeneName\tvIndex"
    (tmp_path / "S1.tsv").write_text(head + "\nACG\tCAS\t3\t0.5\tIn\tTCRBV01\t-1\nACT\t\t1\t0.1\tOut\tunresolved\t4\n")
    (tmp_path / "S2.tsv").write_text(head + "\nACG\tCAS\tx\t0.5\tIn\t\t7\n")
    got = {(r["sample"], r.nucleotide): r for r in readers.read_repertoires(spark, str(tmp_path)).collect()}
    a, b, c = got["S1", "ACG"], got["S1", "ACT"], got["S2", "ACG"]
    assert (a.templates, a.productive, a.vGeneName, a.vIndex) == (3, True, "V01", None)
    assert (b.aminoAcid, b.productive, b.vGeneName, b.vIndex) == (None, False, None, 4)
    assert (c.templates, c.vGeneName) == (None, None)
    assert sorted(r["sample"] for r in readers.sample_list(spark, str(tmp_path), "*.tsv").collect()) == ["S1", "S2"]
    assert readers.read_columns(spark, str(tmp_path / "S1.tsv"), [0, 1], ["nt", "aa"]).count() == 1


def test_repertoires_of_three_headers(spark, tmp_path):
    (tmp_path / "S1.tsv").write_text("count (templates)\tnucleotide\tsequenceStatus\n3\tACG\tIn\n")
    (tmp_path / "S2.tsv").write_text("vGeneName\tcount (reads)\tnucleotide\nTCRBV02\t5\tACT\nTCRBV03\t6\tAAA\n")
    (tmp_path / "S 3.tsv").write_text("nucleotide\taminoAcid\tcount (templates/reads)\r\nGGG\tCAS\t7\r\n")
    (tmp_path / "S4.tsv").write_text("vGeneName\tcount (reads)\tnucleotide\nTCRBV09\t1\tCCC\n")
    got = {(r["sample"], r.nucleotide): (r.templates, r.vGeneName, r.productive, r.aminoAcid) for r in readers.read_repertoires(spark, str(tmp_path)).collect()}
    assert got == {
        ("S1", "ACG"): (3, None, True, None), ("S2", "ACT"): (5, "V02", None, None), ("S2", "AAA"): (6, "V03", None, None),
        ("S 3", "GGG"): (7, None, None, "CAS"), ("S4", "CCC"): (1, "V09", None, None),
    }


def test_fastq_of_many_files_and_qualities_with_at(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r1\nACG\n+r1\n@@I\n@r2\nT\n+\n@\n@r3\nGG\n+\nII")
    (tmp_path / "b.fq").write_text("@x\r\nAC\r\n+\r\n@I\r\n@y\r\nC\r\n+\r\nJ\r\n")
    got = list(map(tuple, readers.read_fastq(spark, str(tmp_path)).collect()))
    assert got == [("r1", "ACG", "@@I"), ("r2", "T", "@"), ("r3", "GG", "II"), ("x", "AC", "@I"), ("y", "C", "J")]


def test_any_file_by_what_it_holds(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    for kind in ("parquet", "orc", "json"):
        df.coalesce(1).write.format(kind).save(str(tmp_path / f"{kind}.d"))
        assert list(map(tuple, readers.read_any(spark, str(tmp_path / f"{kind}.d")).collect())) == [(1, "a")]
    (tmp_path / "plain").write_text("id\tx\n1\ta\n")
    assert list(map(tuple, readers.read_any(spark, str(tmp_path / "plain")).collect())) == [("1", "a")]


def test_settings(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("# run\ninputs: a.tsv, b.tsv\noutput: out\nseed: 3\n")
    (tmp_path / "s.json").write_text('{"inputs": ["a.tsv"], "seed": 3}')
    assert readers.Settings.load(spark, str(tmp_path / "s.yaml")) == readers.Settings(["a.tsv", "b.tsv"], "out", {"seed": "3"})
    assert readers.Settings.load(spark, str(tmp_path / "s.json")) == readers.Settings(["a.tsv"], "", {"seed": 3})


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nACG\nTT\n>y\nGG\n")
    assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / "a.fa")).collect())) == [("x one", "ACGTT"), ("y", "GG")]
    (tmp_path / "a.fq").write_text("@r1\nACG\n+\nIII\n@r2\nTT\n+\n@#\n")
    assert list(map(tuple, readers.read_fastq(spark, str(tmp_path / "a.fq")).collect())) == [("r1", "ACG", "III"), ("r2", "TT", "@#")]


def test_materialized_builds_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    path = str(tmp_path / "t.parquet")
    assert [readers.materialized(spark, path, build).count() for _ in range(2)] == [3, 3]
    assert len(made) == 1


def test_round_trip_and_union(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    readers.write(df, str(tmp_path / "a.csv"))
    readers.write(df.withColumn("y", F.lit("z")), str(tmp_path / "b.tsv"))
    got = readers.read_folder(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.tsv")])
    assert got.columns == ["id", "x", "y"] and got.count() == 4


def test_sessions_of_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    final = spark.table("sessions_out").count()
    whole = sessions(events).count()
    assert whole * 0.9 < final <= whole
