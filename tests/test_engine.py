import json

from pyspark.sql import functions as F

from sparkseek.engine import Engine, Jobs, main
from sparkseek.functions.filters import Condition
from sparkseek.operators import documents as D
from sparkseek.operators import fulltext
from sparkseek.operators.semantic import Levels
from sparkseek.streaming.ingest import HashEncoder

FACTS = ["Flamingos stand on one leg", "A group of flamingos is a flamboyance", "Lake Hillier is pink", "Bananas are berries", "Strawberries are not berries", "Honey never spoils"]


def rows(spark, items, start=0):
    return spark.createDataFrame([(f"u{start + i}", "2024-01-01", json.dumps({"n": start + i, "key": f"k{i}"}), t) for i, t in enumerate(items)], "uuid string, date string, metadata string, body string")


def test_life_of_an_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), HashEncoder(16), Levels(8, 4))
    assert e.add(rows(spark, FACTS)) == 6 and e.embed() == 6 and e.embed() == 0
    assert e.search("flamingos", 0.2, 5)[0]["bodies"] in ([FACTS[0]], [FACTS[1]])
    before = [h["bodies"] for h in e.search("pink lake", 0.2, 3)]
    assert e.count_unindexed() > 0 and e.index() == 0 and e.count_unindexed() == 0
    assert before[0] == [FACTS[2]] and e.search("pink lake", 0.2, 3)[0]["bodies"] == [FACTS[2]]
    e.add(rows(spark, ["Penguins walk in pink snow"], 10))
    assert e.embed() == 1 and e.search("pink snow", 0.2, 3, use_fulltext=False)[0]["bodies"] == ["Penguins walk in pink snow"]
    assert e.index() is None  # too few wait
    e.remove("u2")
    assert all(h["bodies"] != [FACTS[2]] for h in e.search("pink lake", 0.0, 10))
    assert {h["bodies"][0] for h in e.search("berries", 0.0, 10, f=Condition("$.n", "Equals", 3))} == {FACTS[3]}
    e.delete(Condition("$.n", "LessThan", 4))
    assert e.documents.read().count() == 3 and e.chunks.read().select("hash").distinct().count() == 3
    scores = e.score("honey spoils", ["nothing", "Honey never spoils", ""])
    assert scores.index(max(scores)) == 1
    assert e.index(rebuild=True) == 0
    e.clear()
    assert e.documents.read().count() == 0 and e.search("honey", 0.0, 5) == []


def test_cascade(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "c"), HashEncoder(8), Levels(4, 2))
    levels = []
    for i in range(4):
        e.add(rows(spark, [f"one two three four five six {i}"], i))
        e.embed()
        levels.append(e.index())
    assert levels == [0, 1, 2, 0] or max(x for x in levels if x is not None) >= 1
    assert e.count_unindexed() == 0 and len({g.number for g in e._generations()}) == len(e._generations())


def test_jobs(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "j"), HashEncoder(8), Levels(4, 2))
    jobs = Jobs(e)
    first = jobs.add(rows(spark, FACTS[:2]))
    first.done.wait(120)
    assert first.result == 2
    jobs.index().done.wait(120)
    assert e.chunks.read().count() > 0
    jobs.clear().done.wait(120)
    jobs.shutdown()
    assert e.documents.read().count() == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.tsv").write_text("".join(f"k{i}\t{t}\n" for i, t in enumerate(FACTS)))
    (tmp_path / "q.tsv").write_text("q1\tpink lake\nq2\tberries\n")
    folder = str(tmp_path / "cli")
    assert main([folder, "readcsv", str(tmp_path / "d.tsv")]) == 0 and main([folder, "embed"]) == 0 and main([folder, "hybrid", "pink", "lake"]) == 0
    assert main([folder, "hybridcsv", str(tmp_path / "q.tsv"), str(tmp_path / "out")]) == 0
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert [x.split("\t")[0] for x in lines] == ["q1", "q2"] and lines[0].split("\t")[1].startswith("k2,")
    assert main([folder]) == 2 and "Lake Hillier" in capsys.readouterr().out


def test_stored_terms_follow_the_documents(spark, tmp_path):
    """The stored full-text index equals one built anew, after additions, changes and deletions."""
    e = Engine(spark, str(tmp_path / "t"), HashEncoder(8), Levels(4, 2))

    def same():
        kept, anew = e.fulltext_index(), fulltext.build(e.documents.read())
        assert sorted(map(tuple, kept.postings.collect())) == sorted(map(tuple, anew.postings.collect()))
        assert sorted(map(tuple, kept.lengths.collect())) == sorted(map(tuple, anew.lengths.collect())) and kept.mean == anew.mean

    e.add(rows(spark, FACTS[:3]))
    same()
    first = e.terms.versions()
    e.add(rows(spark, [*FACTS[3:5], ""], 3))
    same()
    assert e.terms.versions() == first  # new documents are appended
    e.add(rows(spark, ["Changed text of one document"], 1))
    same()
    e.remove("u0")
    same()
    assert e.fulltext_index() is e.fulltext_index()


def test_numbers_are_distinct_and_gapless(spark):
    for _ in range(2):
        ids = spark.range(400_000, numPartitions=8).select(F.sha1(F.col("id").cast("string")).alias("uuid"))
        row = D.numbered(ids, "uuid", "rowid", 1).agg(F.count("*").alias("n"), F.count_distinct("rowid").alias("d"), F.min("rowid").alias("a"), F.max("rowid").alias("b")).first()
        assert (row["n"], row["d"], row["a"], row["b"]) == (400_000, 400_000, 1, 400_000)
