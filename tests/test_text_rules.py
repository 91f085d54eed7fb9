"""Small cases of the text rules that the given tables don't have."""

from pyspark.sql import functions as F

from tideline.operators import corpus


def test_paragraphs_blocks_and_structures(spark):
    text = "intro line\nsame  paragraph\n\n# One\n\n| a |\n|  b  |\n\n1) x\n2.  y\n\n\n## Two\r\n\r\n- a\nnot a list\n\n   \nlast"
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "\n \n"), (4, None)], "doc_id long, text string")
    got = [tuple(r) for r in corpus.paragraphs(rows).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 0, 0, "intro line same paragraph"), (1, 1, 1, "One"), (1, 2, 1, "| a |\n| b |"), (1, 3, 1, "1) x\n2. y"), (1, 4, 2, "Two"), (1, 5, 2, "- a not a list"), (1, 6, 2, "last")]


def test_quotes_and_signatures(spark):
    texts = ["Hi\r\n  > old", "Hi\nLe lundi Ann a écrit:\nold", "Hi\n-- \nme\n> old", "Thanks,\nme", "Thanks for it\n\n\n\nmore", "a\nKalle kirjoitti klo 9:\nb", "a\n_____\nb", "x\nSent from my iPhone", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus.strip_quotes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == ["Hi", "Hi", "Hi", "", "Thanks for it\n\nmore", "a", "a", "x", None, ""]


def test_sessions_and_threads(spark):
    # id, minutes, root, replies
    rows = [(1, 0, None, None), (2, 10, None, None), (3, 20, None, 2), (4, 25, None, None), (5, 26, 3, None), (6, 27, None, None), (7, 58, None, None), (8, 60, 99, None), (9, 61, None, None), (10, 62, 99, None), (11, 63, None, 0)]
    frame = spark.createDataFrame([(0, i, m * 60, r, n) for i, m, r, n in rows], "channel int, id long, s long, root long, replies int").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(tuple(r)[1:] for r in corpus.sessions(frame, "channel", 1800).collect())
    assert got == [(1, 2, 1, 2), (3, 2, 3, 5), (4, 2, 4, 6), (7, 1, 7, 7), (9, 2, 9, 11), (99, 2, 8, 10)]


def test_turns_end_at_a_gap(spark):
    rows = [(1, 0, "a", 0.0, 1.0, "x"), (1, 1, "a", 3.0, 4.0, "y"), (1, 2, "a", 6.5, 7.0, "z"), (1, 3, "b", 7.0, 8.0, "w"), (1, 4, None, 8.0, 9.0, "v")]
    got = corpus.turns(spark.createDataFrame(rows, "source_id long, seq long, speaker string, start double, stop double, text string"), 2.0).orderBy("turn").collect()
    assert [(r.from_seq, r.to_seq, r.start, r.stop, r.text) for r in got] == [(0, 1, 0.0, 4.0, "x y"), (2, 2, 6.5, 7.0, "z"), (3, 3, 7.0, 8.0, "w"), (4, 4, 8.0, 9.0, "v")]


def test_sheets_of_words_and_of_numbers(spark):
    words = spark.createDataFrame([(1, "a", "1"), (2, " ", "x"), (3, None, None)], "k long, p string, q string")
    assert [(r.row, r.text) for r in corpus.tabular_to_text(words, "s", "k", {"p": "P", "q": "Q"}).orderBy("row").collect()] == [(1, "P: a; Q: 1"), (2, "Q: x")]
    numbers = spark.createDataFrame([(1, "1,5", "-2e3"), (2, ".5", "x")], "k long, p string, q string")
    assert [tuple(r) for r in corpus.tabular_to_text(numbers, "s", "k", {"p": "P", "q": "Q"}).collect()] == [("s", 0, "Sensor data file with 2 columns: P, Q")]
    assert corpus.tabular_to_text(numbers.limit(0), "s", "k", {"p": "P"}).count() == 0
