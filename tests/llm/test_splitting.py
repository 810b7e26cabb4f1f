import pytest
from pyspark.sql import functions as F

from frameloom.llm import queries, splitting, tokens
from tests.conftest import SMALL


def split(spark, texts, most=40, overlap=6):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    out = {}
    for r in splitting.split_texts(df, "k", "t", most, overlap).collect():
        out.setdefault(r.k, []).append(r)
    return {k: sorted(v, key=lambda r: r.piece_no) for k, v in out.items()}


def check(pieces, text, most, overlap):
    enc = tokens.encoder()
    end = 0
    for n, r in enumerate(pieces, 1):
        assert r.piece_no == n and text[r.start_char : r.start_char + len(r.piece)] == r.piece
        assert r.n_tokens <= most and enc.count([r.piece])[0] <= r.n_tokens
        if n == 1:
            assert r.start_char == 0 and r.overlap_tokens == 0
        else:
            assert r.start_char <= end and overlap <= r.overlap_tokens <= overlap + splitting.SLACK
        assert r.start_char + len(r.piece) > end
        end = r.start_char + len(r.piece)
    assert end == len(text)
    # Without their overlaps the pieces are the text.
    at, joined = 0, ""
    for r in pieces:
        joined += r.piece[at - r.start_char :]
        at = r.start_char + len(r.piece)
    assert joined == text


TEXTS = [
    "# Title\n\n" + "One sentence here. Another one follows! " * 20 + "\n\n## Next\n\n" + "word " * 90,
    "line of a log\n" * 60, "a" * 900, "日本語の文章です。とても長い文。" * 20, "👍🏽" * 90, " " * 700, "'" * 400, "x'y'" * 120, "\r\n\r\n".join("p%d q r s" % i for i in range(60)),
    "no limits " * 3, "é" * 300, "0123456789" * 60,
]


def test_pieces_cover_the_text_within_the_limit(spark):
    got = split(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        check(got[i], t, 40, 6)


def test_cuts_prefer_strong_boundaries(spark):
    got = split(spark, ["alpha beta gamma delta.\n\n" * 30, "word " * 120, "One two three. " * 40, "# h\nsome text here\n" * 30])
    assert {r.boundary for r in got[0][:-1]} == {"P"} and {r.boundary for r in got[1][:-1]} == {"W"}
    assert {r.boundary for r in got[2][:-1]} == {"S"} and {r.boundary for r in got[3][:-1]} == {"H"}


def test_short_empty_and_null_texts_are_one_piece(spark):
    got = split(spark, [None, "", "short"])
    assert [(got[i][0].piece, got[i][0].n_tokens, got[i][0].boundary, len(got[i])) for i in range(3)] == [(None, 0, "E", 1), ("", 0, "E", 1), ("short", 1, "E", 1)]
    with pytest.raises(ValueError):
        split(spark, ["x"], 10, 9)


def test_empty_table_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, "word " * 50), (1, "word " * 50)], "k long, t string")
    for c in ("cls", "ends", "n", "no", "end", "begin", "cuts", "piece", "text", "key"):
        df = df.withColumn(c, F.lit("x"))
    out = splitting.split_texts(df, "k", "t", 40, 6)
    assert out.groupBy("piece_no").count().where("count != 2").count() == 0
    assert splitting.split_texts(df.limit(0), "k", "t", 40, 6).count() == 0


def test_documents(spark):
    most, overlap = queries.limits(spark, SMALL, "piece")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {}
    for r in queries.p9_pieces(spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == set(docs)
    for k, v in got.items():
        if docs[k]:
            check(sorted(v, key=lambda r: r.piece_no), docs[k], most, overlap)


def test_the_work_grows_with_the_length_of_a_text(spark):
    import time

    line = "Ein längerer Satz über Sterne und Nebel, der immer wieder kommt. "
    texts = [line * (n // len(line)) for n in (1_200_000, 2_400_000)]
    frames = [spark.createDataFrame([(1, t)], "k long, t string").cache() for t in texts]
    seconds = []
    for df in [frames[0], *frames]:
        df.count()
        t = time.perf_counter()
        splitting.split_texts(df, "k", "t", 512, 64).write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - t)
    assert seconds[2] <= 2.2 * seconds[1] + 1
