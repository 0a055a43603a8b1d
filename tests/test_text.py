import random
import re

from conftest import rows
from pyspark.sql import functions as F

from askloom import fixed
from askloom.functions import scalars, text
from askloom.sources.documents import chunk, literal_documents, read_documents


# text, delimiter, chunks
PIECES = [
    ("", "\n\n", []),
    ("# t\n\nx", "\n\n", ["x"]),
    ("a\n\n\n# b", "\n\n", ["a", "# b"]),
    (" # keep\n\nb", "\n\n", ["# keep", "b"]),
    ("a\n\n\n\nb", "\n\n", ["a", "b"]),
    ("\xa0\ta　\n\n \n\nb", "\n\n", ["a", "b"]),
    ("#", "\n\n", []),
    ("\n\n\n", "\n\n", []),
    ("\n# x", "\n\n", ["# x"]),
    ("a\n# x\n b \n\nc", "\n", ["a", "b", "c"]),
    ("one. two .#no. .three", ".", ["one", "two", "three"]),
    ("xa#ya#\x1c\x85 z", "a#", ["x", "y", "z"]),
    ("no delimiter", "\n", ["no delimiter"]),
]


def test_pieces_give_the_expected_chunks(spark):
    for delimiter in {d for _, d, _ in PIECES}:
        cases = [(t, c) for t, d, c in PIECES if d == delimiter]
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
        want = [(i, j, piece) for i, (_, chunks) in enumerate(cases) for j, piece in enumerate(chunks)]
        assert rows(chunk(df, delimiter=delimiter)) == sorted(want)


def test_chunks_of_random_texts_are_clean_and_in_order(spark):
    rng = random.Random(5)
    alphabet = "ab#\n\n\n \t\r\x0b\x1c\x85\xa0 ​😀"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    seen = {}
    for doc_id, index, piece in rows(chunk(df)):
        assert piece and not piece[0].isspace() and not piece[-1].isspace() and "\n\n" not in piece
        past = seen.setdefault(doc_id, [])
        assert index == len(past)
        past.append(piece)
    for doc_id, pieces in seen.items():
        at = 0
        for piece in pieces:  # each lies behind the one before it
            at = texts[doc_id].index(piece, at) + len(piece)


def test_chunking_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    assert "Exchange" not in chunk(df)._jdf.queryExecution().executedPlan().toString()


def test_files_are_read_whole_with_folded_newlines(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes("a\r\n\r\nb\r\rc\n\n# d".encode())
    (tmp_path / "two.txt").write_bytes("é".encode())
    documents = read_documents(spark, str(tmp_path))
    one, two = (f"{tmp_path}/{name}.txt" for name in ("one", "two"))
    assert rows(documents) == [(one, "a\n\nb\n\nc\n\n# d"), (two, "é")]
    assert rows(chunk(documents)) == [(one, 0, "a"), (one, 1, "b"), (one, 2, "c"), (two, 0, "é")]


def test_literal_documents_are_numbered(spark):
    assert rows(literal_documents(spark, ["a", "b"])) == [(0, "a"), (1, "b")]


def test_times_are_written_to_the_second(spark):
    got = spark.range(1).select(scalars.current_time(), scalars.format_time(F.lit("2024-01-02 03:04:05.9").cast("timestamp_ntz"))).first()
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", got[0])
    assert got[1] == "2024-01-02 03:04:05"


def test_previews_count_code_points(spark):
    df = spark.createDataFrame([("ab",), ("😀" * 160,), (None,)], "t string")
    got = [r[0] for r in df.select(text.preview("t")).collect()]
    assert got == ["ab...", "😀" * 100 + "...", None]
    assert df.select(text.clip("t", 150)).collect()[1][0] == "😀" * 150


def test_expression_whitelist(spark):
    cases = {"145 * 23": True, "2+a": False, "": True, "1+1\n": False, "\n1": False, "(1.5-2)/3": True}
    df = spark.createDataFrame([(c,) for c in cases], "e string")
    assert dict(rows(df.select("e", scalars.is_expression("e")))) == cases


def test_defaults_and_blank_questions(spark):
    df = spark.createDataFrame(
        [(" 　", None, None, None), (" why? \n", None, None, ""), ("x", "s", 9, "m")],
        "question string, session_id string, limit int, model string",
    )
    asked = scalars.search_requests(scalars.asked_questions(df))
    assert rows(asked.select("question", "limit")) == [("why?", 3), ("x", 9)]
    chosen = asked.select("question", scalars.or_model("model"))
    assert rows(chosen) == [("why?", fixed.GENERATE_MODEL), ("x", "m")]
    by_style = scalars.agent_requests(df.withColumn("style", F.lit("chat")).filter("model IS NULL"), "style")
    assert {r["model"] for r in by_style.collect()} == {fixed.CHAT_AGENT_MODEL}
    agents = scalars.agent_requests(df.filter("limit IS NULL"))
    assert {r["session_id"] for r in agents.collect()} == {"default"}


def test_payloads_of_both_styles(spark):
    df = spark.createDataFrame([("chat", 'say "hi"'), ("generate", "é")], "style string, prompt string")
    got = df.select(scalars.request_payload("style", F.lit("m"), "prompt", F.lit(True))).collect()
    assert got[0][0] == (
        '{"model":"m","messages":[{"role":"user","content":"say \\"hi\\""}],"stream":true}'
    )
    assert got[1][0] == '{"model":"m","prompt":"é","stream":true}'


def test_weather_keeps_number_text(spark):
    body = '{"current": {"temperature_2m": 20.50, "wind_speed_10m": 7}}'
    df = spark.createDataFrame([(body,), ("oops",)], "body string")
    got = df.select(scalars.weather_text("body"), scalars.weather_values("body")["wind_speed_10m"])
    assert got.collect()[0][0].startswith("Temperature: 20.5")
    assert [r[1] for r in got.collect()] == [7.0, None]
