import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("before", "after"),
    [
        (
            "skriv till a.b+c@ex-1.se.", "skriv till [E-POST]."
        ), ("19850312-1234", "[PERSONNUMMER]"), ("850372+1234 x", "[PERSONNUMMER] x"), ("851312-1234", "851312-1234"),
        ("070-123 45 67", "[TELEFON]"), ("+46 (0)8 123 45 67", "[TELEFON]"), ("ip 999.1.1.1!", "ip [IP-ADRESS]!"), ("", ""), ("1.2.3", "1.2.3"),
    ],
)
def test_personal_data(spark, before, after):
    masked = one(spark, before, T.clean_pii)
    assert masked == after
    assert one(spark, masked, T.clean_pii) == masked


def test_flags(spark):
    text = "a@b.se 10.0.0.1"
    assert one(spark, text, lambda t: T.clean_pii(t, ["remove_ip"])) == "a@b.se [IP-ADRESS]"
    assert one(spark, text, lambda t: T.clean_pii(t, {"remove_email": F.lit(True), "remove_ip": F.lit(False)})) == "[E-POST] 10.0.0.1"
    assert one(spark, None, T.clean_pii) is None


def test_hash(spark):
    want = hashlib.sha256("åbc".encode()).hexdigest()
    assert {one(spark, t, T.clean_hash) for t in ("Å b\tC", "å bc\n", "ÅBC", "å\x1fbc")} == {want}


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 1), (400, 1), (401, 2), (750, 2), (751, 3), (1100, 3), (1101, 4)])
def test_chunk_counts(spark, n, count):
    words = [f"w{i}" for i in range(n)]
    chunks = one(spark, " \n".join(words), T.text_chunks)
    assert len(chunks) == count
    assert [(c["chunk_index"], c["total_chunks"]) for c in chunks] == [(i + 1, count) for i in range(count)]
    if n > 400:
        parts = [c["content"].split(" ") for c in chunks]
        assert all(len(p) == 400 for p in parts[:-1]) and 50 < len(parts[-1]) <= 400
        assert parts[0] + [w for p in parts[1:] for w in p[50:]] == words
        assert [c["heading"] for c in chunks[:2]] == ["Huvudinnehåll", "Huvudinnehåll (del 2)"]
    elif n:
        assert chunks[0]["content"] == " \n".join(words)


def test_sections(spark):
    sections = F.array(
        *(F.struct(F.lit(h).alias("heading"), t.alias("text")) for h, t in (("A", F.lit(" a ")), ("B", F.lit("  ")), ("C", F.repeat(F.lit("c "), 401))))
    )
    chunks = one(spark, "", lambda _: T.semantic_chunks(sections))
    assert [
        (c["heading"], c["chunk_index"], c["total_chunks"], len(c["content"].split())) for c in chunks
    ] == [("A", 1, 3, 1), ("C", 2, 3, 400), ("C (del 2)", 3, 3, 51)]
    with pytest.raises(ValueError, match="overlap"):
        T.semantic_chunks(sections, 400, 0)


def test_markdown(spark):
    md = "före\n# A\n\ntext\n####### sju\n## tom\n# B\nx\n"
    got = [(s["heading"], s["text"]) for s in one(spark, md, T.markdown_sections)]
    assert got == [("Huvudinnehåll", "före"), ("A", "text\n####### sju"), ("B", "x")]
    links = lambda t: T.absolute_markdown_links(t, F.lit("https://a.se/d/p"))
    assert one(
        spark, "[x](y) /z [](q) [m](mailto:a) [h](#h) [](", links
    ) == "[x](https://a.se/d/y) /z [](https://a.se/d/q) [m](mailto:a) [h](#h) []("


def test_no_python_in_plans(spark):
    df = spark.createDataFrame([("x",)], "t string").select(
        T.text_chunks(T.clean_pii(F.col("t"))), T.clean_hash(F.col("t")), T.markdown_sections(F.col("t"))
    )
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
