"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names: for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontaminate, langid, media, near_dedup, passage_dedup, pieces, ppm, suffix_dedup, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"ord{i % 977} och" for i in range(30_000))
WORDS = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, WORDS, "en", "a", 1), (2, WORDS, "en", "a", 1), (3, None, "en", None, None), (4, "", "sv", "a", 0), (5, " \n\t ", None, "a", 3), (6, "kort text här", "sv", "b", 1), (None, WORDS, "en", "b", 1),
    (None, None, None, None, None), (7, "dubbel rad " * 30, "sv", "b", 1), (7, "dubbel rad " * 30, "sv", "b", 1), (7, "annan text", "sv", "b", 1), (8, LONG, "sv", "c", 1), (
        9, "▁ \x00\x01 é é 🎉 <|endoftext|>", "en", "c", 1
    ),
    (10, "12 34 !!", "en", "c", 1), (11, "x" * 300, "en", "c", 1), (12, WORDS + " slut", "en", "c", 1),
]
LABELS = [(1, 1), (6, 0), (7, 0), (7, 1), (None, 1), (8, None), (99, 1), (11, 0)]
BENCH = [
    (1, " ".join(f"w{i}" for i in range(20, 30))), (2, "kort text"), (None, WORDS), (3, None), (4, ""),
    (5, "w50 W51 w52, w53 w54 w55 w56 w57")
]


def tables(spark, docs):
    return {
        "labels": spark.createDataFrame(LABELS, "doc_id long, toxic int"),
        "benchmark": spark.createDataFrame(BENCH, "item_id long, text string")
    } | {"documents": docs}


OPERATORS = {
    "toxicity": lambda d, t: toxicity.toxicity(d, t["labels"]),
    "language": lambda d, t: langid.language_id(d),
    "suffix": lambda d, t: suffix_dedup.suffix_dedup(d),
    "decontaminate": lambda d, t: decontaminate.decontaminate_digest(decontaminate.decontaminate(d, t["benchmark"])),
    "near": lambda d, t: near_dedup.near_dedup(d),
    "ppm": lambda d, t: ppm.lm_score(d),
    "tokens": lambda d, t: tokens.tokenize(d, public_tokenizers.path("word_bpe_49k.json")),
    "passages": lambda d, t: passage_dedup.passage_dedup(d),
    "media": lambda d, t: media.media_digest(media.encode_media(d)),
    "pieces": lambda d, t: pieces.decode_pieces(pieces.encode_pieces(d, MODEL), MODEL),
    "pieces_at_once": lambda d, t: pieces.encode_pieces(d, MODEL, decoded=True),
}


def crowded(spark):
    extra = {
        c: F.lit(c) for c in (
            "b", "r", "kind", "data", "key", "sig", "hits", "score", "class_id", "text_id", "_kept", "ids", "part",
            "number", "salt", "h", "first"
        )
    }
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_answered(spark, name):
    docs = crowded(spark)
    got = OPERATORS[name](docs, tables(spark, docs)).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](docs, tables(spark, docs)).collect() == []


def by_id(rows, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) for r in rows if r["doc_id"] is not None and r["doc_id"] != 7}


def test_defined_results(spark):
    docs = crowded(spark)
    t = tables(spark, docs)
    cut = by_id(OPERATORS["suffix"](docs, t).collect(), "n_bytes", "n_removed", "n_spans")
    n = len(WORDS.encode())
    # the row without an id comes first
    assert cut[1] == cut[2] == (n, n, 1) and cut[3] == cut[4] == (0, 0, 0) and cut[11] == (300, 299, 1) and cut[12] == (n + 5, n, 1)
    lost = by_id(OPERATORS["passages"](docs, t).collect(), "n_words", "n_removed")
    assert lost[1] == lost[2] == (120, 120) and lost[12] == (121, 120) and lost[3] == lost[4] == lost[5] == (0, 0)
    classes = by_id(OPERATORS["near"](docs, t).collect(), "class_id")
    assert classes[2] == classes[12] == (1,) and classes[3] == (3,) and classes[4] == (4,) and classes[5] == (5,)
    found = by_id(OPERATORS["decontaminate"](docs, t).collect(), "n_hit", "n_items", "contaminated")
    assert found[1] == (18, 2, True) and found[6] == (2, 1, False) and found[3] == (0, 0, False)
    lang = by_id(OPERATORS["language"](docs, t).collect(), "lang_pred", "score", "rejected")
    assert lang[3] == lang[4] == lang[10] == ("und", 0.0, True)
    score = by_id(OPERATORS["ppm"](docs, t).collect(), "n_tokens", "score")
    assert score[3] == score[4] and score[4][0] == 1 and score[8][1] < score[6][1] < 0
    ids = by_id(OPERATORS["tokens"](docs, t).collect(), "n_tokens", "ids")
    assert ids[3] == ids[4] == (1, (1).to_bytes(4, "little"))
    texts = by_id(OPERATORS["pieces"](docs, t).collect(), "text", "ids")
    assert texts[3] == (None, None) and texts[4] == ("", []) and all(texts[r[0]][0] == r[1] for r in ROWS if r[0] in texts)
    assert texts == by_id(OPERATORS["pieces_at_once"](docs, t).collect(), "text", "ids")
    pictures = by_id(OPERATORS["media"](docs, t).collect(), "n_bytes", "payload_bytes", "feature")
    assert pictures[3] == pictures[4] and pictures[4][:2] == (0, 64) and pictures[1] == pictures[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    tables(spark, docs)["benchmark"].write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stage(spark, folder, stage):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = stage(spark, docs, folder)
    assert stage is corpus_pipeline.token_ids or out.dtypes == docs.dtypes
    assert stage(spark, docs.limit(0), folder).collect() == []
    # clashing names
    more = crowded(spark).withColumns(
        {c: F.lit(1) for c in ("_doc_id", "_later", "_n", "_row", "_text_key", "n_removed", "text_sha256", "n_words", "items")}
    )
    assert sorted(
        ((r["doc_id"], r["text"]) for r in stage(spark, more, folder).collect()), key=str
    ) == sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    near = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    assert sorted((r["doc_id"] for r in near if r["doc_id"]), key=str) == sorted([1, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11], key=str)
    assert sum(r["doc_id"] is None for r in near) == 2 and {
        r["text"] for r in near if r["doc_id"] == 7
    } == {"dubbel rad " * 30, "annan text"}
    cut = sorted((tuple(r) for r in corpus_pipeline.repeated_passages(spark, docs, folder).collect()), key=str)
    want = {12: ("slut", 4), 2: ("", 0), 1: ("", 0)}  # the row without an id comes first
    assert cut == sorted(((d, *(want.get(d, (t, n))[:1]), lang, source, want.get(d, (t, n))[1]) for d, t, lang, source, n in ROWS), key=str)
    clean = [r["doc_id"] for r in corpus_pipeline.without_benchmark(spark, docs, folder).collect()]
    assert sorted(clean, key=str) == sorted([None, 3, 4, 5, 7, 7, 7, 8, 9, 10, 11], key=str)
    last = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in last} <= {r[0] for r in ROWS} and all(r["n_ids"] == len(r["ids"]) for r in last)


def test_identified_documents_get_a_language(spark):
    rows = [
        (
            i, f"{a} {a}{b} {b} {a}" * 20, k if i % 5 else None
        ) for i in range(60) for a, b, k in [("ab", "ba", "x") if i % 2 else ("öå", "ål", "y")]
    ]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert {r["doc_id"]: r["lang"] for r in got} == {i: "x" if i % 2 else "y" for i, _, _ in rows}


def test_one_window_of_one_item_is_enough(spark, tmp_path):
    """A document with one window of 8 benchmark words goes, all others stay: also one with 7 of them."""
    item = "ett tva tre fyra fem sex sju atta nio tio elva"
    rows = [
        (1, f"fore {' '.join(item.split()[2:10])} efter"), (2, f"fore {' '.join(item.split()[2:9])} efter"),
        (3, "rent"), (4, None), (None, "utan id")
    ]
    spark.createDataFrame(
        [(1, item), (2, "nagot helt annat an det")], "item_id long, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.without_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 3, 4, None], key=str)


def test_rows_with_one_id_keep_their_own_texts(spark, tmp_path):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"a {shared} b"), (7, f"c {shared} d"), (7, f"{shared} e"), (7, "z z"), (7, f"{shared} e")]
    out = corpus_pipeline.repeated_passages(
        spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(0)), str(tmp_path)
    )
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted(
        [(1, f"a {shared} b"), (7, "c d"), (7, "e"), (7, "z z"), (7, "e")]
    )
