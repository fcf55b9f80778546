"""The pipeline end to end, against the definitions of its stages."""

import re

import public_tokenizers

import corpus_pipeline
from corpusloom.llm import decontaminate, langid, near_dedup, passage_dedup, pieces


def without_repeats(rows: list[tuple[int, str]], span: int = passage_dedup.SPAN) -> dict[int, str]:
    """Texts without the words under windows that a smaller doc_id has too; a removed run goes with the space behind it."""
    seen: dict[tuple, int] = {}
    out = {}
    for d, text in sorted(rows):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        words = [text[a:b] for a, b in spans]
        gone = [False] * len(words)
        for i in range(len(words) - span + 1):
            if seen.setdefault(tuple(words[i : i + span]), d) < d:
                gone[i : i + span] = [True] * span
        kept = text[: spans[0][0]] if spans else text
        for k, (a, _) in enumerate(spans):
            end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
            kept += "" if gone[k] else text[a:end]
        out[d] = kept
    return out


def test_end_to_end(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rejected = {r["doc_id"] for r in langid.language_id(docs).where("rejected").collect()}
    rows = {d: t for d, t in rows.items() if d not in rejected}
    first = near_dedup.brute_force(list(rows.items()))
    rows = {d: t for d, t in rows.items() if first[d] == d}
    rows = without_repeats(list(rows.items()))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = decontaminate.plain_words((r["text"] or "").encode())
        windows |= {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7) if w else 0)}

    def leaked(text: str) -> bool:
        w = decontaminate.plain_words(text.encode())
        return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

    clean = {d: t for d, t in rows.items() if not leaked(t)}
    assert 0 < len(clean) < len(rows) < docs.count()
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {d: r["text"] for d, r in got.items()} == clean
    some = sorted(clean.items())[::7]
    assert {d: got[d]["ids"] for d, _ in some} == dict(pieces.brute_force(some, public_tokenizers.path("piece_bpe_32k.model")))


def test_near_duplicates_shuffles_documents_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = corpus_pipeline.near_duplicates(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    # a second version of one document: both texts stay, and no row is lost
    own = docs.where("doc_id % 20 = 0")
    least = own.agg({"doc_id": "min"}).first()[0]
    again = own.where(f"doc_id = {least}").selectExpr(*("reverse(text) AS text" if c == "text" else c for c in docs.columns))
    once = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, own, sf).collect()}
    both = own.unionAll(again)
    both.unionAll(again).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), sf).collect()]
    assert len(got) == len(set(got)) and set(got) == once | {(r["doc_id"], r["text"]) for r in again.collect()}
