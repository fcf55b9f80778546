from pyspark.sql import functions as F

from corpusloom.streaming import pages as S


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_gives_what_a_batch_gives(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/pages.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    S.start(
        S.arriving_pages(spark, str(tmp_path / "in"), files_per_trigger=1), str(tmp_path / "cache"),
        str(tmp_path / "check"), F.lit("nu")
    ).awaitTermination()
    got = {r["url"]: tuple(r) for r in S.current_cache(spark, str(tmp_path / "cache")).collect()}
    want = rows_of(S.batch_rows(spark.read.parquet(f"{sf}/pages.parquet"), F.lit("nu")))
    assert set(got) == {r[0] for r in want} and len(got) > 10 and sum(got[r[0]] == r for r in want) > 0.9 * len(want)


def test_no_batch_yet(spark, tmp_path):
    assert S.current_cache(spark, str(tmp_path / "ingen")).collect() == []
    S.compact(spark, str(tmp_path / "ingen"), str(tmp_path / "liten"))


def test_later_versions_replace_earlier_ones(spark, tmp_path):
    html = lambda t: f"<html><title>{t}</title><p>{t * 20}</p></html>"
    take = lambda at: S.start(
        S.arriving_pages(spark, str(tmp_path / "in"), "url string, html string"), str(tmp_path / "cache"),
        str(tmp_path / "check"), F.lit(at)
    ).awaitTermination()
    for at, pages in (
        ("1", [("https://a.se/x", "ett"), ("https://a.se/y", "y")]),
        ("2", [("https://A.se/x/", "tva"), ("https://a.se/b.png", "z")]), ("3", [])
    ):
        spark.createDataFrame(
            [(u, html(t)) for u, t in pages], "url string, html string"
        ).write.mode("append").parquet(str(tmp_path / "in"))
        take(at)
    want = {"https://a.se/x": ("tva", "2"), "https://a.se/y": ("y", "1")}
    assert {r["url"]: (r["title"], r["crawled_at"]) for r in S.current_cache(spark, str(tmp_path / "cache")).collect()} == want
    S.compact(spark, str(tmp_path / "cache"), str(tmp_path / "small"))
    assert rows_of(S.current_cache(spark, str(tmp_path / "small"))) == rows_of(S.current_cache(spark, str(tmp_path / "cache")))
