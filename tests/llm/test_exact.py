"""Against brute force, round trips, and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _arrow, _exchange, _ngrams, components, decontaminate, langid, media, near_dedup, passage_dedup, pieces, ppm, suffix_dedup, tokens, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def mutated(n=60, seed=3):
    """Few letters, so that repeats of all kinds abound; copies with edits; ties."""
    rng = random.Random(seed)
    base = [" ".join(rng.choice(("ab", "ba", "abc", "c")) for _ in range(rng.randrange(0, 220))) for _ in range(12)]
    out = []
    for i in range(n):
        words = rng.choice(base).split() + rng.choice(base).split()[:80]
        for _ in range(rng.randrange(4)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(("x", "yz"))
        out.append((i, " ".join(words)))
    return out + [(n, "a" * 400), (n + 1, "a" * 250), (n + 2, "é" * 90)]


@pytest.fixture(scope="module", params=["given", "mutated"])
def corpus(request, spark, rows):
    own = rows if request.param == "given" else mutated()
    return own, spark.createDataFrame(own, "doc_id long, text string")


def with_hot(module, plain, hot):
    """A bucket's function with another bound for what is frequent, wherever it runs."""

    def answer(r, entries, out):
        old, module.HOT = module.HOT, hot
        try:
            plain(r, entries, out)
        finally:
            module.HOT = old

    return answer


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup(corpus, hot, monkeypatch):
    # buckets' answers are worked out in workers, so what counts as hot goes with the function
    own, df = corpus
    monkeypatch.setattr(suffix_dedup, "_repeated_grams", with_hot(suffix_dedup, suffix_dedup._repeated_grams, hot))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup_digest(suffix_dedup.suffix_dedup(df)).collect()}
    assert got == suffix_dedup.brute_force([(d, t.encode()) for d, t in own])


def test_sort_suffixes():
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 4000).astype(np.uint8)
    raw[1000:1500] = raw[2000:2500]
    at = rng.permutation(3900)[:700]
    segment = np.sort(rng.integers(0, 9, 700))
    order = suffix_dedup.sort_suffixes(raw, _exchange.prefix_hashes(raw), at, segment)
    key = lambda i: (segment[i], raw[at[i] : at[i] + 100].tobytes(), i)
    assert order.tolist() == sorted(range(700), key=key)


def test_collisions_are_found_out(monkeypatch):
    weak = lambda prefix, begin, size: (prefix[begin + size] - prefix[begin]) * 0
    text = [b"%03d" % i * 40 for i in range(6)] + [b"000" * 40]
    raw = np.frombuffer(b"".join(t[:100] for t in text), np.uint8)
    runs = suffix_dedup._Runs(
        [np.zeros(7, np.uint64), np.arange(7), np.zeros(7, np.int64), np.ones(7, np.uint8), np.zeros(7, np.uint8), raw]
    )
    monkeypatch.setattr(suffix_dedup, "hash_of", weak)
    assert suffix_dedup._mark(runs, np.arange(7)).tolist() == [0, 0, 0, 0, 0, 0, 1]


@pytest.mark.parametrize("hot", [passage_dedup.HOT, 1])
def test_passage_dedup(corpus, hot, monkeypatch):
    own, df = corpus
    # buckets' answers are worked out in workers, so what counts as frequent goes with the function
    monkeypatch.setattr(passage_dedup, "_answer_probes", with_hot(passage_dedup, passage_dedup._answer_probes, hot))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passage_dedup.passage_dedup_digest(passage_dedup.passage_dedup(df)).collect()}
    assert got == passage_dedup.brute_force([(d, t.encode()) for d, t in own])


def test_passages_keep_space(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a\n{shared}\nb"), (2, f"c  d\n\n{shared} \n e\tf"), (3, shared)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]).decode() for r in passage_dedup.passage_dedup(df, keep_space=True).collect()}
    assert got == {1: f"a\n{shared}\nb", 2: "c  d\n\ne\tf", 3: ""}


def test_narrow_values():
    for x in ([], [0], [5, 6, 2**32 - 1], list(range(0, 2**24, 2**16))):
        v = np.array(x, np.uint32)
        assert passage_dedup._widen(passage_dedup._narrow(v)).tolist() == x


def test_near_dedup(spark, rows):
    own = [
        *rows,
        *((10_000 + i, " ".join(w if (i * 7 + j) % 41 else "ny" for j, w in enumerate(rows[k][1].split()))) for i, k in enumerate(range(0, 60, 2)))
    ]
    df = spark.createDataFrame(own, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(df).collect()}
    assert got == near_dedup.brute_force(own)


def test_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    own = [(i, " ".join(words[: i % 390 + 1] + ["x"] + words[i % 390 + 2 :])) for i in range(600)]
    got = near_dedup.near_dedup(spark.createDataFrame(own, "doc_id long, text string"))
    assert {r["class_id"] for r in got.collect()} == {0}


def star(n: int, seed: int = 5) -> list[tuple[int, str]]:
    """An original, the last one, and n copies at 0.85 to it, most pairs of which are under 0.8."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        own = [f"a{i}", *words[1:]]
        for k, at in enumerate(rng.sample(range(1, 32), 3)):
            own[at * 6] = f"b{i}x{k}"
        out.append((i, " ".join(own)))
    return [*out, (n, " ".join(words))]


@pytest.mark.parametrize(("n", "block", "hubs"), [(1000, near_dedup.BLOCK, near_dedup.HUBS), (150, 30, 0), (150, 30, 3)])
def test_copies_of_one_original(spark, n, block, hubs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    own = star(n)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    if n < 200:
        assert got == near_dedup.brute_force(own)
    # by definition: each copy is linked with the original
    assert all(set(near_dedup.brute_force([x, own[-1]]).values()) == {x[0]} for x in own)
    assert set(got.values()) == {0}


def test_pipeline_keeps_one_of_a_large_group(spark):
    import corpus_pipeline

    own = star(150) + [(1000 + i, t.replace("w", "v").replace("a", "c").replace("b", "d")) for i, t in star(150, 6)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(own, "doc_id long, text string"), "")
    first = near_dedup.brute_force(own)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(first.values())) == [0, 1000]


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    seen, true = [], []
    for _ in range(60):
        items = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        a = rng.integers(1, 20, 50)
        b = np.where(rng.random(50) < 0.5, a, rng.integers(1, 20, 50))
        sig = near_dedup.bag_min_hash(np.repeat([0, 1], 50), np.tile(items, 2), np.concatenate([a, b]), 2, 256)
        seen.append((sig[0] == sig[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(seen) - np.mean(true)) < 0.01


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 200: 0}


def test_pieces_of_ppm(rows):
    own = [(d, t.encode()) for d, t in rows[:20]]
    plains = [ppm.plain(t) for _, t in own]
    _, code = ppm.grams(plains)
    seen, count = np.unique(code, return_counts=True)
    _, pair = ppm.grams(plains, 1)
    got = ppm.log_probabilities(code, seen, count, *np.unique(pair, return_counts=True))
    trie = ppm.Trie()
    for _, t in own:
        trie.run(t, score=False, learn=True)
    assert abs(got.sum() - sum(trie.run(t) for _, t in own)) < 1e-6
    context = tuple(b"eht ")
    assert abs(sum(10 ** trie.log10(context, s) for s in range(ppm.SYMBOLS)) - 1) < 1e-6


def test_lm_score(spark, rows):
    own = [*rows[:60], (500, "ÅÄÖ nya ord " * 3), (501, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in ppm.lm_score(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    for d, want in ppm.brute_force([(d, t.encode()) for d, t in own]).items():
        assert got[d][:4] == want[:4] and got[d][4:] == pytest.approx(want[4:], abs=1e-6)


def test_adaptive_score(spark):
    """Against the chain of probabilities of one symbol after another; what repeats gets cheaper."""
    rng = random.Random(15)
    own = [(0, "ab " * 40), (1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120))), (2, ""), (3, None)]
    got = {r["doc_id"]: r["score"] for r in ppm.adaptive_score(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    for d, t in own:
        trie, total, context = ppm.Trie(), 0.0, (32,) * ppm.ORDER
        for s in [*ppm.plain((t or "").encode()), ppm.END]:
            chances = [10 ** trie.log10(context, x) for x in range(ppm.SYMBOLS)]
            assert abs(sum(chances) - 1) < 1e-9
            total += np.log10(chances[s])
            trie.learn(context, s)
            context = (s, *context)[: ppm.ORDER]
        assert got[d] == pytest.approx(total)
    assert got[2] == got[3] == pytest.approx(-np.log10(ppm.SYMBOLS)) and got[0] > got[1] / 3


def test_base_columns_against_sql(spark, sf):
    """What of op6 can be said in SQL, over the whole table."""
    import duckdb

    from corpusloom.llm import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    docs["held"] = [ppm.held_out(d) for d in docs["doc_id"]]
    con = duckdb.connect()
    con.register("d", docs)
    want = con.execute(r"""
        WITH w AS (SELECT doc_id, held, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [' ']) AS ws FROM d),
        t AS (SELECT doc_id, held, unnest(ws) AS token FROM w),
        c AS (SELECT token, count(*) AS c FROM t WHERE NOT held GROUP BY token),
        n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
        SELECT doc_id, any_value(held), count(*), count(c), any_value(n)::BIGINT, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) FROM t LEFT JOIN c USING (token), n GROUP BY doc_id""").fetchall()
    got = {r["doc_id"]: tuple(r)[1:6] for r in queries.op6_lm_score(spark, sf).collect()}
    assert len(got) == len(want)
    for d, *rest in want:
        assert got[d][:4] == tuple(rest[:4]) and got[d][4] == pytest.approx(rest[4], rel=1e-9)


def brute_hits(text, windows):
    words = decontaminate.plain_words(text.encode())
    hit, items = set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if (own := windows.get(tuple(words[i : i + n]))) is not None:
                hit.update(range(i, i + n))
                items |= own
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(items) >= 2


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 40])
def test_decontaminate(spark, rows, block):
    bench = [(i, t[40 : 40 + 25 * (i % 12)]) for i, (_, t) in enumerate(rows[:40])] + [(90, "av"), (91, "å é x"), (9, "The the")]
    windows: dict = {}
    for i, t in bench:
        w = decontaminate.plain_words(t.encode())
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    own = [*rows, (900, "x å é x the the"), (901, rows[0][1] * 2), (902, rows[5][1]), (902, rows[5][1])]
    found = decontaminate.decontaminate(
        spark.createDataFrame(own, "doc_id long, text string"),
        spark.createDataFrame(bench, "item_id long, text string"), block_windows=block
    )
    got = sorted(tuple(r) for r in decontaminate.decontaminate_digest(found).collect())
    assert got == sorted((d, *brute_hits(t, windows)) for d, t in own)


def test_simple_8b():
    rng = np.random.default_rng(4)
    for n in (0, 1, 239, 240, 241, 5000):
        ids = (rng.integers(0, 1 << 62, n) >> rng.integers(0, 62, n)).astype(np.uint64)
        ids[rng.random(n) < 0.3] = 0
        for odd in ((1 << 60) - 2, (1 << 60) - 1, 1 << 60, (1 << 64) - 1):
            ids[rng.random(n) < 0.02] = np.uint64(odd)
        shard = tokens.encode_shard(np.array([3, 4]), np.array([n // 3, n - n // 3]), ids, block=500)
        doc_ids, lengths, back = tokens.decode_shard(shard)
        assert (back == ids).all() and doc_ids.tolist() == [3, 4] and lengths.sum() == n
        for k in range(0, n, 500):
            assert (tokens.read_block(shard, k // 500) == ids[k : k + 500]).all()
    with pytest.raises(ValueError, match="shard"):
        tokens.decode_shard(b"x" * 100)


ODD = [
    "<|endoftext|>a b", "á ́b", "it's. don't 3.5,a! é.b —.a a.— a'.b", "\x1c\x1d \x85 q", "ÉG 가 ΑΣ Σ İstanbul",
    "a\x0bb\x0cc", "", " ", "ﬁx ǅ ʼn ẞ क़a", "ABC!! <|ENDOFTEXT|>"
]


@pytest.mark.parametrize("shard_ids", [tokens.SHARD_IDS, 300])
def test_token_ids(spark, rows, shard_ids, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = [*rows, *((1000 + i, t) for i, t in enumerate(ODD))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if shard_ids == 300 else 10_000)
    tokens.write_shards(spark.createDataFrame(own, "doc_id long, text string"), path, str(tmp_path / "shards"), shard_ids)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["doc_id"]: tuple(r)[1:] for r in tokens.token_digest(tokens.read_shards(spark, str(tmp_path / "shards"))).collect()}
    assert (spark.read.parquet(str(tmp_path / "shards")).count() > 20) == (shard_ids == 300)
    real, at = Tokenizer.from_file(path), 0
    for d, t in sorted(own):
        ids = [*real.encode(t, add_special_tokens=False).ids, 1]
        assert got[d] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_png():
    rng = np.random.default_rng(5)
    for n in (1, 64, 65, 5000):
        text = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        png = media.encode_png(media.padded(text), n)
        samples, size = media.decode_png(png)
        assert samples.tobytes() == media.padded(text) and size == n and png == media.encode_png(media.padded(text), n)
        broken = bytearray(png)
        broken[len(png) // 2] ^= 1
        with pytest.raises((media.BadPicture, zlib.error)):
            media.decode_png(bytes(broken))


def test_all_png_filters():
    rng = np.random.default_rng(6)
    want = rng.integers(0, 256, (12, 5)).astype(np.int64)
    lines = np.zeros((12, 6), np.uint8)
    for y in range(12):
        kind = lines[y, 0] = y % 5
        for x in range(5):
            a, b, c = (want[y, x - 1] if x else 0), (want[y - 1, x] if y else 0), (want[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines[y, x + 1] = (want[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256
    assert (media._unfilter(lines) == want).all()


def test_picture_hashes():
    text = ("ett två tre fyra fem sex " * 40).encode()
    near = text[:300] + b"X" + text[301:]
    a, b, c = (
        int(media.picture_hash(media.decode_png(media.encode_png(media.padded(t)))[0]), 16) for t in (text, near, bytes(range(256)) * 4)
    )
    assert (a ^ b).bit_count() < (a ^ c).bit_count()


def plain_picture(png: bytes) -> tuple[bytes, str]:
    """(payload, feature) of a picture, from the definitions: one sample and one cosine term at a time."""
    import math
    import struct

    at, idat, width, height = 8, b"", 0, 0
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, rows = zlib.decompress(idat), []
    for y in range(height):
        line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        out = []
        for x in range(width):
            left, above = out[x - 1] if x else 0, rows[y - 1][x] if y else 0
            out.append((line[x + 1] + (0, left, above)[line[0]]) % 256)
        rows.append(out)
    cut = lambda n: [(i * n // 32, max(i * n // 32 + 1, (i + 1) * n // 32)) for i in range(32)]
    small = [[sum(sum(r[c:d]) for r in rows[a:b]) / (b - a) / (d - c) for c, d in cut(width)] for a, b in cut(height)]
    cos = [[math.cos(math.pi * k * (2 * n + 1) / 64) for n in range(32)] for k in range(8)]
    half = [[sum(cos[k][y] * small[y][x] for y in range(32)) for x in range(32)] for k in range(8)]
    terms = [round(sum(half[k][x] * cos[m][x] for x in range(32)), 6) for k in range(8) for m in range(8)]
    middle = sorted(terms[1:])[31]
    bits = "".join("1" if t > middle else "0" for t in terms)
    return bytes(x for r in rows for x in r), f"{int(bits, 2):016x}"


def test_broken_pictures(spark):
    good = media.encode_png(media.padded(b"hej"), 3)
    rows = spark.createDataFrame(
        [(1, bytearray(good)), (2, bytearray(good[:-20])), (3, None), (4, bytearray(b"x"))], "doc_id long, media binary"
    )
    got = {r["doc_id"]: r for r in media.read_media(rows).collect()}
    assert bytes(got[1]["payload"]) == media.padded(b"hej") and got[1]["n_bytes"] == 3 and got[1]["error"] is None
    assert all(got[k]["payload"] is None and got[k]["feature"] is None and got[k]["error"] for k in (2, 3, 4))
    told = {r["doc_id"]: r["payload_sha256"] for r in media.media_digest(rows).collect()}
    assert told == {1: hashlib.sha256(media.padded(b"hej")).hexdigest(), 2: None, 3: None, 4: None}


def test_media_against_brute_force(spark, sf):
    """All columns over the whole table; pictures by a decoder and a cosine transform of its own."""
    from corpusloom.llm import queries

    own = spark.read.parquet(f"{sf}/documents.parquet")
    pictures = {r["doc_id"]: bytes(r["media"]) for r in media.encode_media(own).collect()}
    got = {r["doc_id"]: r for r in queries.op9_media(spark, sf).collect()}
    assert len(got) == own.count()
    for r in own.select("doc_id", "text").collect():
        text, row, png = (r["text"] or "").encode(), got[r["doc_id"]], pictures[r["doc_id"]]
        payload = text + b"\0" * (64 - len(text) % 64 if len(text) % 64 or not text else 0)
        seen, feature = plain_picture(png)
        assert seen == payload and row["feature"] == feature
        assert (
            row["n_bytes"], row["payload_bytes"], row["tail_crc32"], row["media_bytes"]
        ) == (len(text), len(payload), zlib.crc32(payload[-64:]), len(png))
        assert (row["payload_sha256"], row["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(png).hexdigest())


@pytest.fixture(scope="module")
def sampler():
    return pieces.Sampler(public_tokenizers.path("piece_bpe_32k.model"))


def test_segmentations_are_drawn_as_they_weigh(sampler):
    p = sampler.pieces
    by_raw = {raw: i for i, raw in enumerate(p.raw) if raw and i not in set(p.byte.tolist())}

    def ways(x):
        return [((), 0.0)] if not x else [
            ((i, *rest), p.weight[i] + w) for n in range(1, len(x) + 1) if (i := by_raw.get(x[:n])) for rest, w in ways(x[n:])
        ]

    all_ways = dict(ways(b" then"))
    n = 40_000
    ids, edges = sampler(np.arange(n), [b" then"] * n)
    from collections import Counter

    seen = Counter(tuple(ids[i:j].tolist()) for i, j in zip(edges[:-1], edges[1:], strict=True))
    total = np.logaddexp.reduce(list(all_ways.values()))
    assert set(seen) <= set(all_ways) and max(abs(seen[k] / n - np.exp(w - total)) for k, w in all_ways.items()) < 0.01


def test_units_leave_out_no_way(sampler):
    """Samples of texts that are cut into units, against all ways through their whole lattices."""
    from collections import Counter

    p = sampler.pieces
    by_raw = {raw: i for i, raw in enumerate(p.raw) if raw and i not in set(p.byte.tolist())}

    def ways(x):
        return [((), 0.0)] if not x else [
            ((i, *rest), p.weight[i] + w) for n in range(1, len(x) + 1) if (i := by_raw.get(x[:n])) for rest, w in ways(x[n:])
        ]

    n = 30_000
    for text in (b"of   it", b"a,  b", b"an.\"x"):
        all_ways = dict(ways(text))
        ids, edges = sampler(np.arange(n), [text] * n)
        seen = Counter(tuple(ids[i:j].tolist()) for i, j in zip(edges[:-1], edges[1:], strict=True))
        total = np.logaddexp.reduce(list(all_ways.values()))
        assert set(seen) <= set(all_ways) and max(abs(seen[k] / n - np.exp(w - total)) for k, w in all_ways.items()) < 0.012


def test_pieces_against_brute_force(spark, rows):
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600))
    own = [
        *rows[:40], *((5000 + i, t) for i, t in enumerate(ODD)), (6000, long), (6001, "x" * 400),
        (6002, " " * 300 + "slut  \n\n  ny"), (6003, "中文是世界上" * 60), (6004, None), (None, "utan id")
    ]
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encode_pieces(spark.createDataFrame(own, "doc_id long, text string"), model, decoded=True).collect()
    assert all(
        r["text"] == t for r, (_, t) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(own, key=lambda x: str(x[0])), strict=True)
    )
    assert {r["doc_id"]: r["ids"] for r in got} == dict(pieces.brute_force(own, model))


def test_long_units_are_quick(sampler):
    import time

    rng = random.Random(14)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()
    began = time.process_time()
    ids, _ = sampler(np.array([1]), [text])
    assert sampler.pieces.decode(ids) == text and time.process_time() - began < 10


def test_samples_follow_the_row_alone(sampler):
    other = pieces.Sampler(public_tokenizers.path("piece_bpe_32k.model"))
    other(np.array([5]), [b"annat innehall fore"])
    texts = [t.encode() for t in ODD] + [b"some words to be cut, again and again"]
    for s in (sampler, other):
        for key, text in enumerate(texts):
            ids, _ = s(np.array([key]), [text])
            ids_again, edges = sampler(np.array([1, key]), [b"x", text])
            assert (ids_again[edges[1] :] == ids).all() and s.pieces.decode(ids) == text
    assert any((len(sampler(np.array([k]), [texts[-1]])[0]) != len(sampler(np.array([0]), [texts[-1]])[0])) for k in range(20))


def test_unit_collisions_are_found_out(monkeypatch):
    s = pieces.Sampler(public_tokenizers.path("piece_bpe_32k.model"))
    real = s.lattices.numbers
    monkeypatch.setattr(
        s.lattices, "numbers",
        lambda raw, begin, size: real(raw, begin, size) if s.lattices.salt else np.zeros_like(real(raw, begin, size))
    )
    ids, _ = s(np.array([1]), [b"tva olika ord"])
    assert s.pieces.decode(ids) == b"tva olika ord" and s.lattices.salt == 1


def toxic_corpus(n=600):
    rng = random.Random(7)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randrange(5, 120))
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(("zwurk", "zwurkig", "Zwurkar!", "ozwurk"))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    got = toxicity.toxicity(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    ).collect()
    truth = dict(labels)
    assert all(
        r["held_out"] == (
            zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        ) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got
    )
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    one = toxicity.toxicity(
        spark.createDataFrame(docs[:3], "doc_id long, text string"),
        spark.createDataFrame(labels[1:3], "doc_id long, toxic int")
    ).collect()
    assert len({r["score"] for r in one}) == 1


def test_language(spark):
    rng = random.Random(8)
    words = {
        k: [
            "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(300)
        ] for k, letters in (("aa", "aeionrst"), ("bb", "åäöklmvg"), ("cc", "xyzwquio"))
    }
    docs = [(i, " ".join(rng.choices(words[k], k=rng.randrange(3, 80))), k) for i in range(300) for k in [("aa", "bb", "cc")[i % 3]]]
    docs += [(900, "12 34 ...", "aa"), (901, None, "bb"), (902, "aeio nrst", None)]
    got = {r["doc_id"]: r for r in langid.language_id(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    held = [(got[d], lang) for d, t, lang in docs if d < 900 and got[d]["held_out"]]
    assert np.mean([r["lang_pred"] == lang for r, lang in held]) > 0.97 and np.mean([r["rejected"] for r, _ in held]) < 0.05
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa"
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)


def test_held_out_languages(spark, docs):
    got = langid.language_id(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_rows_without_ids_are_spread_and_come_first(spark):
    rng = random.Random(12)
    words = [f"v{i}" for i in range(60)]
    texts = [" ".join([f"x{i}", *words, *rng.choices(words, k=70)]) for i in range(40)]
    own = [(None, t) for t in texts] + [(i, t) for i, t in enumerate(texts)] + [(None, "kort"), (None, None), (-5, texts[3] + " slut")]
    df = spark.createDataFrame(own, "doc_id long, text string")
    deal = _exchange.dealing(df)
    dealt = _exchange.dealt(df, deal).where("no_id = 1").groupBy("b").count().collect()
    assert len(dealt) == deal.batches and max(r["count"] for r in dealt) < 20
    for operator, brute, keys in (
        (suffix_dedup.suffix_dedup, suffix_dedup.brute_force, ("n_bytes", "n_removed")),
        (passage_dedup.passage_dedup, passage_dedup.brute_force, ("n_words", "n_removed"))
    ):
        got = operator(df).collect()
        assert sum(r["doc_id"] is None for r in got) == 42
        # by definition, with ids for those without one: the least, in the order of a hash of the text
        h = {r["text"]: r["h"] for r in df.where("doc_id IS NULL").select("text", F.pmod(F.xxhash64(F.col("text").cast("binary")), F.lit(1 << 62)).alias("h")).collect()}
        want = brute([(-(1 << 63) + h[t] if d is None else d, (t or "").encode()) for d, t in own])
        assert sorted(tuple(r[k] for k in keys) for r in got) == sorted(w[:2] for w in want.values())
        assert {
            r["doc_id"]: tuple(r[k] for k in keys) for r in got if r["doc_id"] is not None
        } == {d: w[:2] for d, w in want.items() if d > -1000}


def test_batches_follow_the_bytes(spark, docs, monkeypatch):
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert _exchange.dealing(docs) == (p, 2 * p, p, docs.count())
    monkeypatch.setattr(_exchange, "GROUP_BYTES", 10_000)
    monkeypatch.setattr(_exchange, "PAIR_BYTES", 10)
    deal = _exchange.dealing(docs)
    assert deal.partitions == p and deal.batches == 2 * deal.buckets > 40
    rows = [(r["doc_id"], r["text"].encode()) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passage_dedup.passage_dedup_digest(passage_dedup.passage_dedup(docs)).collect()}
    assert got == passage_dedup.brute_force(rows)


def test_anchors_of_equal_windows_agree():
    rng = np.random.default_rng(16)
    shared = " ".join(f"s{i}" for i in rng.integers(0, 1000, 80))
    words = passage_dedup.Words([f"a b c {shared} d".encode(), f"{shared} x y".encode(), " ".join(f"u{i}" for i in range(120)).encode()])
    at, _ = words.starts(passage_dedup.BLOCK)
    h = words.hashes(at, passage_dedup.BLOCK)
    hit = h % np.uint64(5) == 0
    start, doc = words.starts(passage_dedup.SPAN)
    anchor = passage_dedup._anchors(words, at[hit], h[hit], start)
    for s, p in zip(start.tolist(), anchor.tolist(), strict=True):
        near = [(h[k], at[k]) for k in np.flatnonzero(hit) if s <= at[k] <= s + passage_dedup.SPAN - passage_dedup.BLOCK]
        assert p == (min(near)[1] if near else -1)
    one, two = (anchor[doc == d] - start[doc == d] for d in (0, 1))
    assert (one[3:34] == two[:31]).all()


def test_matches_are_grown_from_anchors():
    ids = np.array([1, 2, 3, 4, 5, 6, 9, 2, 3, 4, 5, 7], np.uint64)
    x, y, three = np.array([2, 2, 2]), np.array([8, 8, 8]), np.array([2, 1, 0])
    left, right = passage_dedup._grown(ids, x, y, three, np.array([4, 2, 3]))
    assert left.tolist() == [1, 1, 0] and right.tolist() == [3, 2, 3]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that is the same for all windows, what runs have in common is still seen."""
    words = [f"w{i}" for i in range(75)]
    said = [words, words, [*words[:70], *"abcde"], ["x", *words[1:]]]
    entries = [
        [
            np.array([26], np.uint8), np.array([25], np.uint8), np.array([10 + i]), np.array([0], np.uint32),
            np.frombuffer(" ".join(w).encode(), np.uint8)
        ]
        for i, w in enumerate(said)
    ]
    for weak in (False, True):
        if weak:
            plain = passage_dedup.hash_of
            monkeypatch.setattr(
                passage_dedup, "hash_of",
                lambda p, b, n: plain(p, b, n) * np.uint64(0) if isinstance(n, int) and n == passage_dedup.SPAN else plain(p, b, n)
            )
        full = (1 << 26) - 1
        assert passage_dedup._extend(entries).tolist() == [0, full, full >> 5, full & ~1]


def test_even_labels(spark):
    labels = _exchange.even_labels(14, 7)
    rows = spark.createDataFrame([(x,) for x in labels], "b int").repartition(7, "b").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(rows) == 7 and {r["count"] for r in rows} == {2}


def test_every_language_has_a_share_of_the_sample(spark, monkeypatch):
    rows = [(i, "kort text", "sv") for i in range(20)] + [
        (100 + i, "lang text " * 30_000, "zz") for i in range(6)
    ] + [(7, "b", "sv"), (7, "a", "sv")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    some = langid.sample(df)
    assert {x for x, _ in some} == {"sv", "zz"} and sum(t == b"a" for _, t in some) <= 1
    assert max(len(t) for _, t in some) == langid.MAX_TEXT
    ids = [(d, lang) for d, _, lang in rows[:26]]
    held = _ngrams.chosen_texts(df, ids, "string", 100, 400)
    assert {k: sum(len(t) for x, _, t in held if x == k) for k in ("sv", "zz")} == {"sv": 20 * 9 - 8, "zz": 200}  # doc 7 has "a"
    many = spark.createDataFrame(
        [(i, k) for i in range(3000) for k in ("x", "y") if k == "x" or i % 7 == 0] + [(5, "x")] * 50,
        "doc_id long, class string"
    )
    monkeypatch.setattr(_ngrams, "MOST_CLASSES", 1)
    assert {k for _, k in _ngrams.chosen_ids(many, 100, 3)} == {"x"}
    monkeypatch.undo()
    chosen = _ngrams.chosen_ids(many, 100, 3)
    assert len(chosen) == len(set(chosen)) == 200 and sum(k == "x" for _, k in chosen) == 100


STRANGE = {
    "fi": "suomen kieli on uralilaisten kielten ryhmään kuuluva kieli jota puhutaan pääosin täällä ja sitä käytetään myös muualla",
    "ru": "русский язык является одним из самых распространенных языков мира и официальным языком нескольких государств",
    "zh": "中文是世界上 使用人数最多的 语言之一 它有很长 的历史 许多人 学习它 每天都有 很多人用",
    "la": "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
    "pl": "język polski jest jednym z języków słowiańskich używanym głównie w kraju oraz na całym świecie przez wielu ludzi",
    "tr": "türkçe başta olmak üzere geniş bir coğrafyada konuşulan bir dildir ve çok eski bir geçmişi vardır her yerde",
}


def test_strange_texts_are_rejected_and_known_ones_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("lang", "text", F.crc32(F.col("doc_id").cast("string")).alias("n")).collect()
    predict = langid.fit(sorted((r["lang"], r["text"].encode()) for r in rows if r["n"] % 3 != 1)).predictor()
    rng = random.Random(11)
    noise = [
        " ".join(
            "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(rng.randrange(6, 80))
        ) for _ in range(100)
    ]
    strange = [
        " ".join(w[i : i + n]) for t in STRANGE.values() for w in [t.split()] for n in (8, len(w)) for i in range(0, len(w) - n + 1, 4)
    ]
    for texts in (strange, noise):
        assert np.mean(predict([t.encode() for t in texts])[2]) >= 0.9
    held = [r["text"] for r in rows if r["n"] % 3 == 1]
    assert np.mean(predict([t.encode() for t in held])[2]) <= 0.01


def test_hot_keys_are_spread(spark, monkeypatch):
    """Rows of frequent keys, of rare ones, of unknown ones and of none are told what the table says, and are dealt evenly."""
    monkeypatch.setattr(_exchange, "LEAST_HOT", 50)
    monkeypatch.setattr(_exchange, "MOST_HOT", 10)
    names = [None, b"hot", b"rare", b"unknown"]
    own = [(i, names[1] if i % 3 else names[i % 4]) for i in range(3000)]
    rows = spark.createDataFrame(own, "doc_id long, key binary")
    table = spark.createDataFrame([(b"hot", 7, 2000), (b"rare", 8, 20)], "key binary, v long, n long")
    both = _exchange.told(rows, table, "key", len(own))
    assert sorted((r["doc_id"], r["v"]) for r in both.collect()) == sorted((i, {b"hot": 7, b"rare": 8}.get(k)) for i, k in own)


def test_arrow_batches_are_small(spark):
    old, full = spark.conf.get(_arrow.BATCH_SETTING), f"{_arrow.BATCH_BYTES}b"
    try:
        spark.conf.unset(_arrow.BATCH_SETTING)
        _arrow.small_batches(spark)
        assert spark.conf.get(_arrow.BATCH_SETTING) == full
        for given, changed in (("64m", True), ("67108864b", True), ("1m", False), ("4096", False)):
            spark.conf.set(_arrow.BATCH_SETTING, given)
            before = spark.conf.get(_arrow.BATCH_SETTING)
            _arrow.small_batches(spark)
            assert spark.conf.get(_arrow.BATCH_SETTING) == (full if changed else before)
    finally:
        spark.conf.set(_arrow.BATCH_SETTING, old)
