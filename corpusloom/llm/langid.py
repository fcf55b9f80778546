"""Language identification: averaged hashed subword embeddings under a linear softmax (after Joulin et al., 2016).

A text is the mean of the embeddings of its words' hashed subwords (2 to 5 characters with the spaces around the word, and
the word itself). Embeddings and the softmax layer are trained together by stochastic gradient descent in numpy, on segments
of whole training texts of 1 to 60 words, so short texts are no surprise. As the layer is linear, a trained model is one
table of logits a subword, and a worker adds up each word's once.

Calibration, on training texts kept out of the descent: one temperature that makes the probabilities fit (least
log-loss), then two bounds, each for texts of as many different words (of 1, 2, 4 ... LENGTHS; between them by the logarithm):

* The confidence that only REJECT of known texts of that length, or of a shorter one, fall under.
* The familiarity: a softmax is as sure of a strange text as of its own, so words are also held against how often their
  subwords stand in each language (mean logarithm of the share, of the best language, over the text's different words).
  Strange texts for calibration are each language's own texts held against all other languages alone, and texts whose
  words' letters are shuffled. The bound is half way between what REJECT of known texts fall under and what all but
  REJECT_STRANGE of the strange ones stay under; where these overlap, the former alone.

A text is rejected if it falls under either.

Trained on at most MAX_ROWS texts a language, those with the least hash of their doc_id (of rows with one doc_id the text
that sorts first), on the first MAX_TEXT bytes of each, and MAX_BYTES together: each language has an equal share of them,
filled in order of the hashes. Of more than MOST_CLASSES languages the most frequent are learned.
Null languages and rows without doc_id are not learned. Null texts and texts without a letter are `und` with score 0 and
rejected; so is all if nothing can be learned. Ties go to the language that sorts first. Repeated rows give repeated
results, an empty table an empty one. Only the text is an input of a prediction.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import let_go, map_texts, sliced, texts, values
from ._ngrams import Vocabulary, all_features, chosen_ids, chosen_texts, word_features, words_of

LOW, HIGH = 2, 5
BUCKETS, SIZE = 1 << 17, 16
MAX_ROWS, MAX_BYTES, MAX_TEXT = 400, 64 << 20, 256 << 10
EPOCHS, LEAST_STEPS, RATE, GROUP, SEED = 3, 300, 8.0, 128, 7
REJECT, REJECT_STRANGE = 0.001, 0.02
#: Different words of the texts that bounds are calibrated for, and at most so many texts of each length from a calibration text.
LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128, 256)
PIECES_OF_A_TEXT = 4
UNKNOWN = "und"


def in_training(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """False for the held-out part; true for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts != part, F.lit(True))


def sample(docs: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str, bytes]]:
    """(lang, text), the same number of each language at most, in order of lang and doc_id."""
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(in_training(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("class")
    )
    ids = chosen_ids(rows, max_rows, 3)
    return [(lang, text) for lang, _, text in chosen_texts(docs, ids, "string", MAX_TEXT, MAX_BYTES)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, known: np.ndarray | None = None):
        """table, known: a row for each bucket, of logits and of familiarities, with a column for each language."""
        self.langs, self.table, self.bias = langs, table, bias
        self.known = np.zeros_like(table) if known is None else known
        self.temperature = 1.0
        self.sure, self.familiar = np.full(len(LENGTHS), -np.inf), np.full(len(LENGTHS), -np.inf)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """A row a word: the sums of its subwords' logits, their number, and the means of its familiarities (0 without a letter)."""
        owner, feature = word_features(words, LOW, HIGH, BUCKETS)
        n = np.bincount(owner, minlength=len(words))
        sums = [np.bincount(owner, t[feature, k], len(words)) for t in (self.table, self.known) for k in range(len(self.langs))]
        letters = np.array([any(c.isalpha() for c in w) for w in words], bool)
        return np.stack(
            [*sums[: len(self.langs)], n, *(np.where(letters, x / np.maximum(n, 1), 0) for x in sums[len(self.langs) :]), letters],
            axis=1
        )

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.word_rows, 2 * len(self.langs) + 2)

    def judged(self, vocabulary: Vocabulary, own: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, familiarities, number of different words with letters) of texts."""
        k = len(self.langs)
        numbers = vocabulary.look_up(own)
        table = vocabulary.table
        sums, means, count = np.zeros((len(own), k + 1)), np.zeros((len(own), k)), np.zeros(len(own))
        for i, x in enumerate(numbers):
            if x:
                word, many = np.unique(np.array(x), return_counts=True)
                rows = table[word]
                sums[i] = many @ rows[:, : k + 1]
                own_sum = rows[:, k + 1 :].sum(axis=0)
                count[i], means[i] = own_sum[-1], own_sum[:-1] / max(own_sum[-1], 1)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias, means, count

    def bounds(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, x = np.log2(np.maximum(count, 1)), np.log2(LENGTHS)
        return np.interp(at, x, self.sure), np.interp(at, x, self.familiar)

    def predictor(self):
        vocabulary = self.vocabulary()

        def predict(raw: list[bytes]) -> tuple[list[str], list[float], list[bool]]:
            own = [words_of(t) for t in raw]
            if not self.langs or not raw:
                return [UNKNOWN] * len(raw), [0.0] * len(raw), [True] * len(raw)
            z, means, count = self.judged(vocabulary, own)
            p = softmax(z / self.temperature)
            best, top, letters = p.argmax(axis=1), p.max(axis=1), count > 0
            sure, familiar = self.bounds(count)
            rejected = ~letters | (top < sure) | (means.max(axis=1) < familiar)
            return [
                self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)
            ], np.where(letters, top, 0.0).tolist(), rejected.tolist()

        return predict


def _shuffled(word: str, rng: np.random.Generator) -> str:
    return "".join(word[i] for i in rng.permutation(len(word)))


def _calibrate(model: Model, texts_: list[list[str]], truth: np.ndarray, rng: np.random.Generator) -> None:
    """Temperature and bounds, from words of texts that weren't learned from."""
    vocabulary, k = model.vocabulary(), len(model.langs)
    z, _, _ = model.judged(vocabulary, texts_ + [x[:20] for x in texts_])
    both = np.concatenate([truth, truth])
    heats = np.geomspace(0.05, 5, 60)
    model.temperature = float(min(heats, key=lambda h: -np.log(np.maximum(softmax(z / h)[np.arange(len(both)), both], 1e-300)).sum()))
    other = ~np.eye(k, dtype=bool)
    for j, n in enumerate(LENGTHS):
        parts, lang = [], []
        for x, y in zip(texts_, truth, strict=True):
            words = list(dict.fromkeys(w for w in x if any(c.isalpha() for c in w)))
            starts = range(0, len(words) - n + 1, max(n, (len(words) - n + 1) // PIECES_OF_A_TEXT))
            parts += [words[i : i + n] for i in starts]
            lang += [y] * len(starts)
        if not parts:
            # no text is that long: bounds of shorter ones hold on
            model.sure[j:], model.familiar[j:] = (model.sure[j - 1], model.familiar[j - 1]) if j else (0.0, -np.inf)
            break
        z, means, _ = model.judged(vocabulary, parts)
        model.sure[j] = np.quantile(softmax(z / model.temperature).max(axis=1), REJECT, method="lower")
        _, noise, _ = model.judged(vocabulary, [[_shuffled(w, rng) for w in x] for x in parts])
        strange = [noise.max(axis=1)] + ([np.where(other[np.array(lang)], means, -np.inf).max(axis=1)] if k > 1 else [])
        low, high = np.quantile(means.max(axis=1), REJECT, method="lower"), max(np.quantile(x, 1 - REJECT_STRANGE) for x in strange)
        model.familiar[j] = (low + high) / 2 if high < low else low
    model.sure = np.minimum.accumulate(model.sure)  # a longer text needs no more


def fit(rows: list[tuple[str, bytes]]) -> Model:
    langs = sorted({lang for lang, _ in rows})
    rng = np.random.default_rng(SEED)
    own = [words_of(t) for _, t in rows]
    y = np.array([langs.index(lang) for lang, _ in rows], np.int64)
    kept = np.zeros(len(rows), bool)
    for k in range(len(langs)):
        mine = np.flatnonzero(y == k)
        kept[mine[4::5]] = True  # for calibration
    number = {w: i for i, w in enumerate(dict.fromkeys(w for x, k in zip(own, kept, strict=True) if not k for w in x))}
    if not number:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    begin, feature = all_features(list(number), LOW, HIGH, BUCKETS)
    segments: list[tuple[np.ndarray, int]] = []
    for x, k, lang in zip(own, kept, y, strict=True):
        if k or not x:
            continue
        ids, at = np.array([number[w] for w in x]), 0
        while at < len(ids):
            n = int(rng.integers(1, 61))
            segments.append((ids[at : at + n], int(lang)))
            at += n
    embed, layer, bias = rng.normal(0, 1 / SIZE, (BUCKETS, SIZE)), np.zeros((SIZE, len(langs))), np.zeros(len(langs))
    each = -(-len(segments) // GROUP)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each)) if each else 0  # few texts are gone through more often
    steps = epochs * each
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(segments))
        for a in range(0, len(order), GROUP):
            part = [segments[i] for i in order[a : a + GROUP]]
            word = np.concatenate([x for x, _ in part])
            many = begin[word + 1] - begin[word]
            at = np.repeat(begin[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            doc = np.repeat(np.repeat(np.arange(len(part)), [len(x) for x, _ in part]), many)
            # one entry for each subword of each segment
            key, count = np.unique(feature[at].astype(np.int64) * len(part) + doc, return_counts=True)
            feat, doc = key // len(part), key % len(part)
            share = count / np.bincount(doc, count, len(part))[doc]
            mean = np.stack([np.bincount(doc, share * embed[feat, k], len(part)) for k in range(SIZE)], axis=1)
            error = softmax(mean @ layer + bias)
            error[np.arange(len(part)), [k for _, k in part]] -= 1
            rate = RATE * (1 - step / steps)
            back = error @ layer.T / len(part)
            layer -= rate * mean.T @ error / len(part)
            bias -= 0.1 * rate * error.sum(axis=0) / len(part)
            edges = np.flatnonzero(np.append(True, feat[1:] != feat[:-1]))
            embed[feat[edges]] -= rate * len(part) * np.add.reduceat(share[:, None] * back[doc], edges, axis=0)
            step += 1
    # how familiar a subword is: the logarithm of its share in each language's training words
    seen = np.ones((BUCKETS, len(langs)))
    for x, k, lang in zip(own, kept, y, strict=True):
        if not k and x:
            word = np.array([number[w] for w in x])
            many = begin[word + 1] - begin[word]
            at = np.repeat(begin[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            seen[:, lang] += np.bincount(feature[at], minlength=BUCKETS)
    known = np.log2(seen / seen.sum(axis=0))
    model = Model(langs, (embed @ layer).astype(np.float32), bias, known.astype(np.float32))
    test = [i for i in np.flatnonzero(kept) if own[i]]
    if test:
        _calibrate(model, [own[i] for i in test], y[test], rng)
    return model


def language_id(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, max_rows)))  # BUCKETS rows

    def fn(batch, predict):
        lang, score, rejected = predict(values(batch))
        return {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": score, "rejected": rejected}

    found = map_texts(texts(docs), fn, "doc_id long, lang_pred string, score double, rejected boolean", lambda: model.value.predictor())
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The rows of docs whose text isn't rejected, in the same pass. A lang that is null becomes the predicted one; all else stays as it was."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, max_rows)))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        predict = model.value.predictor()
        for batch in sliced(batches):
            lang, _, rejected = predict([(x or "").encode("utf-8", "replace") for x in batch.column("text").to_pylist()])
            at = batch.schema.get_field_index("lang")
            batch = batch.set_column(
                at, batch.schema.field(at),
                pc.coalesce(batch.column("lang"), pa.array(lang, batch.schema.field(at).type))
            )
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))
        del predict
        let_go()

    return docs.mapInArrow(run, docs.schema)
