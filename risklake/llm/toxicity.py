"""Toxic spans by a linear-chain conditional random field.

Two states, toxic and other. A word's features are hashed: the word, its prefixes of 4 to 7 bytes, the words beside it. The
chain runs over sentences (to the next . ! ? or line end, at most SENTENCE words). Forward-backward gives every word its
marginal probability; runs of words at 0.5 or more are the offending spans, and a logistic function of a document's largest
marginal, their sum and their noisy-or is its score.

Training. Documents carry the labels, so words are labelled from them: in a toxic document, a word is toxic if one of its
features has log odds for toxic documents that stay at SEED_ODDS or more when SEED_ERRORS standard errors are taken off
(equal texts count once); all other words are not. The sample is bounded: at most SAMPLE_TOXIC and SAMPLE_OTHER labelled rows, the first by a hash of
doc_id among those with a text of at most SAMPLE_CHARS characters, one text each. Class weights bring back the proportions of all labelled rows.
Scoring reads whole texts and no column but text.

Cases. Null and empty texts have no words and the score of a document without toxic words. Null labels and labels other than 0 and
1 are left out; a doc_id labelled twice is toxic if any label says so. Without labelled rows of both kinds every score is 0.
Rows that repeat whole are scored each. An empty table gives no rows. Columns that bear one of the output's names are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklake.llm.common import aside, back_again, settle, table
from risklake.llm.wordhash import Words, alphanumeric_table, text_groups

SAMPLE_TOXIC = 1500
SAMPLE_OTHER = 2500
SAMPLE_CHARS = 50_000
SENTENCE = 64
BITS = 20
PREFIXES = (4, 5, 6, 7)
#: The feature that every word has; the others are odd, or 0 for none.
ALWAYS = 2
SEED_ODDS = 1.0
SEED_ERRORS = 2.0
#: Of the sample's sentences without a seed word, one in so many is trained on.
THIN = 8
ROUNDS = 30
RATE = 0.5
RIDGE = 0.3
#: One document in so many is kept from the chain's training and fits the head, if it leaves HEAD_TOXIC toxic ones.
HEAD_SHARE = 4
HEAD_TOXIC = 5
FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _spread(h: np.ndarray, kind: int) -> np.ndarray:
    """Feature numbers of a kind; number 0 is no feature."""
    h = (h ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(64 - BITS)).astype(np.int64) | 1


def prefix_hashes(words: Words, n: int) -> np.ndarray:
    """Hash of each word's first n bytes; 0 for shorter words."""
    long = (words.ends - words.starts) >= n
    h = np.zeros(len(words), np.uint64)
    at = words.starts[long]
    part = np.zeros(len(at), np.uint64)
    for k in range(n):
        part = part * np.uint64(0x100000001B3) + words.data[at + k].astype(np.uint64)
    h[long] = part + np.uint64(1)
    return h


def own_features(words: Words, hashes: np.ndarray) -> list[np.ndarray]:
    """Numbers of each word's own features."""
    found = [np.full(len(words), ALWAYS), _spread(hashes, 1)]
    for k, n in enumerate(PREFIXES):
        h = prefix_hashes(words, n)
        found.append(np.where(h > 0, _spread(h, 2 + k), 0))
    return found


@dataclass
class Chains:
    """Sentences of a group of documents: first word and number of words of each, longest first, and all words' features."""

    starts: np.ndarray
    lengths: np.ndarray
    features: list[np.ndarray]

    def active(self, t: int) -> int:
        """Number of sentences of more than t words."""
        return int(np.searchsorted(-self.lengths, -t, side="left"))


def chains(words: Words) -> Chains:
    n = len(words)
    hashes = words.hashes()
    breaks = np.zeros(n + 1, bool)
    breaks[words.docs] = True
    marks = np.isin(words.raw, np.frombuffer(b".!?\n", np.uint8))
    passed = np.cumsum(marks)
    if n:
        breaks[1:n] |= passed[words.starts[1:]] != passed[words.starts[:-1]]
    firsts = np.flatnonzero(breaks[:n])
    place = np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))
    breaks[:n] |= place % SENTENCE == 0
    firsts = np.flatnonzero(breaks[:n])
    lengths = np.diff(np.append(firsts, n))
    features = own_features(words, hashes)
    starts = breaks[:n]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n > 1:
        before[1:] = np.where(starts[1:], 0, _spread(hashes[:-1], 11))
        after[:-1] = np.where(starts[1:], 0, _spread(hashes[1:], 12))
    order = np.argsort(-lengths, kind="stable")
    return Chains(firsts[order], lengths[order], [*features, before, after])


def scores(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    total = np.zeros(len(features[0]), np.float64)
    for f in features:
        total += weights[f]
    return np.clip(total, -30, 30)


def forward_backward(found: Chains, score: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginal of the toxic state for each word, and the expected number of each move; moves: log weights, from and to."""
    step = np.exp(moves)
    odds = np.exp(score)
    ahead = np.zeros((2, len(score)))
    longest = int(found.lengths[0]) if len(found.lengths) else 0
    for t in range(longest):
        at = found.starts[: found.active(t)] + t
        if t:
            a, b = ahead[0, at - 1], ahead[1, at - 1]
            x, y = a * step[0, 0] + b * step[1, 0], (a * step[0, 1] + b * step[1, 1]) * odds[at]
        else:
            x, y = np.ones(len(at)), odds[at]
        total = x + y
        ahead[0, at], ahead[1, at] = x / total, y / total
    marginal = ahead[1].copy()
    back = np.ones((2, len(score)))
    counts = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = found.starts[: found.active(t + 1)] + t
        x, y = back[0, at + 1], back[1, at + 1] * odds[at + 1]
        p, q = step[0, 0] * x + step[0, 1] * y, step[1, 0] * x + step[1, 1] * y
        a, b = ahead[0, at], ahead[1, at]
        total = a * p + b * q
        counts += [[(a * step[0, 0] * x / total).sum(), (a * step[0, 1] * y / total).sum()], [(b * step[1, 0] * x / total).sum(), (b * step[1, 1] * y / total).sum()]]
        marginal[at] = b * q / total
        back[0, at], back[1, at] = p / (p + q), q / (p + q)
    return marginal, counts


def document_evidence(marginal: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each document: largest marginal, log(1 + sum), and -log of the probability that no word is toxic; 0 without words."""
    n = len(docs) - 1
    out = np.zeros((n, 3))
    full = np.flatnonzero(np.diff(docs))
    if len(full):
        at = docs[full]
        out[full, 0] = np.maximum.reduceat(marginal, at)
        out[full, 1] = np.log1p(np.add.reduceat(marginal, at))
        out[full, 2] = np.minimum(np.add.reduceat(-np.log1p(-np.minimum(marginal, 1 - 1e-9)), at), 50)
    return out


@dataclass
class Model:
    weights: np.ndarray
    moves: np.ndarray
    head: np.ndarray

    def marginals(self, words: Words) -> np.ndarray:
        if not len(words):
            return np.zeros(0)
        found = chains(words)
        return forward_backward(found, scores(self.weights, found.features), self.moves)[0]

    def document_scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.head[1:] + self.head[0], -30, 30)))


NO_MODEL = Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), np.array([-30.0, 0, 0, 0]))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton steps of a ridge logistic regression, the constant first."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(curve, slope)
    return w


def train(texts: list[str], toxic: np.ndarray, shares: tuple[float, float]) -> Model:
    """Fit on the sample. shares: weight of a row that is not toxic, and of one that is."""
    if not len(texts) or toxic.min() == toxic.max():
        return NO_MODEL
    order = np.argsort(toxic, kind="stable")
    spare = np.zeros(len(texts), bool)
    spare[order[::HEAD_SHARE]] = True
    if toxic[spare].sum() < HEAD_TOXIC:
        spare[:] = False
    chain_texts, chain_toxic = [t for t, s in zip(texts, spare.tolist(), strict=True) if not s], toxic[~spare]
    model = Model(*_train_chain(chain_texts, chain_toxic), np.zeros(4))
    held = spare if spare.any() else ~spare
    own = [t for t, h in zip(texts, held.tolist(), strict=True) if h]
    evidence = np.zeros((len(own), 3))
    for first, last, words in _grouped(own):
        evidence[first:last] = document_evidence(model.marginals(words), words.docs)
    y = toxic[held]
    model.head = _logistic(evidence, y.astype(float), np.where(y == 1, shares[1], shares[0]))
    return model


def _grouped(texts: list[str]) -> list[tuple[int, int, Words]]:
    return [(first, last, words) for first, last, words in text_groups(pa.array(texts, pa.large_string()), alphanumeric_table()) if len(words)]


def _train_chain(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the moves."""
    groups = _grouped(texts)
    seen = np.zeros((2, 1 << BITS))
    for first, _, words in groups:
        owner = words.owner()
        for f in own_features(words, words.hashes()):
            pairs = np.unique(owner << BITS | f)
            rows = pairs >> BITS
            for label in (0, 1):
                own = toxic[first + rows] == label
                seen[label] += np.bincount(pairs[own] & ((1 << BITS) - 1), minlength=1 << BITS)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()], float)
    seen = np.minimum(seen, n[:, None])
    logit = np.log((seen + 0.5) / (n[:, None] - seen + 0.5))
    error = np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    seed = (logit[1] - logit[0] - SEED_ERRORS * error >= SEED_ODDS) & (seen[1] > 0)
    seed[[0, ALWAYS]] = False

    weights, moves = np.zeros(1 << BITS), np.zeros((2, 2))
    squares, move_squares = np.full(1 << BITS, 1e-6), np.full((2, 2), 1e-6)
    trained = []
    for first, _, words in groups:  # only the kept sentences' words stay in memory
        found = chains(words)
        hinted = np.logical_or.reduce([seed[f] for f in found.features[:-2]])
        label = hinted & (toxic[first + words.owner()] == 1)
        some = np.array([h.any() for h in np.split(hinted, np.sort(found.starts)[1:])])[np.argsort(np.argsort(found.starts))]
        keep = some | (np.arange(len(some)) % THIN == 0)
        firsts, lengths = found.starts[keep], found.lengths[keep]
        at = np.concatenate([np.arange(a, a + k) for a, k in zip(firsts.tolist(), lengths.tolist(), strict=True)]) if len(firsts) else np.empty(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        y = label[at].astype(np.int64)
        real = np.zeros((2, 2))
        inner = np.ones(len(at), bool)
        inner[starts] = False
        np.add.at(real, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
        trained.append((Chains(starts, lengths, [f[at].astype(np.int32) for f in found.features]), y, real))
    for _ in range(ROUNDS):
        slope, move_slope = RIDGE * weights, RIDGE * moves
        for found, y, real in trained:
            marginal, counts = forward_backward(found, scores(weights, found.features), moves)
            for f in found.features:
                slope = slope + np.bincount(f, weights=marginal - y, minlength=1 << BITS)
            move_slope = move_slope + counts - real
        slope[0] = 0
        squares += slope**2
        move_squares += move_slope**2
        weights -= RATE * slope / np.sqrt(squares)
        moves -= RATE * move_slope / np.sqrt(move_squares)
    return weights.astype(np.float32), moves


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows outside the held-out fold."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {row["toxic"]: row["n"] for row in usable.groupBy("toxic").agg(F.count("*").alias("n")).toLocalIterator()}
    short = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    usable = usable.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = settle(usable.filter("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(usable.filter("toxic = 0").orderBy(*order).limit(SAMPLE_OTHER)))
    # The broadcast side has at most SAMPLE_TOXIC + SAMPLE_OTHER rows of two numbers, and one task gets one text for each: the
    # bounded sample, and not the driver, which gets the model.
    texts = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sorted((row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)), key=lambda row: (row[0], row[2]))
        rows = sorted({text: (text, mark) for _, mark, text in told}.values())
        toxic = np.array([row[1] for row in rows], np.int64)
        held = [max(1, int((toxic == k).sum())) for k in (0, 1)]
        model = train([row[0] for row in rows], toxic, tuple(totals.get(k, 0) / held[k] for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    fitted = texts.select("doc_id", "toxic", "text").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(fitted[0]["model"]) if fitted else NO_MODEL


SPAN = T.StructType([T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])


def score(docs: DataFrame, model: Model, with_spans: bool = True) -> DataFrame:
    """docs(text, ...) -> docs with score and, if asked for, spans: the offending words, in words and code points, ends not included."""
    docs = docs.drop("score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType()), *[T.StructField("spans", T.ArrayType(SPAN))] * with_spans]

    def spans_of(words: Words, marginal: np.ndarray) -> dict[int, list[dict]]:
        found: dict[int, list[dict]] = {}
        hits = np.flatnonzero(marginal >= 0.5)
        if not len(hits):
            return found
        owner = words.owner()
        chars = np.concatenate([[0], np.cumsum((words.raw & 0xC0) != 0x80)])
        for at in hits.tolist():
            row = int(owner[at])
            base, origin = int(words.docs[row]), int(chars[words.origin[row]])
            a, b = int(chars[words.starts[at]]) - origin, int(chars[words.ends[at]]) - origin
            own = found.setdefault(row, [])
            if own and own[-1]["end_word"] == at - base:
                own[-1] |= {"end_word": at - base + 1, "end_char": b}
            else:
                own.append({"start_word": at - base, "end_word": at - base + 1, "start_char": a, "end_char": b})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, shared.value.document_scores(np.zeros((1, 3)))[0])
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for first, last, words in text_groups(batch.column(batch.schema.get_field_index("text")), alphanumeric_table()):
                marginal = shared.value.marginals(words)
                out[first:last] = shared.value.document_scores(document_evidence(marginal, words.docs))
                for row, own in (spans_of(words, marginal) if with_spans else {}).items():
                    spans[first + row] = own
            made = [pa.array(out)]
            if with_spans:
                made.append(pa.array(spans, pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN.fields]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score `threshold` or more."""
    names = ("score", "spans")
    kept = score(aside(docs, names), fit(docs, labels), with_spans=False).filter(F.col("score") < threshold)
    return back_again(kept, docs, names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    places = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start_char"].cast("string"), x["end_char"].cast("string"))), ",")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(places, 256).alias("spans_sha256"),
    )
