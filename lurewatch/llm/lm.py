"""Language-model scores: unigram base and a hashed maximum-entropy model.

Counts.  Every training text adds to one table of word counts, keyed by a 64-bit
hash and summed map-side; the table grows with the corpus and stays distributed.
Only its ``HEAD`` most frequent words, a fixed number, are sent to the workers.

Model.  The softmax is factored by class: P(word | history) = P(class | history)
* P(word | class).  Head words form ``CLASSES`` - 1 classes of about equal mass,
all other words one more, in which an unseen word has the weight of one.  The
class is predicted from hashed features (word before, two words before, the word
before that one alone) with weights in a table of fixed size.  Each round takes
another part of the training texts; every partition makes gradient steps on its
own in sparse numpy batches, and the weights are averaged by how often each row
was used, summed by Spark.

Scoring.  Head words are scored where the text is.  Of the other words only
(document, hash, times) leaves the worker, is joined with the count table, and
comes back as one sum per document.

Defined cases: a null or empty text is the end token alone; without training
texts all words are unknown; a null key counts as the empty string in the split;
equal rows are scored each; other columns are not returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import chunks, coded, keyed_text, segment_sums, words_of
from lurewatch.session import materialize

HEAD, CLASSES, ROW_BITS, ROUNDS = 1 << 16, 16, 15, 3
RATE, BATCH, PARTIAL = 0.2, 4096, 1_000_000
END = "\n"                  # no word holds white space
_START = np.uint64(0x5851F42D4C957F2D)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


END_HASH = int(pd.util.hash_array(np.array([END], dtype=object), categorize=False)[0])


def token_hashes(texts: pa.Array):
    """(hash of every token with the end tokens, tokens per text)."""
    words, n_words = words_of(pc.ascii_lower(texts))
    codes, distinct = coded(words)
    flat = _hash(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    return np.insert(flat, np.cumsum(n_words), np.uint64(END_HASH)), n_words + 1


def _merged(parts):
    key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def token_counts(training: DataFrame) -> DataFrame:
    """(hash, n) of all tokens of (doc_id, text)."""
    def run(batches):
        parts, held = [], 0
        for part in chunks(batches):
            h, _ = token_hashes(part.column("text"))
            parts.append(np.unique(h, return_counts=True))
            held += len(parts[-1][0])
            if held > PARTIAL:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > PARTIAL // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], names=["hash", "n"])
                    parts, held = [], 0
        if parts:
            h, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["hash", "n"])

    return training.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Head:
    """Classes of the frequent words and what the worker needs of the counts."""

    def __init__(self, hashes, counts, total, distinct, classes=CLASSES):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.distinct, self.classes = total, distinct, classes
        by_count = np.lexsort((self.hashes, -self.counts))
        mass = np.cumsum(self.counts[by_count])
        self.cls = np.zeros(len(order), np.int64)
        if len(order):
            self.cls[by_count] = np.minimum((mass - self.counts[by_count]) * (classes - 1) // mass[-1], classes - 2)
        within = np.bincount(self.cls, self.counts, minlength=classes)
        self.log_within = np.log10(self.counts / within[self.cls]) if len(order) else np.zeros(0)
        self.tail_mass = int(total - self.counts.sum())
        self.tail_words = int(distinct - len(order))

    def find(self, h):
        """(place in the head or -1, class) of hashes."""
        if not len(self.hashes):
            return np.full(len(h), -1), np.full(len(h), self.classes - 1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.where(hit, at, -1), np.where(hit, self.cls[at], self.classes - 1)


def feature_rows(h: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the three hashed features of every token."""
    first = np.cumsum(sizes) - sizes
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], two[2:] = h[:-1], h[:-2]
    one[first] = _START
    two[first] = _START
    two[np.minimum(first + 1, len(h) - 1)[sizes > 1]] = _START
    shift = np.uint64(64 - bits)
    return np.stack([(one * _MIX) >> shift, ((one * _MIX ^ two) * _MIX) >> shift,
                     ((two ^ np.uint64(0xD1B54A32D192ED03)) * _MIX) >> shift]).astype(np.int64)


def class_logits(weights, rows):
    s = weights[rows[0]] + weights[rows[1]] + weights[rows[2]] + weights[-1]
    return s - s.max(axis=1, keepdims=True)


def gradient_steps(weights, squares, used, rows, cls, rate=RATE, batch=BATCH):
    """Steps over mini-batches; ``used`` counts the tokens that touched each row."""
    for a in range(0, len(cls), batch):
        r, y = rows[:, a:a + batch], cls[a:a + batch]
        p = np.exp(class_logits(weights, r))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        flat = r.reshape(-1)
        order = np.argsort(flat, kind="stable")
        row, start, n = np.unique(flat[order], return_index=True, return_counts=True)
        g = np.add.reduceat(p[order % len(y)], start, axis=0) / np.sqrt(n)[:, None].astype(np.float32)
        squares[row] += g * g
        weights[row] -= rate * g / np.sqrt(squares[row])
        used[row] += n
        g = p.mean(axis=0) * np.sqrt(len(y))
        squares[-1] += g * g
        weights[-1] -= rate * g / np.sqrt(squares[-1])
        used[-1] += len(y)


def train(training: DataFrame, head: Head, bits=ROW_BITS, rounds=ROUNDS) -> np.ndarray:
    """Weights of 2^bits + 1 rows (the last one is the bias)."""
    context = training.sparkSession.sparkContext
    classes, size = head.classes, (1 << bits) + 1
    weights = np.zeros((size, classes), np.float32)
    names = [f"w{k}" for k in range(classes)]
    shared_head = context.broadcast(head)
    part = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds))
    for k in range(rounds):
        shared = context.broadcast(weights)

        def run(batches):
            head, mine = shared_head.value, shared.value.copy()
            squares, used = np.full(mine.shape, 1e-6, np.float32), np.zeros(len(mine), np.int64)
            for piece in chunks(batches):
                h, sizes = token_hashes(piece.column("text"))
                gradient_steps(mine, squares, used, feature_rows(h, sizes, bits), head.find(h)[1])
            row = np.flatnonzero(used)
            w = mine[row].astype(np.float64) * used[row][:, None]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(used[row]), *[pa.array(w[:, j]) for j in range(classes)]],
                                             names=["row", "used", *names])

        schema = "row long, used long, " + ", ".join(f"{n} double" for n in names)
        # one line per weight row: a fixed number
        found = training.filter(part == k).mapInArrow(run, schema).groupBy("row").agg(
            F.sum("used").alias("used"), *[F.sum(n).alias(n) for n in names]).toPandas()
        if len(found):
            weights = weights.copy()
            weights[found["row"].to_numpy()] = (found[names].to_numpy() / found["used"].to_numpy()[:, None]).astype(np.float32)
        shared.unpersist()
    return weights


SCORED = ("doc_id long, crc long, size long, hash long, word boolean, n long, n_tokens long, n_known long, "
          "base double, model double")


def score_part(batch: pa.RecordBatch, head: Head, weights: np.ndarray, bits: int) -> pa.RecordBatch:
    """One summary row per text, and one row per other word and text."""
    texts = batch.column("text")
    ids = batch.column("doc_id")
    h, sizes = token_hashes(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place, cls = head.find(h)
    rows = feature_rows(h, sizes, bits)
    log_class = np.empty(len(h))
    for a in range(0, len(h), 1 << 16):
        s = class_logits(weights, rows[:, a:a + (1 << 16)])
        log_class[a:a + (1 << 16)] = s[np.arange(len(s)), cls[a:a + (1 << 16)]] - np.log(np.exp(s).sum(axis=1))
    inside = place >= 0
    log_count = np.where(inside, np.log10(head.counts[place] + 1.0) if len(head.counts) else 0.0, 0.0)
    within = np.where(inside, head.log_within[place] if len(head.counts) else 0.0,
                      -np.log10(head.tail_mass + head.tail_words + 1.0))
    base = segment_sums(log_count, sizes) - sizes * np.log10(head.total + head.distinct + 1.0)
    model = segment_sums(log_class / np.log(10) + within, sizes)
    known = segment_sums(inside.astype(np.int64), sizes)
    out = np.flatnonzero(~inside)
    other, code = np.unique(h[out], return_inverse=True)
    pair, times = np.unique(doc[out] * max(len(other), 1) + code, return_counts=True)
    at, word = pair // max(len(other), 1), other[pair % max(len(other), 1)] if len(other) else np.zeros(0, np.uint64)
    raw = [t.as_py().encode("utf-8", "surrogatepass") for t in texts]
    crc, size = np.array([zlib.crc32(r) for r in raw], np.int64), np.array([len(r) for r in raw], np.int64)
    spread = (crc.astype(np.uint64) * _MIX + size.astype(np.uint64)).view(np.int64)
    nothing = np.zeros(len(at), np.int64)
    both = lambda a, b: pa.array(np.concatenate([a, b]))
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([ids, ids.take(pa.array(at))]), both(crc, crc[at]), both(size, size[at]),
         both(spread, word.view(np.int64)), both(np.zeros(len(sizes), bool), np.ones(len(at), bool)),
         both(np.ones(len(sizes), np.int64), times), both(sizes, nothing), both(known, nothing),
         both(base, nothing.astype(float)), both(model, nothing.astype(float))],
        names=[x.split()[0] for x in SCORED.split(", ")])


def score_documents(docs: DataFrame, key="doc_id", text="text", head_words: int = HEAD, classes: int = CLASSES,
                    bits: int = ROW_BITS, rounds: int = ROUNDS, folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: split, token counts, base and model log10 probability."""
    rows = keyed_text(docs, key, text)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held
    training = rows.filter(~held_out)
    counts = materialize(token_counts(training), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "hash").limit(head_words).toPandas()     # a fixed number of words
    head = Head(top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total.n, total.v, classes)
    weights = train(training, head, bits, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((head, weights))

    def run(batches):
        head, weights = shared.value
        for part in chunks(batches):
            yield score_part(part, head, weights, bits)

    scored = rows.mapInArrow(run, SCORED)
    table = counts.select("hash", F.lit(True).alias("word"), F.col("n").alias("c"))
    seen = F.coalesce(F.col("c"), F.lit(0))
    log = F.when(F.col("word"), F.col("n") * F.log10(seen + 1.0)).otherwise(0.0)
    joined = scored.join(table, ["hash", "word"], "left")
    one = joined.groupBy("doc_id", "crc", "size").agg(
        F.sum(F.when(~F.col("word"), 1).otherwise(0)).alias("rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("word") & (seen > 0), F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + log).alias("base"), F.sum(F.col("model") + log).alias("model"))
    # equal rows were summed up together
    each = one.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("copy"))
    return each.select("doc_id", held_out.alias("held_out"), F.expr("n_tokens div rows").alias("n_tokens"),
                       F.expr("n_known div rows").alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"),
                       (F.col("base") / F.col("rows")).alias("base_score"), (F.col("model") / F.col("rows")).alias("score"))


def op8_maxent_scores(spark, sf_dir):
    """Base and model scores of every document."""
    from lurewatch.llm.common import documents
    return score_documents(documents(spark, sf_dir))
