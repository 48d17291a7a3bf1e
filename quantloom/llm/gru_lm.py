"""Operator 1: scoring by a gated recurrent language model."""

from __future__ import annotations

import heapq
import pickle
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import keep_freed, tidy
from ._store import Scratch

END = b"\n"  # stands for the end token; no word has white space
HIDDEN, HEAD_CLASSES, TAIL_CLASSES, CLASS_WORDS = 16, 32, 32, 32
CLASSES, HEAD, TAIL_BUCKETS = HEAD_CLASSES + TAIL_CLASSES, HEAD_CLASSES * CLASS_WORDS, TAIL_CLASSES * CLASS_WORDS
SYMBOLS = HEAD + TAIL_BUCKETS  # the frequent words, and buckets of all others
LANES, LEAST_LANES, WINDOW = 512, 32, 16
CHUNK_TOKENS = 4_000_000
HOT_WORDS = 1 << 18
_EDGES = b".,;:!?\"'()|*$&%#-"


def tail_bucket(word: bytes) -> int:
    """The bucket of a word outside the head: its class by the two last bytes of its visible part, its place there by all of it."""
    return zlib.crc32((word.rstrip(_EDGES) or word)[-2:]) % TAIL_CLASSES * CLASS_WORDS + zlib.crc32(word) % CLASS_WORDS


def _texts(batch: pa.RecordBatch):
    """The texts as UTF-8 bytes, few of them in Python at a time."""
    for k in range(0, batch.num_rows, 64):
        yield from batch["text"].slice(k, 64).cast(pa.binary()).to_pylist()


def _counts(docs: DataFrame) -> DataFrame:
    """(word, tail, n, m) of the tokens of ``docs`` (text, learn): how often they stand in texts to learn from, and in all.

    Each task counts before the shuffle, in bounded memory.
    """
    schema = pa.schema([("word", pa.binary()), ("tail", pa.int32()), ("n", pa.int64()), ("m", pa.int64())])

    def rows(counter, learn):
        words, n = list(counter), pa.array(counter.values(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(tail_bucket, words), pa.int32()), n if learn else pa.array(np.zeros(len(words), np.int64)), n], schema=schema)

    def run(batches):
        counters = {True: Counter(), False: Counter()}
        for batch in batches:
            learn = batch["learn"].to_pylist()
            for k, text in enumerate(_texts(batch)):
                counters[learn[k]].update((text or b"").lower().split())
                counters[learn[k]][END] += 1
                if k % 64 == 63 and sum(map(len, counters.values())) > 400_000:
                    for which, counter in counters.items():
                        yield rows(counter, which)
                        counter.clear()
        for which, counter in counters.items():
            yield rows(counter, which)

    return docs.select("text", "learn").mapInArrow(tidy(run), "word binary, tail int, n long, m long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"), F.sum("m").alias("m"))


class _Index(dict):
    """Numbers of frequent words; another word gives -1-bucket and is put down in ``rare``."""

    rare: list[bytes]

    def __missing__(self, word: bytes) -> int:
        self.rare.append(word)
        return -1 - tail_bucket(word)


class Lexicon:
    """Frequent words with their counts; ``total`` and ``distinct`` are over all words."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, tail_sums: dict[int, tuple[int, int]]):
        """``tail_sums``: per tail bucket the number of all its words outside the head and the sum of their counts."""
        self.total, self.distinct = total, distinct
        self.words = words
        self.counts = np.array(counts, np.float64)
        n = len(words)
        self.symbol = np.array([k if k < HEAD else HEAD + tail_bucket(w) for k, w in enumerate(words)], np.int32)
        self.norm = np.log10(total + 0.5 * (distinct + 1))
        self.tail_counts = np.array([tail_sums.get(g, (0, 0))[1] + 0.5 * (tail_sums.get(g, (0, 0))[0] + 1) for g in range(TAIL_BUCKETS)])
        self.tail_norm = np.log10(self.tail_counts)
        self.base = np.log10(self.counts + 0.5) - self.norm
        inside = np.log10(self.counts + 0.5) - self.tail_norm[np.maximum(self.symbol - HEAD, 0)]
        self.within = np.where(np.arange(n) < HEAD, 0.0, inside)
        self.head_counts = np.zeros(HEAD)
        self.head_counts[: min(n, HEAD)] = self.counts[:HEAD]
        self._index: _Index | None = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None}

    @property
    def index(self) -> _Index:
        if self._index is None:
            self._index = _Index(zip(self.words, range(len(self.words))))
        return self._index

    def look_up(self, text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
        """Numbers of a text's tokens, the end included (index 0 is the end token); -1-bucket where a word isn't frequent."""
        index = self.index
        index.rare = []
        found = array("i", map(index.__getitem__, (text or b"").lower().split()))
        found.append(0)
        return np.frombuffer(found, np.int32), index.rare


def initial_weights(lexicon: Lexicon, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the output biases are log frequencies, so the untrained model is the unigram model."""
    rng = np.random.default_rng(seed)
    f = lambda *shape, s=0.1: rng.normal(0, s, shape).astype(np.float32)
    counts = np.concatenate([lexicon.head_counts + 1e-2, lexicon.tail_counts]).reshape(CLASSES, CLASS_WORDS)
    sums = counts.sum(axis=1)
    return {"X": f(SYMBOLS, 3 * HIDDEN, s=0.3), "U": f(HIDDEN, 3 * HIDDEN, s=0.25), "C": f(HIDDEN, CLASSES, s=0.05), "c": np.log(sums / sums.sum()).astype(np.float32), "W": f(SYMBOLS, HIDDEN, s=0.05), "w": np.log(counts / sums[:, None]).reshape(-1).astype(np.float32)}


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, longest first, always to the emptiest."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-lengths, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (n + int(lengths[d]), k))
    return out


class Lanes:
    """Documents one after another in lanes, longest lane first, cut into windows: memory is in proportion to the tokens."""

    def __init__(self, docs: list[np.ndarray], lanes: int):
        lengths = np.array([len(d) for d in docs])
        dealt = sorted(lanes_of(lengths, lanes), key=lambda own: -int(lengths[own].sum()))
        order = np.concatenate([np.array(own, np.int64) for own in dealt])
        self.target = np.concatenate([docs[d] for d in order.tolist()])
        starts = np.cumsum(lengths[order]) - lengths[order]
        self.source = np.empty_like(self.target)
        self.source[1:] = self.target[:-1]
        self.source[starts] = 0  # a document begins after an end
        self.fresh = np.zeros(len(self.target), bool)
        self.fresh[starts] = True
        self.number = np.repeat(order.astype(np.int32), lengths[order])
        self.sizes = np.array([int(lengths[own].sum()) for own in dealt])
        self.at = np.cumsum(self.sizes) - self.sizes

    def windows(self, cells: int, most: int = 16 * WINDOW):
        """(input symbols, target symbols, whether a document starts, its number or -1), a column for every lane still at work.

        A window has WINDOW steps or, where few lanes are left, up to ``most``, so that it holds about ``cells`` tokens.
        """
        t, end = 0, int(self.sizes[0])
        while t < end:
            active = int(np.searchsorted(-self.sizes, -t))
            n = min(max(WINDOW, min(most, cells // active)), end - t)
            step = t + np.arange(n)[:, None]
            real = step < self.sizes[:active]
            places = np.where(real, self.at[:active] + step, 0)
            yield self.source[places], self.target[places], self.fresh[places] & real, np.where(real, self.number[places], -1)
            t += n


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over runs of rows; two numbers count as a complex one, so that NumPy walks through half as many columns."""
    pairs = rows.view(np.result_type(rows.dtype, np.complex64))
    return np.add.reduceat(pairs, starts, axis=0).view(rows.dtype)


class GruModel:
    """The recurrent network; ``weights`` as of initial_weights()."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights
        self.moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.steps = 0

    def _start(self, lanes: int) -> np.ndarray:
        return np.zeros((lanes, HIDDEN), self.p["U"].dtype)

    def _squares(self) -> np.ndarray:
        """U as a square for each of both gates and the cell."""
        return np.ascontiguousarray(self.p["U"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))

    def forward(self, source: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step of a window, from state ``h``, the last of them, and with ``keep`` what the way back needs.

        Gates and cell lie in arrays of their own: no step works on columns of a wider one.
        """
        n, (steps, lanes), squares = HIDDEN, source.shape, self._squares()
        parts = source.reshape(-1) * 3 + np.arange(3)[:, None]
        x = self.p["X"].reshape(-1, n).take(parts, axis=0).reshape(3, steps, lanes, n)
        gate_u, cell_u, held = -squares[:2], squares[2], steps if keep else 1
        empty = lambda *shape: np.empty((*shape, lanes, n), squares.dtype)
        out, before, gates, u, c = empty(steps), empty(held), empty(2, held), empty(held), empty(held)
        begins = fresh.any(axis=1)
        for t in range(steps):
            k = t if keep else 0
            if begins[t]:
                h = h * ~fresh[t][:, None]
            if keep:
                before[t] = h
            g, cell = gates[:, k], c[k]
            np.matmul(h, gate_u, out=g)
            g -= x[:2, t]
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[1], np.matmul(h, cell_u, out=u[k]), out=cell)
            cell += x[2, t]
            np.tanh(cell, out=cell)
            h = np.subtract(h, cell, out=out[t])
            h *= g[0]
            h += cell
        return out, h, (before, gates, u, c)

    def _logits(self, states: np.ndarray, target: np.ndarray):
        """Rows put class by class: their order, states with a last column of ones for the biases, the classes that
        occur with their rows, logits of classes and of the class's symbols, and where the targets stand in them."""
        kind = target // CLASS_WORDS
        order = np.argsort(kind.astype(np.int16), kind="stable")
        kind, place, at = kind.take(order), (target - kind * CLASS_WORDS).take(order), np.arange(len(order))
        cuts = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
        classes = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        s = np.ones((len(order), HIDDEN + 1), states.dtype)
        s[:, :HIDDEN] = states.take(order, axis=0)
        outer, w = s @ np.vstack([self.p["C"], self.p["c"]]), self._biased()
        inner = np.empty((len(order), CLASS_WORDS), w.dtype)
        for k, rows in classes:
            np.matmul(s[rows], w[k].T, out=inner[rows])
        return order, s, classes, outer, inner, at * CLASSES + kind, at * CLASS_WORDS + place

    def _biased(self) -> np.ndarray:
        """W with its biases as a last column, class by class."""
        return np.hstack([self.p["W"], self.p["w"][:, None]]).reshape(CLASSES, CLASS_WORDS, HIDDEN + 1)

    def log_likelihood(self, states: np.ndarray, target: np.ndarray, block: int = 8192) -> np.ndarray:
        """Natural log of P(class) P(symbol in class), per row."""
        found = np.empty(len(states))
        for first in range(0, len(states), block):
            order, _, _, outer, inner, own, within = self._logits(states[first : first + block], target[first : first + block])
            out = outer.reshape(-1).take(own) + inner.reshape(-1).take(within)
            for logits in (outer, inner):
                out -= np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], logits.dtype))
            found[first + order] = out
        return found

    def score(self, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
        """log10 probability of each document's symbols; the state is carried over all windows of a document."""
        out, h = np.zeros(len(docs)), None
        for source, target, fresh, number in Lanes(docs, lanes).windows(32_768):
            h = self._start(source.shape[1]) if h is None else h[: source.shape[1]]
            states, h, _ = self.forward(source, fresh, h)
            real = np.flatnonzero(number.reshape(-1) >= 0)
            out += np.bincount(number.reshape(-1).take(real), self.log_likelihood(states.reshape(-1, HIDDEN).take(real, axis=0), target.reshape(-1).take(real)), len(docs))
        return out / np.log(10)

    def _gradients(self, source, target, fresh, real, h):
        return self._learn(source, target, fresh, real, h)[0]

    def _learn(self, source, target, fresh, real, h):
        """Gradients of a window, and the state after it."""
        n = HIDDEN
        states, last, (before, (z, r), u, c) = self.forward(source, fresh, h, keep=True)
        flat, taken = states.reshape(-1, n), np.flatnonzero(real.reshape(-1))
        order, s, classes, outer, inner, own, within = self._logits(flat.take(taken, axis=0), target.reshape(-1).take(taken))
        share = max(len(taken), LEAST_LANES * WINDOW)  # few lanes, a small step
        for d, at in ((outer, own), (inner, within)):
            np.exp(d, out=d)
            d /= (d @ np.ones(d.shape[1], d.dtype))[:, None]
            d.reshape(-1)[at] -= 1
        over, w = s.T @ outer, self._biased()
        under, back = np.zeros_like(w), np.empty((len(s), n), w.dtype)
        for k, rows in classes:
            np.matmul(inner[rows].T, s[rows], out=under[k])
            np.matmul(inner[rows], w[k, :, :n], out=back[rows])
        back += outer @ self.p["C"].T
        back /= share
        grads = {"C": over[:n] / share, "c": over[n] / share, "W": under[..., :n].reshape(-1, n) / share, "w": under[..., n].reshape(-1) / share}
        dh_out = np.zeros_like(flat)
        dh_out[taken.take(order)] = back
        dh_out = dh_out.reshape(states.shape)
        keep = 1 - z
        into_c, into_z, into_r = keep * (1 - c * c), (before - c) * z * keep, u * r * (1 - r)
        # the ways into the cell's square of U, into both gates, and into the cell
        ways, dh, begins = np.empty((4, *states.shape), flat.dtype), np.zeros_like(before[0]), fresh.any(axis=1)
        squares = self._squares()[[2, 0, 1]].transpose(0, 2, 1)
        for t in range(len(source) - 1, -1, -1):
            dh += dh_out[t]
            of_u, of_z, of_r, of_c = ways[:, t]
            np.multiply(dh, into_c[t], out=of_c)
            np.multiply(dh, into_z[t], out=of_z)
            np.multiply(of_c, into_r[t], out=of_r)
            np.multiply(of_c, r[t], out=of_u)
            dh *= z[t]
            for d in np.matmul(ways[:3, t], squares):
                dh += d
            if begins[t]:
                dh *= ~fresh[t][:, None]
        du, dz, dr = np.matmul(before.reshape(-1, n).T, ways[:3].reshape(3, -1, n))
        grads["U"] = np.hstack([dz, dr, du])
        order = np.argsort(source.reshape(-1).astype(np.int16), kind="stable")
        seen, dx = source.reshape(-1).take(order), np.empty((len(order), 3 * n), flat.dtype)
        for k, way in enumerate(ways[1:].reshape(3, -1, n)):
            dx[:, k * n : (k + 1) * n] = way.take(order, axis=0)
        first = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
        grads["X"] = (seen[first], _sums(dx, first))
        return grads, last

    def _update(self, grads: dict, rate: float) -> None:
        """Adam; the input table moves only in the rows that were seen."""
        self.steps += 1
        fix = (1 - 0.999**self.steps) ** 0.5 / (1 - 0.9**self.steps)
        for name, g in grads.items():
            if name not in self.moments:
                self.moments[name] = np.zeros_like(self.p[name]), np.zeros_like(self.p[name])
            rows, g = g if isinstance(g, tuple) else (None, g)
            g = np.clip(g, -0.05, 0.05)
            m, v = (x if rows is None else x.take(rows, axis=0) for x in self.moments[name])
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            step = np.sqrt(v)
            step += 1e-7
            np.divide(m, step, out=step)
            step *= rate * fix
            if rows is None:
                self.p[name] -= step
            else:
                self.p[name][rows] -= step
                for x, new in zip(self.moments[name], (m, v)):
                    x[rows] = new

    def train(self, docs: list[np.ndarray], rate: float, lanes: int = LANES) -> None:
        """One pass with truncated backpropagation: the state runs through all windows of all documents, and every
        window of every lane is learned from, down to the last lane at work."""
        h = None
        for source, target, fresh, number in Lanes(docs, lanes).windows(LANES * WINDOW):
            h = self._start(source.shape[1]) if h is None else h[: source.shape[1]]
            grads, h = self._learn(source, target, fresh, number >= 0, h)
            self._update(grads, rate)


def _symbols(lexicon: Lexicon, numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers >= 0, lexicon.symbol[np.maximum(numbers, 0)], HEAD - 1 - numbers)


def _encode(docs: DataFrame, lexicon) -> DataFrame:
    """A row per document of ``docs`` (row, doc_id, round, text) with its symbols, 16 bits each, and what the counts of
    frequent words give, and a row per document and other word.  Words are looked up here and nowhere else."""
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("round", pa.int32()), ("word", pa.binary()), ("tail", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("within", pa.float64()), ("symbols", pa.binary())])
    schema = "row long, doc_id long, round int, word binary, tail int, n_tokens long, n_known long, base double, within double, symbols binary"

    def table(n, **columns):
        return pa.RecordBatch.from_arrays([x if isinstance(x := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for f in arrow], schema=arrow)

    def out(batch, first, numbers, rare, lex):
        ids = batch.slice(first, len(numbers))
        kept = [n[n >= 0] for n in numbers]
        known, base, within = ([x[n].sum() for n in kept] for x in (lex.counts > 0, lex.base, lex.within))
        yield table(len(numbers), row=ids["row"], doc_id=ids["doc_id"], round=ids["round"], n_tokens=[len(n) for n in numbers], n_known=known, base=base, within=within, symbols=[_symbols(lex, n).astype("<i2").tobytes() for n in numbers])
        rows = [(r, w, n) for r, own in zip(ids["row"].to_pylist(), rare) for w, n in Counter(own).items()]
        if rows:
            row, word, n = zip(*rows)
            yield table(len(rows), row=row, word=word, tail=list(map(tail_bucket, word)), n_tokens=n)

    def run(batches):
        lex = lexicon.value
        for batch in batches:
            first, numbers, rare, size = 0, [], [], 0
            for text in _texts(batch):
                found, other = lex.look_up(text)
                numbers.append(found)
                rare.append(other)
                size += len(found)
                if size >= CHUNK_TOKENS // 8 or len(numbers) >= 512:
                    yield from out(batch, first, numbers, rare, lex)
                    first, numbers, rare, size = first + len(numbers), [], [], 0
            if numbers:
                yield from out(batch, first, numbers, rare, lex)

    return docs.select("row", "doc_id", "round", "text").mapInArrow(tidy(run), schema)


def _encoded(batch: pa.RecordBatch):
    """The symbols of each document."""
    for k in range(0, batch.num_rows, 1024):
        for own in batch["symbols"].slice(k, 1024).to_pylist():
            yield np.frombuffer(own, "<i2")


def _train_round(docs: DataFrame, weights, rate: float, least_steps: int) -> dict[str, np.ndarray]:
    """Every task trains a copy on its documents; the copies' mean, weighted by tokens, is summed up in a tree."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        keep_freed()
        model, n, held, size = GruModel({k: v.copy() for k, v in shared.value.items()}), 0, [], 0
        for batch in batches:
            for own in _encoded(batch):
                held.append(own)
                size += len(own)
                if size >= CHUNK_TOKENS:
                    model.train(held, rate)
                    n, held, size = n + size, [], 0
        while held and (size or model.steps < least_steps):
            model.train(held, rate)
            n, size = n + size, 0
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "weights": [pickle.dumps({k: v.astype(np.float64) * n for k, v in model.p.items()})]})

    def add(a, b):
        return a[0] + b[0], {k: v + b[1][k] for k, v in a[1].items()}

    copies = docs.select("symbols").mapInArrow(tidy(run), "n long, weights binary").rdd.map(lambda r: (r["n"], pickle.loads(r["weights"])))
    n, total = copies.treeReduce(add, depth=3) if docs.limit(1).count() else (0, None)
    return {k: (v / n).astype(np.float32) for k, v in total.items()} if n else weights


def _score_rows(docs: DataFrame, weights) -> DataFrame:
    """The documents of _encode() with what frequent words and the network give."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        keep_freed()
        model = GruModel(shared.value)
        for batch in batches:
            first, held, size = 0, [], 0
            for k, own in enumerate(_encoded(batch), 1):
                held.append(own)
                size += len(own)
                if size >= CHUNK_TOKENS or k == batch.num_rows:
                    part = batch.slice(first, len(held))
                    score = part["within"].to_numpy() + model.score(held)
                    yield pa.RecordBatch.from_arrays([*(part[c] for c in arrow.names[:-1]), pa.array(score)], schema=arrow)
                    first, held, size = k, [], 0

    return docs.select("row", "doc_id", "n_tokens", "n_known", "base", "within", "symbols").mapInArrow(tidy(run), "row long, doc_id long, n_tokens long, n_known long, base double, score double")


def score_documents(docs: DataFrame, scratch: Scratch, rounds: int = 2, rate: float = 0.01, least_steps: int = 50, hot_words: int = HOT_WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end (a null text: the end alone).  Rows with
    crc32(doc_id as text) mod 5 = 1 are held out (a null doc_id counts as an empty string); all others are
    counted in full.  The HEAD most frequent tokens have output classes of CLASS_WORDS each; any other word
    belongs to a tail class by its last letters and to a bucket in it; within the bucket its probability is its
    smoothed count's share, a word never seen included.  So the model gives every text a probability, from the same
    counts as the base.

    Training is data-parallel: in each round every task trains on its documents, all with the same start, and
    the mean goes on; each training document is in one round, and all its tokens are learned from.  A task with few
    documents goes over them until it has made ``least_steps`` steps.  Seeds and the documents of a round don't depend
    on the layout, but which documents a task trains on does: other partitions give slightly other scores.  Memory is
    in proportion to CHUNK_TOKENS tokens or the longest text.  Only the ``hot_words`` words that stand most often in all
    texts, held-out ones included, are broadcast; rows of others meet the counts in a join, where no key is hot.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    counts = scratch.write(_counts(docs.withColumn("learn", fold != 1)).withColumn("level", F.floor(F.log2("m") * 16).cast("int")), "counts")
    seen = F.when(F.col("n") > 0, True)  # in a training text
    levels = sorted(((r["level"], r["words"], r["v"], r["n"]) for r in counts.groupBy("level").agg(F.count("*").alias("words"), F.count(seen).alias("v"), F.sum("n").alias("n")).collect()), reverse=True)
    total, distinct, have, cut = sum(x[3] for x in levels), sum(x[2] for x in levels), 0, 1 << 30
    for level, n_words, _, _ in levels:
        if have + n_words > hot_words:
            break
        have, cut = have + n_words, level
    hot = counts.where(F.col("level") >= cut)
    rows = sorted(((bytes(r["word"]), r["n"]) for r in hot.select("word", "n").collect()), key=lambda r: (r[0] != END, -r[1], r[0]))
    if not rows or rows[0][0] != END:
        rows.insert(0, (END, counts.where(F.col("word") == F.lit(END)).select("n").first()["n"] if levels else 0))
    words, numbers = [r[0] for r in rows], [r[1] for r in rows]
    head: dict[int, list[int]] = {}
    for w, n in rows[:HEAD]:
        own = head.setdefault(tail_bucket(w), [0, 0])
        own[0] += n > 0
        own[1] += n
    sums = {r["tail"]: (r["v"] - head.get(r["tail"], (0, 0))[0], r["n"] - head.get(r["tail"], (0, 0))[1]) for r in counts.groupBy("tail").agg(F.count(seen).alias("v"), F.sum("n").alias("n")).collect()}
    lexicon = Lexicon(words, numbers, total, distinct, sums)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    turn = F.when(fold != 1, F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int"))
    encoded = scratch.write(_encode(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("round", turn), shared), "encoded")
    weights = initial_weights(lexicon)
    for k in range(rounds):
        weights = _train_round(encoded.where(F.col("round") == k), weights, rate, least_steps)
    whole = _score_rows(encoded.where("word is null"), weights)
    norms = F.element_at(F.array(*[F.lit(float(x)) for x in lexicon.tail_norm]), F.col("tail") + 1)
    cold = counts.where(F.col("level") < cut).select("word", F.col("n").alias("c"))
    smoothed = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    other = encoded.where("word is not null").select("row", "word", "tail", F.col("n_tokens").alias("m")).join(cold, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more_known"), F.sum(F.col("m") * (smoothed - F.lit(float(lexicon.norm)))).alias("more_base"), F.sum(F.col("m") * (smoothed - norms)).alias("more_score"))
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.join(other, "row", "left").select("doc_id", (fold == 1).alias("held_out"), "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score"))


def op1_gru_lm(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, scored."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op1"))
