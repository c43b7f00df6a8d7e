"""LM scoring: a gated recurrent model with a class-factored output, trained and run in numpy.

Words are known by their 64-bit hash (A-Z in lower case; two words share one with odds of 1 in 2**64). A pass over the
training documents counts all of them; the counts stay a table. The HEAD most frequent words are broadcast, a bounded
number, and cover most tokens; all other words of the corpus are joined with the count table by a shuffle, so that every
count is exact. Nothing is cut: the model scores whole documents.

The model reads the most frequent tokens as themselves and all others as one; their number grows with the square root of
the training tokens (classes_for). Its output is split into classes of equal size by frequency: the probability of a
token is that of its class times that within the class. A token outside the vocabulary gets the model's probability of ``other`` times its share of the smoothed counts outside.
So the probabilities over all words, the end, and one unseen word add up to 1.

Training is truncated backpropagation through time over windows, on all training documents whole, each once. A hash of
the id deals them to rounds that grow (ROUNDS). In a round every task trains a copy of the model on its own documents;
the copies are averaged, weighted by their tokens, up a tree of tasks, and the next round starts from the average. A
document may cross from one lane or chunk into the next; there the state starts anew, but no token is left out. The
averages depend on how the table is cut into tasks. Scoring lays documents on LANES lanes, longest first; the state of a lane is carried from
step to step and starts anew with a document, so a document's log-likelihood is that of its whole length.

NULL text counts as empty: one end token. Ids may be NULL or repeated. Without training documents all words are unseen
and the model is uniform. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import frugal, ship, stored
from tidemill.llm.shingles import word_hashes

HIDDEN, CLASSES, MEMBERS = 16, 48, 32
#: The vocabulary is the square root of the training tokens over this, and CLASSES * MEMBERS - 2 at least.
GROWTH = 4
#: Most words whose counts are broadcast (16 bytes each). A threshold on the count picks them, so no task sorts all words.
HEAD = 1 << 18
#: First bits of a hash that look up where to begin in the broadcast words.
PREFIX = 19
#: Upper ends of the rounds of training, in sixty-fourths of the documents.
ROUNDS = (2, 16, 64)
#: Copies of the model that a task of the averaging tree takes, and that the driver takes at last.
FAN_IN, LAST = 16, 8
LANES, WINDOW = 512, 32
#: Tokens that a task holds at a time, in scoring and in training.
CHUNK, TRAIN_CHUNK = 1_000_000, 500_000
ALPHA = 0.1
#: Stands for the end token in the count table.
END = 0


#: Logits within this need no shift before they are exponentiated in 32 bits.
SAFE = 60.0


def spread(x: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) in place and its sums by row; x is shifted by its greatest value first if ``bound`` on it isn't SAFE."""
    if bound > SAFE:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


def stable_order(x: np.ndarray, below: int) -> np.ndarray:
    """Stable order of numbers from 0 to ``below``; in 16 bits, where they fit, numpy sorts by radix, several times as fast."""
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


class Gru:
    """Parameters by name. Tokens are numbered by frequency; class = token // MEMBERS."""

    def __init__(self, vocabulary: int = CLASSES * MEMBERS, hidden: int = HIDDEN, seed: int = 5, members: int = MEMBERS) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        n, h, c = vocabulary, hidden, -(-vocabulary // members)
        self.n, self.h, self.c, self.m = n, h, c, members
        draw = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
        zeros = lambda *shape: np.zeros(shape, np.float32)
        self.p = {"x": draw(n, 3 * h), "u": draw(h, 3 * h, s=0.3), "wc": draw(h, c), "bc": zeros(c), "wo": draw(c, members, h), "bo": zeros(c, members)}
        pad = np.arange(c * members).reshape(c, members) >= n
        self.pad = np.where(pad, np.float32(-1e9), np.float32(0))

    def step(self, tokens: np.ndarray, h: np.ndarray) -> tuple:
        """One step from the tokens just read; also the gates, for backpropagation."""
        k = self.h
        g, hu = self.p["x"][tokens], h @ self.p["u"]
        zr = g[:, : 2 * k] + hu[:, : 2 * k]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :k], zr[:, k:]
        c = r * hu[:, 2 * k :]
        c += g[:, 2 * k :]
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c, hu[:, 2 * k :]

    def bounds(self) -> tuple[float, float]:
        """Bounds on the absolute logits of the classes and within the classes (a state lies in -1 to 1)."""
        top = float((np.abs(self.p["wc"]).sum(axis=0) + np.abs(self.p["bc"])).max())
        return top, float((np.abs(self.p["wo"]).sum(axis=2) + np.abs(self.p["bo"])).max())

    def inner(self, states: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Logits within the class of each state, for states by class that end at ``ends``; the states with a 1, for the bias; the classes with rows."""
        one = np.concatenate((states, np.ones((len(states), 1), states.dtype)), axis=1)
        weights = np.concatenate((self.p["wo"], (self.p["bo"] + self.pad)[:, :, None]), axis=2).astype(states.dtype, copy=False)
        out, parts, a = np.empty((len(states), self.m), states.dtype), [], 0
        for c, b in enumerate(ends.tolist()):
            if a < b:
                np.matmul(one[a:b], weights[c].T, out=out[a:b])
                parts.append((c, a, b))
                a = b
        return out, one, parts

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target after each state; one product for each class that occurs."""
        bound, within = self.bounds()
        order = stable_order(targets // self.m, self.c)
        s, y = states[order], targets[order]
        kind = y // self.m
        x, rows = s @ self.p["wc"], np.arange(len(y))
        x += self.p["bc"]
        if bound > SAFE:
            x -= x.max(axis=1, keepdims=True)
        picked = x[rows, kind]
        total = np.log(spread(x, 0.0)[1])
        q = self.inner(s, np.cumsum(np.bincount(kind, minlength=self.c)))[0]
        if within > SAFE:
            q -= q.max(axis=1, keepdims=True)
        picked += q[rows, y - kind * self.m]
        total += np.log(spread(q, 0.0)[1])
        out = np.empty(len(y), np.float64)
        out[order] = picked.astype(np.float64) - total
        return out

    def train(self, stream: np.ndarray, start: int, lanes: int = 64, window: int = 32, rate: float = 0.015, epochs: int = 1, state: dict | None = None) -> list[float]:
        """Truncated backpropagation over a stream of documents, each of which ends with token ``start``; losses by window.

        state: Adam's moments and steps, kept from call to call.
        """
        if not len(stream):
            return []
        span = -(-len(stream) // lanes)
        rows = np.append(stream, np.full(span * lanes - len(stream), -1)).reshape(lanes, span)
        state = {} if state is None else state
        flat = np.concatenate([v.reshape(-1) for v in self.p.values()])
        mean, square = state.setdefault("moments", (np.zeros_like(flat), np.zeros_like(flat)))
        grad, change, at = np.empty_like(flat), np.empty_like(flat), 0
        grads = {}
        for name, v in self.p.items():  # parameters and gradients as parts of one vector each
            self.p[name], grads[name] = flat[at : at + v.size].reshape(v.shape), grad[at : at + v.size].reshape(v.shape)
            at += v.size
        losses = []
        for _ in range(epochs):
            h, last = np.zeros((lanes, self.h), np.float32), np.append(start, rows[:-1, -1])
            for at in range(0, span, window):
                part = rows[:, at : at + window]
                inputs = np.concatenate((last[:, None], part[:, :-1]), axis=1)
                grad[:] = 0
                loss, _, h = self._window(np.where(inputs < 0, start, inputs), part, h, start, grads)
                last = part[:, -1]
                losses.append(loss)
                t_adam = state["steps"] = state.get("steps", 0) + 1
                mean *= 0.9
                np.multiply(grad, 0.1, out=change)
                mean += change
                square *= 0.99
                np.multiply(grad, grad, out=grad)
                grad *= 0.01
                square += grad
                np.sqrt(square, out=grad)
                grad *= 1 / np.sqrt(1 - 0.99**t_adam)
                grad += 1e-8
                np.multiply(mean, rate / (1 - 0.9**t_adam), out=change)
                change /= grad
                flat -= change
        return losses

    def _window(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, start: int, grads: dict[str, np.ndarray] | None = None) -> tuple:
        """Loss, gradients (in ``grads``, which is all 0 then) and the last state. Targets below 0, at the end of a lane, count for nothing."""
        lanes, steps = inputs.shape
        kind = self.p["u"].dtype
        grads = {name: np.zeros_like(v) for name, v in self.p.items()} if grads is None else grads
        k, tape, fresh = self.h, [], (inputs != start).astype(kind)
        states = np.empty((steps, lanes, k), kind)
        for t in range(steps):
            h0 = h * fresh[:, t, None]
            h, z, r, c, hu = self.step(inputs[:, t], h0)
            tape.append((h0, z, r, c, hu))
            states[t] = h
        flat, y = states.reshape(-1, k), targets.T.reshape(-1)
        order = stable_order(y + 1, self.n + 1)
        order = order[np.searchsorted(y[order], 0) :]
        s, y, n = flat[order], y[order], len(order)  # by class, without what lies beyond a lane's end
        group, rows = y // self.m, np.arange(n)
        bound, within = self.bounds()
        d = s @ self.p["wc"]
        d += self.p["bc"]
        if bound > SAFE:
            d -= d.max(axis=1, keepdims=True)
        loss = -d[rows, group].sum(dtype=np.float64)
        d, total = spread(d, 0.0)
        loss += np.log(total).sum(dtype=np.float64)
        d *= (1 / (total * n))[:, None]
        d[rows, group] -= 1 / n
        grads["wc"][:], grads["bc"][:] = s.T @ d, d.sum(axis=0)
        ds = d @ self.p["wc"].T
        e, one, parts = self.inner(s, np.searchsorted(y, np.arange(1, self.c + 1) * self.m))
        if within > SAFE:
            e -= e.max(axis=1, keepdims=True)
        member = y - group * self.m
        loss -= e[rows, member].sum(dtype=np.float64)
        e, total = spread(e, 0.0)
        loss += np.log(total).sum(dtype=np.float64)
        e *= (1 / (total * n))[:, None]
        e[rows, member] -= 1 / n
        for c, a, b in parts:
            both = e[a:b].T @ one[a:b]
            grads["wo"][c], grads["bo"][c] = both[:, :k], both[:, k]
            ds[a:b] += e[a:b] @ self.p["wo"][c]
        back = np.zeros((steps * lanes, k), kind)
        back[order] = ds
        back = back.reshape(steps, lanes, k)
        h0, z, r, c, hu = (np.stack(x) for x in zip(*tape, strict=True))
        to_c = z * (1 - c * c)
        factors = np.concatenate((z * (1 - z) * (c - h0), to_c * hu * r * (1 - r), to_c * r), axis=2).reshape(steps, lanes, 3, k)
        dh, ut = np.zeros((lanes, k), kind), np.ascontiguousarray(self.p["u"].T)
        every, at_hidden = np.empty((steps, lanes, k), kind), np.empty((steps, lanes, 3 * k), kind)
        for t in range(steps - 1, -1, -1):  # all gates' gradients are multiples of the state's
            dh += back[t]
            every[t] = dh
            np.multiply(factors[t], dh[:, None, :], out=at_hidden[t].reshape(lanes, 3, k))
            dh -= dh * z[t]
            dh += at_hidden[t] @ ut
            dh *= fresh[:, t, None]
        at_gates = at_hidden.copy()
        np.multiply(every, to_c, out=at_gates[:, :, 2 * k :])
        grads["u"][:] = h0.reshape(-1, k).T @ at_hidden.reshape(-1, 3 * k)
        token = inputs.T.reshape(-1)
        order = stable_order(token, self.n)
        token = token[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        grads["x"][token[first]] = np.add.reduceat(at_gates.reshape(-1, 3 * k)[order], first, axis=0)
        return float(loss / n), grads, h

    def score(self, docs: list[np.ndarray], start: int, lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
        """Natural log-likelihood of each document (tokens with the end at their end); state carried from step to step.

        Outputs are computed for lanes * window states at a time: late steps, with few lanes left, are gathered.
        """
        out, most = np.zeros(len(docs)), lanes * window
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lanes = max(1, min(lanes, len(docs)))
        heap, on = [(0, j) for j in range(lanes)], [[] for _ in range(lanes)]
        for i in order:
            size, j = heapq.heappop(heap)
            on[j].append(i)
            heapq.heappush(heap, (size + len(docs[i]), j))
        total = np.array([sum(len(docs[i]) for i in lane) for lane in on])
        rank = np.argsort(-total, kind="stable")
        on, total = [on[j] for j in rank], total[rank]
        flat = np.concatenate([docs[i] for lane in on for i in lane]) if len(docs) else np.zeros(0, np.int64)
        owner = np.concatenate([np.full(len(docs[i]), i) for lane in on for i in lane]) if len(docs) else flat
        begin = np.cumsum(total) - total
        h, last = np.zeros((lanes, self.h), np.float32), np.full(lanes, start)
        steps, states, targets, owners, size = int(total[0]) if len(total) else 0, [], [], [], 0
        left = len(total) - np.searchsorted(total[::-1], np.arange(steps), side="right")
        for t in range(steps):
            n = int(left[t])  # lanes that still have tokens
            h, last, where = h[:n], last[:n], begin[:n] + t
            h = self.step(last, h * (last != start)[:, None])[0]
            last = flat[where]
            states.append(h)
            targets.append(last)
            owners.append(owner[where])
            size += n
            if size >= most or t == steps - 1:
                got = self.log_probs(np.concatenate(states), np.concatenate(targets))
                out += np.bincount(np.concatenate(owners), got, minlength=len(docs))
                states, targets, owners, size = [], [], [], 0
        return out


@dataclass
class Head:
    """The most frequent words: sorted hashes with their counts and tokens. Totals of the training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    other: int
    end: int
    end_count: int
    total: int
    distinct: int
    outside: float  # smoothed mass of what the vocabulary leaves out, with one unseen word
    weight: np.ndarray  # training tokens by number, of the whole corpus
    members: int

    def __post_init__(self) -> None:
        """Where the hashes with each first PREFIX bits begin: they are evenly spread, so few follow there."""
        self.begins = np.searchsorted(self.hashes, np.arange(1 << PREFIX, dtype=np.uint64) << np.uint64(64 - PREFIX)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The first place in ``hashes``, the last one at most, whose hash isn't below h; as np.searchsorted, with fewer looks."""
        at = np.minimum(self.begins[(h >> np.uint64(64 - PREFIX)).astype(np.int32)], len(self.hashes) - 1)
        below = np.flatnonzero((self.hashes[at] < h) & (at < len(self.hashes) - 1))
        while len(below):
            at[below] += 1
            below = below[(self.hashes[at[below]] < h[below]) & (at[below] < len(self.hashes) - 1)]
        return at

    @property
    def base(self) -> float:
        return np.log10(self.total + ALPHA * (self.distinct + 1))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(hashes):
        word, n = np.unique(np.concatenate(hashes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    held, size, docs = [], 0, 0
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            h, _ = word_hashes(part.column(0).to_pylist())
            docs += part.num_rows
            held.append(np.where(h == END, np.uint64(1), h))
            size += len(h)
            if size >= 2 * CHUNK:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([docs], pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): all tokens of docs(text); word is the hash, END the end tokens."""
    ship(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(_count_task), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def classes_for(total: int) -> tuple[int, int]:
    """Classes and members of each, for a corpus of so many tokens."""
    scale = max(1.0, np.sqrt(min(np.sqrt(total) / GROWTH, HEAD) / (CLASSES * MEMBERS)))
    return int(np.ceil(CLASSES * scale)), int(np.ceil(MEMBERS * scale))


def head_of(counts: DataFrame) -> Head:
    """The broadcast part of the counts, of a bounded number of words, and the totals of all."""
    t = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"), F.sum(F.when(F.col("word") == END, F.col("n"))).alias("ends")).first()
    words = counts.filter(F.col("word") != END)
    step = F.floor(F.log2("n") * 64).cast("int")
    bins = sorted(((r["b"], r["low"], r["c"]) for r in words.groupBy(step.alias("b")).agg(F.min("n").alias("low"), F.count(F.lit(1)).alias("c")).collect()), reverse=True)
    cut, size = None, 0  # steps of counts, a bounded number, from the top while they fit
    for _, low, c in bins:
        size += c
        if size > HEAD:
            break
        cut = low
    top = words.filter(F.col("n") >= cut if cut is not None else F.lit(False)).toArrow()
    word, n = top.column("word").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((word, -n))
    word, n = word[order], n[order]
    total, ends = int(t["total"] or 0), int(t["ends"] or 0)
    classes, members = classes_for(total)
    inside = n[: classes * members - 2]
    others = total - ends - int(inside.sum())
    # numbered by frequency: words, the end, and all others together
    weight = np.concatenate((inside, [ends, others])).astype(np.int64)
    number = np.empty(len(weight), np.int64)
    number[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
    tokens = np.full(len(word), number[-1])
    tokens[: len(inside)] = number[: len(inside)]
    by_hash = np.argsort(word.view(np.uint64), kind="stable")
    types = int(t["distinct"] or 0) - len(inside) - (ends > 0)
    return Head(word.view(np.uint64)[by_hash], n[by_hash], tokens[by_hash], int(number[-1]), int(number[-2]), ends, total, int(t["distinct"] or 0), others + ALPHA * (types + 1), np.sort(weight)[::-1], members)


def _tokens(head: Head, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, place in the head, and whether it is there, for each word hash."""
    h = np.where(h == END, np.uint64(1), h)
    if not len(head.hashes):
        return np.full(len(h), head.other), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = head.find(h)
    known = head.hashes[at] == h
    return np.where(known, head.tokens[at], head.other), at, known


def _streams(head: Head, texts: list[str | None]) -> tuple[list[np.ndarray], tuple]:
    h, firsts = word_hashes(texts)
    tok, at, known = _tokens(head, h)
    return [np.append(tok[a:z], head.end) for a, z in zip(firsts[:-1], firsts[1:], strict=True)], (h, firsts, tok, at, known)


def _flat(model: Gru) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in model.p.values()])


def _unflat(model: Gru, flat: np.ndarray) -> None:
    at = 0
    for k, v in model.p.items():
        model.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size


def _copy_row(part: int, tokens: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["part", "tokens", "model"])


def _average_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((p, n, m) for b in batches for p, n, m in zip(*[c.to_pylist() for c in b.columns], strict=True)))
    if rows:
        yield _copy_row(rows[0][0], *_average(rows))


def _average(rows: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """Tokens of the copies of a model, and their mean weighted by tokens."""
    total = sum(n for _, n, _ in rows)
    return total, sum(np.frombuffer(m, np.float32) * (n / total) for _, n, m in rows)


def train(docs: DataFrame, head: Head) -> tuple[Gru, int]:
    """A model of all of docs(doc_id, text), and the number of tokens that it was trained on."""
    spark = docs.sparkSession
    ship(spark)
    model = Gru(max(len(head.weight), 2), members=head.members)
    if not head.total:
        return model, 0
    seen = np.ones(model.c * model.m)
    seen[: len(head.weight)] += head.weight
    seen = seen.reshape(model.c, model.m)
    model.p["bc"][:] = np.log(seen.sum(axis=1) / seen.sum())
    model.p["bo"][:] = np.log(seen / seen.sum(axis=1, keepdims=True))
    sent_head = spark.sparkContext.broadcast(head)
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS[-1])).alias("deal"), F.col("text").cast("string").alias("text"))
    trained = 0
    for low, high in zip((0, *ROUNDS), ROUNDS, strict=False):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            hd, copy = sent_head.value, Gru(2, members=2)
            copy.__dict__.update(sent.value.__dict__, p={k: v.copy() for k, v in sent.value.p.items()})
            held, size, total, state = [], 0, 0, {}
            for b in batches:
                for at in range(0, b.num_rows, 100):
                    streams, _ = _streams(hd, b.slice(at, 100).column(0).to_pylist())
                    held += streams
                    size += sum(map(len, streams))
                    if size >= TRAIN_CHUNK:
                        copy.train(np.concatenate(held), hd.end, lanes=_train_lanes(size), state=state)
                        held, size, total = [], 0, total + size
            if held:
                copy.train(np.concatenate(held), hd.end, lanes=_train_lanes(size), state=state)
                total += size
            if total:
                yield _copy_row(TaskContext.get().partitionId(), total, _flat(copy))

        copies = rows.filter((F.col("deal") >= low) & (F.col("deal") < high)).select("text").mapInArrow(frugal(run), "part long, tokens long, model binary")
        n = copies.rdd.getNumPartitions()
        while n > LAST:
            n = -(-n // FAN_IN)
            copies = copies.repartition(n).mapInArrow(frugal(_average_task), "part long, tokens long, model binary")
        got = sorted((r["part"], r["tokens"], bytes(r["model"])) for r in copies.collect())
        if got:
            tokens, flat = _average(got)
            trained += tokens
            _unflat(model, flat)
        sent.unpersist()
    return model, trained


def _train_lanes(size: int) -> int:
    """More lanes for longer streams: fewer and larger steps."""
    return min(256, max(64, size // 2048))


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double, words array<long>, times array<int>"


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    training = docs.filter(~held_out)
    counts = stored(word_counts(training), "word_counts")
    head = head_of(counts)
    sent = spark.sparkContext.broadcast((head, train(training, head)[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hd, model = sent.value
        row = TaskContext.get().partitionId() << 40
        log_count = np.log10(hd.counts + ALPHA)
        outside = np.log10(hd.outside)
        end_base = np.log10(hd.end_count + ALPHA) - hd.base

        def emit(ids, held, texts):
            nonlocal row
            streams, (h, firsts, tok, at, known) = _streams(hd, texts)
            n = np.diff(firsts)
            doc = np.repeat(np.arange(len(texts)), n)
            base = np.bincount(doc[known], log_count[at[known]] - hd.base, minlength=len(texts)) + end_base
            apart = known & (tok == hd.other)
            lm = model.score(streams, hd.end) / np.log(10)
            lm += np.bincount(doc[apart], log_count[at[apart]] - outside, minlength=len(texts))
            found = np.bincount(doc[known], minlength=len(texts)) + (hd.end_count > 0)
            rare_doc, rare = doc[~known], np.where(h == END, np.uint64(1), h)[~known].view(np.int64)
            order = np.lexsort((rare, rare_doc))
            rare_doc, rare = rare_doc[order], rare[order]
            first = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])))) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(rare))).astype(np.int32)
            cuts = np.concatenate(([0], np.cumsum(np.bincount(rare_doc[first], minlength=len(texts))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (rare[first], times)]
            rows = pa.array(np.arange(row, row + len(texts)))
            row += len(texts)
            return pa.RecordBatch.from_arrays([rows, pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(n + 1), pa.array(found), pa.array(base), pa.array(lm), *lists], names=[c.split()[0] for c in _SCORED.split(", ")])

        ids, held, texts, size = [], [], [], 0
        for b in batches:
            for i, (d, o, t) in enumerate(zip(*[c.to_pylist() for c in b.columns], strict=True)):
                ids.append(d)
                held.append(o)
                texts.append(t)
                size += len(t or "") // 6 + 1
                if size >= CHUNK:
                    yield emit(ids, held, texts)
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield emit(ids, held, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = stored(rows.mapInArrow(frugal(run), _SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    weighed = rare.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    log = F.log10(F.col("n") + ALPHA)
    per = weighed.groupBy("row").agg(F.sum(F.col("times") * log).alias("s"), F.sum("times").alias("t"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"))
    out = scored.drop("words", "times").join(per, "row", "left")
    s, t = F.coalesce("s", F.lit(0.0)), F.coalesce("t", F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(head.total).cast("long").alias("train_tokens"),
        (F.col("base") + s - t * float(head.base)).alias("base_score"), (F.col("lm") + s - t * float(np.log10(head.outside))).alias("score"),
    )
