"""Language-model scores by a gated recurrent network with a class-factored softmax, in numpy.

Tokens: words between ASCII white space, A-Z in lower case, then one end of text. All counts cover every training text.
The network predicts the most frequent words by themselves, and all others by their kind, one of TAIL that their first two
bytes tell: OUTPUTS ids, in classes of SIDE by frequency. The words of a kind share its probability by their smoothed counts:
P(w) = P(kind) (c + 1) / R, where R also holds one unseen word of that kind. So the model is a distribution over words,
and its output biases begin at that of the counts.

Training is truncated backpropagation through windows of SPAN tokens, the state carried from window to window, on every
training text once, at every size: a hash of the row deals it to one of ROUNDS rounds and there to a shard. In a round
every shard trains from the same weights and the results are averaged.

Scoring carries each text's state over all its windows. Words beyond the frequent ones (the DICTIONARY most frequent go
to the workers with their counts, at most; a bound, not a cap) are joined with the full counts as rows.

Defined results: a null text is empty and has one token, the end; repeated rows and ids, and null ids, get a row each (where
it is null whether a row is for training, it is neither learned from nor held out);
without training texts N is 0 and every token has the probability of the one unseen word.
"""

from __future__ import annotations

import heapq
import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.llm.common import cut, ship, slices

HIDDEN, SIDE = 16, 56
OUTPUTS = SIDE * SIDE
#: Ids of the end of a text and, from RARE on, of the TAIL kinds of rare words; frequent words have those from FIRST on, by
#: frequency.
END, RARE, TAIL = 0, 1, 255
FIRST = RARE + TAIL
DICTIONARY = 131_072
#: Texts are trained on, in pieces of at most PIECE tokens, in at most LANES lanes at once, fewer where a lane would get
#: under LANE tokens.
SPAN, LANES, LANE, PIECE, LEARNING_RATE, CLIP = 16, 1024, 1024, 1024, 0.03, 1.0
#: A shard has about SHARD tokens, more where there would be over MOST_SHARDS of them in a round (0.3 MB of weights each).
ROUNDS, SHARD, MOST_SHARDS, MERGED = 3, 1_500_000, 4096, 8
#: Tokens whose softmax is computed at once; size of logits from which their largest is taken off first (exponentials of more
#: could overflow); the bias of ids without a word.
COLUMNS, SAFE, NEVER = 2048, 60.0, -1e4
#: Tokens and lanes that are scored at once, and the window for that.
SCORE_TOKENS, SCORE_LANES, SCORE_SPAN = 4_000_000, 512, 64
#: Distinct tokens that a task counts before it passes them on.
COUNTED = 400_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Network:
    """Weights by name; all float32. States, gates and logits have a column per token, so that numpy works along rows. The last
    column of every matrix is a bias: states and embeddings end with a 1. The gates z and r are held with their sign turned."""

    NAMES = ("emb", "inp", "rec", "cls", "out")

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def started(cls, counts: np.ndarray) -> Network:
        """Small random weights; biases that give the smoothed counts' distribution (0 for ids without a word)."""
        rng = np.random.default_rng(7)
        by_class = counts.reshape(SIDE, SIDE).astype(np.float64)
        total = by_class.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cls_b = np.where(total > 0, np.log(total / total.sum()), NEVER)
            out_b = np.where(by_class > 0, np.log(by_class / total[:, None]), NEVER)

        def small(scale: float, bias: np.ndarray | float, *shape: int) -> np.ndarray:
            out = rng.normal(0, scale, (*shape, HIDDEN + 1)).astype(np.float32)
            out[..., -1] = bias
            return out

        return cls(
            {
                "emb": small(0.1, 1, OUTPUTS),
                "inp": small(1 / math.sqrt(HIDDEN), 0, 3 * HIDDEN),
                "rec": rng.normal(0, 0.1, (3 * HIDDEN, HIDDEN)).astype(np.float32),
                "cls": small(0.01, cls_b, SIDE),
                "out": small(0.01, out_b, SIDE, SIDE),
            }
        )

    def step(self, h: np.ndarray, gates: np.ndarray) -> tuple:
        """The next state h' = (1 - z) n + z h; `gates` (the input's part of them) is overwritten by z, r and n."""
        b = self.w["rec"] @ h
        zr, n = gates[: 2 * HIDDEN], gates[2 * HIDDEN :]
        zr += b[: 2 * HIDDEN]
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        bn = b[2 * HIDDEN :]
        n += zr[HIDDEN:] * bn
        np.tanh(n, out=n)
        after = h - n
        after *= zr[:HIDDEN]
        after += n
        return after, bn

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embeddings of the ids x (a row each), and the input's part of the gates (a column each)."""
        e = self.w["emb"].take(x.ravel(), axis=0)
        return e, (self.w["inp"] @ e.T).reshape(3 * HIDDEN, *x.shape)

    def outputs(self, h: np.ndarray, y: np.ndarray, learn: bool = False) -> tuple:
        """Natural log probabilities of the ids y after the states h (ending with a row of 1); for learning the gradients."""
        group = (y // SIDE).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        group, place = group[order], (y % SIDE)[order]
        ends = np.searchsorted(group, np.arange(SIDE + 1))
        sorted_h, columns = h.take(order, axis=1), np.arange(len(y))
        logs, sorted_d = np.zeros(len(y), h.dtype), np.empty_like(sorted_h) if learn else None
        grads = {k: np.zeros_like(self.w[k]) for k in ("cls", "out")} if learn else None

        def softmax(weights: np.ndarray, own: slice, right: np.ndarray) -> np.ndarray | None:
            """Adds the log probabilities of the `right` rows to logs; to learn gives the probabilities less 1 there."""
            least = weights[:, -1].max()
            shifted = weights.copy()
            shifted[:, -1] -= least  # so that no logit is over the sum of the weights' sizes
            part = sorted_h[:, own]
            e = shifted @ part
            if np.abs(shifted[:, :-1]).sum(axis=1).max() > SAFE:
                e -= e.max(axis=0)
            at = right, columns[: len(right)]
            if not learn:
                logs[own] += e[at]
            np.exp(e, out=e)
            s = e.sum(axis=0)
            if not learn:
                logs[own] -= np.log(s)
                return None
            np.reciprocal(s, out=s)
            e *= s
            e[at] -= 1
            return e

        for at in range(0, len(y), COLUMNS):  # as many as stay in a processor's cache
            own = slice(at, min(at + COLUMNS, len(y)))
            d = softmax(self.w["cls"], own, group[own])
            if learn:
                grads["cls"] += d @ sorted_h[:, own].T
                np.matmul(self.w["cls"].T, d, out=sorted_d[:, own])
        for g in np.flatnonzero(ends[1:] > ends[:-1]):
            own = slice(ends[g], ends[g + 1])
            d = softmax(self.w["out"][g], own, place[own])
            if learn:
                grads["out"][g] = d @ sorted_h[:, own].T
                sorted_d[:, own] += self.w["out"][g].T @ d
        out = np.empty_like(sorted_d if learn else logs)
        out[..., order] = sorted_d if learn else logs
        return (None, grads, out[:-1]) if learn else (out, None, None)

    def learn(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, real: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients over a window (time by lane) from the carried state h, and the state after it. A lane that ends in the
        window isn't looked at again, so what follows its end needs no care but that it gives no gradient."""
        steps, lanes = x.shape
        e, gates = self.gates(x)
        on = (~fresh).astype(h.dtype)
        before, bn = (np.empty((HIDDEN, steps, lanes), h.dtype) for _ in range(2))
        states = np.ones((HIDDEN + 1, steps, lanes), h.dtype)
        for t in range(steps):
            np.multiply(h, on[t], out=before[:, t])
            h, bn[:, t] = self.step(before[:, t], gates[:, t])
            states[:-1, t] = h
        z, r, n = gates[:HIDDEN], gates[HIDDEN : 2 * HIDDEN], gates[2 * HIDDEN :]
        flat = lambda a: a.reshape(len(a), -1)
        if real.all():
            _, grads, d_states = self.outputs(flat(states), y.ravel(), learn=True)
        else:
            at = np.flatnonzero(real.ravel())
            _, grads, part = self.outputs(flat(states)[:, at], y.ravel()[at], learn=True)
            d_states = np.zeros((HIDDEN, steps * lanes), part.dtype)
            d_states[:, at] = part
        d_states = d_states.reshape(HIDDEN, steps, lanes)
        # what a state's gradient is multiplied by for those of the gates, for all steps at once
        by = np.empty((3, HIDDEN, steps, lanes), h.dtype)
        one_z = 1 - z
        by_n = n * n
        np.subtract(1, by_n, out=by_n)
        by_n *= one_z
        np.subtract(n, before, out=by[0])
        by[0] *= z
        by[0] *= one_z
        np.multiply(by_n, r, out=by[2])
        np.multiply(by[2], bn, out=by[1])
        by[1] *= r - 1
        db, rec = by, self.w["rec"].T.copy()
        dh = np.zeros((HIDDEN, lanes), d_states.dtype)
        for t in range(steps - 1, -1, -1):
            dh = np.add(dh, d_states[:, t], out=d_states[:, t])
            db[:, :, t] *= dh
            dh = (dh * z[:, t] + rec @ db[:, :, t].reshape(3 * HIDDEN, lanes)) * on[t]
        grads["rec"] = flat(db.reshape(3 * HIDDEN, steps, lanes)) @ flat(before).T
        np.multiply(d_states, by_n, out=db[2])
        da = db.reshape(3 * HIDDEN, -1)
        grads["inp"] = da @ e
        d_emb, ids = self.w["inp"][:, :-1].T @ da, x.ravel()
        grads["emb"] = np.zeros_like(self.w["emb"])
        for k, row in enumerate(d_emb):
            grads["emb"][:, k] = np.bincount(ids, row, OUTPUTS)
        return {k: v / max(1, int(real.sum())) for k, v in grads.items()}, h


def lanes_of(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, ...]:
    """Texts dealt to lanes, the longest first and each to the shortest lane: per token its text, id and whether it is the
    first of its text, lane by lane; then each lane's begin and length, longest lane first."""
    lanes = max(1, min(lanes, len(docs)))
    held: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, k = heap[0]
        held[k].append(i)
        heapq.heapreplace(heap, (size + len(docs[i]), k))
    order = sorted(range(lanes), key=lambda k: -sum(len(docs[i]) for i in held[k]))
    flat = [i for k in order for i in held[k]]
    sizes = np.array([len(docs[i]) for i in flat])
    owner = np.repeat(np.array(flat, np.int32), sizes)
    y = np.concatenate([docs[i] for i in flat])
    fresh = np.zeros(len(y), bool)
    fresh[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[fresh] = END
    length = np.array([sum(len(docs[i]) for i in held[k]) for k in order])
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    return owner, x, y, fresh, begin, length


def train(net: Network, docs: list[np.ndarray]) -> Network:
    """Adam over the texts, one pass; a new network. Texts of over PIECE tokens are dealt to lanes in pieces."""
    net = Network({k: v.copy() for k, v in net.w.items()})
    if not docs:
        return net
    parts = [x[at : at + PIECE] for x in docs for at in range(0, len(x), PIECE)]
    _, x, y, fresh, begin, length = lanes_of(parts, min(LANES, sum(map(len, parts)) // LANE))
    # all weights as one vector, which the network's arrays are views of
    flat = np.concatenate([v.ravel() for v in net.w.values()])
    cuts = np.cumsum([v.size for v in net.w.values()])[:-1]
    net.w = {k: x.reshape(v.shape) for (k, v), x in zip(net.w.items(), np.split(flat, cuts), strict=True)}
    first, second, room = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    h = np.zeros((HIDDEN, len(begin)), np.float32)
    for step, t in enumerate(range(0, int(length[0]), SPAN), 1):
        active = int(np.searchsorted(-length, -t, side="left"))
        places = begin[None, :active] + np.arange(t, t + SPAN)[:, None]
        real = np.arange(t, t + SPAN)[:, None] < length[None, :active]
        places = np.where(real, places, 0)
        grads, h = net.learn(x[places], y[places], fresh[places] & real, real, h[:, :active])
        # where most lanes have ended, the few texts left move the weights little
        rate = np.float32(LEARNING_RATE * real.sum() / (SPAN * len(begin)) / (1 - 0.9**step))
        g = np.concatenate([grads[k].ravel() for k in net.w])
        g *= min(1.0, CLIP / max(math.sqrt(float(g @ g)), 1e-12))
        first *= 0.9
        first += np.multiply(g, 0.1, out=room)
        second *= 0.99
        second += np.multiply(np.multiply(g, g, out=g), 0.01, out=g)
        np.sqrt(np.multiply(second, 1 / (1 - 0.99**step), out=room), out=room)
        room += 1e-8
        np.divide(first, room, out=room)
        flat -= np.multiply(room, rate, out=room)
    return net


def score(net: Network, docs: list[np.ndarray]) -> np.ndarray:
    """The log10 probability of each text's ids; the state is carried over all windows of a text."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    owner, x, y, fresh, begin, length = lanes_of(docs, min(SCORE_LANES, sum(map(len, docs)) // SCORE_SPAN))
    h = np.zeros((HIDDEN, len(begin)), np.float32)
    for t0 in range(0, int(length[0]), SCORE_SPAN):
        held, places = [], []
        for t in range(t0, min(t0 + SCORE_SPAN, int(length[0]))):
            active = int(np.searchsorted(-length, -t, side="left"))
            places.append(begin[:active] + t)
        where = np.concatenate(places)
        _, gates = net.gates(x[where])
        on, at = (~fresh[where]).astype(np.float32), 0
        for p in places:
            own = slice(at, at + len(p))
            h, _ = net.step(h[:, : len(p)] * on[own], gates[:, own])
            held.append(h)
            at = own.stop
        held = np.concatenate(held, axis=1)
        logp, _, _ = net.outputs(np.vstack([held, np.ones((1, held.shape[1]), held.dtype)]), y[where])
        out += np.bincount(owner[where], logp.astype(np.float64), len(docs))
    return out / math.log(10)


def kind(word: bytes) -> int:
    """The id of the kind of a rare word: by its first two bytes."""
    return RARE + zlib.crc32(word[:2]) % TAIL


class Vocabulary:
    """What the workers need of the counts: the frequent words' ids and counts, the totals, and per kind of rare words the
    smoothed count of all of them and one unseen word."""

    def __init__(self, frequent: list[tuple[str, int]], by_kind: dict[int, int], end: int, total: int, distinct: int) -> None:
        """`by_kind` has, for each kind, the sum of n + 1 over all words, frequent ones too."""
        ranked = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.end, self.total, self.distinct = end, total, distinct
        self.log_all = math.log10(total + distinct + 1)
        known = ranked[: OUTPUTS - FIRST]
        self.weights = np.zeros(OUTPUTS)
        self.weights[RARE:FIRST] = [by_kind.get(k, 0) + 1 for k in range(RARE, FIRST)]
        for word, n in known:
            self.weights[kind(word.encode())] -= n + 1
        self.weights[FIRST : FIRST + len(known)] = [n + 1 for _, n in known]
        self.weights[END] = end + (end > 0 or total > 0)
        #: By dictionary id (the end, then the frequent words by rank): counts, and the network's ids.
        self.counts = np.array([end, *(n for _, n in ranked)], np.int64)
        self.outputs = np.array([END, *range(FIRST, FIRST + len(known)), *(kind(w.encode()) for w, _ in ranked[len(known) :])], np.int64)
        self.ids = {w.encode(): 1 + k for k, (w, _) in enumerate(ranked)}


def count(docs: DataFrame) -> DataFrame:
    """token and n over all texts; tasks combine their own counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in held], pa.string()), pa.array(held.values(), pa.int64())], ["token", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                held.update(tokens(text.as_py()))
                if len(held) > COUNTED:
                    yield flush()
        if held:
            yield flush()

    ship(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    """The totals and the frequent words: those of at least the lowest power of two that leaves DICTIONARY at most."""
    powers = [F.count(F.when(F.col("n") >= (1 << k), 1)).alias(f"p{k}") for k in range(50)]
    seen = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), *powers).first()
    least = next(1 << k for k in range(50) if seen[f"p{k}"] <= DICTIONARY)
    frequent = [(x["token"], x["n"]) for x in counts.where(F.col("n") >= least).collect()]  # at most DICTIONARY rows
    of_kind = F.pmod(F.crc32(F.substring(F.encode("token", "UTF-8"), 1, 2)), F.lit(TAIL)) + RARE
    by_kind = counts.groupBy(of_kind.alias("kind")).agg(F.sum(F.col("n") + 1).alias("n")).collect()  # at most TAIL rows
    return Vocabulary(frequent, {x["kind"]: x["n"] for x in by_kind}, n_texts, (seen["n"] or 0) + n_texts, seen["v"] + (n_texts > 0))


def coded(text: str | None, words: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Dictionary ids of the text's tokens (-1 outside it), the end last; the network's ids; the words outside."""
    found = tokens(text)
    ids = np.zeros(len(found) + 1, np.int64)
    ids[:-1] = np.fromiter(map(words.ids.get, found, repeat(-1)), np.int64, len(found))
    outside = np.flatnonzero(ids < 0)
    out = [found[i] for i in outside.tolist()]
    nets = words.outputs[ids]
    nets[outside] = [kind(x) for x in out]
    return ids, nets, out


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare_score double, nets binary, others string"


def code(docs: DataFrame, training: Column, words: Vocabulary) -> DataFrame:
    """A row per row of `docs`: the network's ids as 16-bit integers, the words outside the dictionary, and what the words
    inside it give for n_known, base_score and rare_score (the log probabilities of rare words within their kinds)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        logs, known = np.log10(words.counts + 1.0), words.counts > 0
        mass = np.log10(words.weights[:FIRST].clip(1))
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text"):
                    ids, nets, out = coded(text.as_py(), words)
                    inside, rare = ids[ids >= 0], (nets >= RARE) & (nets < FIRST)
                    shared_out = logs[ids[rare & (ids >= 0)]].sum() - mass[nets[rare]].sum()
                    base = logs[inside].sum() - len(ids) * words.log_all
                    rows.append((len(ids), int(known[inside].sum()), base, shared_out, nets.astype("<u2").tobytes(), b" ".join(out).decode("utf-8", "replace") if out else None))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.string())
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *columns], [x.split(" ")[0] for x in CODED.split(", ")])

    return docs.select("doc_id", (~training).alias("held_out"), "text").mapInArrow(run, CODED)


def unpacked(nets: pa.Scalar) -> np.ndarray:
    return np.frombuffer(nets.as_buffer(), "<u2")


def fit(rows: DataFrame, words: Vocabulary) -> Network:
    """A network trained on every text (column nets of `rows`) once, round by round; column rid deals them."""
    spark = rows.sparkSession
    net = Network.started(words.weights)
    if words.total == 0:
        return net
    ship(spark)
    shards = max(1, min(MOST_SHARDS, words.total // ROUNDS // SHARD))
    # hashes of the row, so that copies of a text spread
    rows = rows.select("nets", F.xxhash64("rid").alias("h"))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast(net.w)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            net, seen, held, size = Network(shared.value), 0, [], 0
            for batch in batches:
                for nets in batch.column("nets"):
                    held.append(unpacked(nets))
                    size += len(held[-1])
                    if size > SCORE_TOKENS:
                        net, seen, held, size = train(net, held), seen + size, [], 0
            net, seen = train(net, held), seen + size
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([pickle.dumps(net.w)], pa.binary())], ["n", "w"])

        part = rows.where(F.pmod("h", F.lit(ROUNDS)) == k).repartition(shards, F.xxhash64("h", F.lit(k))).select("nets")
        # shards' weights are averaged by a few tasks, so that the driver gets MERGED rows however many shards there are
        found = part.mapInArrow(run, "n long, w binary").repartition(MERGED).mapInArrow(averaged, "n long, w binary").collect()
        if total := sum(x["n"] for x in found):
            each = [(x["n"] / total, pickle.loads(x["w"])) for x in found]
            net = Network({name: sum(f * w[name] for f, w in each).astype(np.float32) for name in Network.NAMES})
    return net


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of the weights in a partition, one row at a time."""
    total, mean = 0, None
    for batch in batches:
        for n, packed in zip(batch.column("n"), batch.column("w"), strict=True):
            weights, total = pickle.loads(packed.as_py()), total + n.as_py()
            part = n.as_py() / total
            mean = weights if mean is None else {k: mean[k] + part * (weights[k] - mean[k]) for k in mean}
    if mean is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([pickle.dumps(mean)], pa.binary())], ["n", "w"])


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row per row of `docs`; the rows where
    `training` holds are learned from."""
    spark = docs.sparkSession
    learned = docs.where(training)
    counts = cut(count(learned))
    words = vocabulary(counts, learned.count())
    rows = cut(code(docs, training, words)).withColumn("rid", F.monotonically_increasing_id())  # stable: read back from the checkpoint
    net = fit(rows.where("not held_out"), words)
    shared = spark.sparkContext.broadcast(net.w)
    passed = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, heads, docs, size = Network(shared.value), [], [], 0

        def closed() -> pa.RecordBatch:
            table = pa.Table.from_batches(heads).combine_chunks()
            return pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in table.columns), pa.array(score(net, docs))], [*passed, "model"])

        for batch in batches:
            begin = 0
            for k, nets in enumerate(batch.column("nets")):
                docs.append(unpacked(nets))
                size += len(docs[-1])
                if size > SCORE_TOKENS:
                    heads.append(batch.select(passed).slice(begin, k + 1 - begin))
                    yield closed()
                    heads, docs, size, begin = [], [], 0, k + 1
            if begin < batch.num_rows:
                heads.append(batch.select(passed).slice(begin))
        if docs:
            yield closed()

    scored = rows.select(*passed, "nets").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare_score double, model double")
    other = rows.where("others is not null").select("rid", F.explode(F.split("others", " ")).alias("other"))
    met = other.join(counts, F.col("other") == F.col("token"), "left").groupBy("rid").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"), F.count("n").alias("known"))
    whole = scored.join(met.withColumnRenamed("rid", "met_rid"), F.col("rid") == F.col("met_rid"), "left")
    more, zero = F.coalesce("more", F.lit(0.0)), F.lit(0).cast("long")
    return whole.select(
        "doc_id",
        F.coalesce("held_out", F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("model") + F.col("rare_score") + more).alias("score"),
    )
