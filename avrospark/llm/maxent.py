"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Counts. Blocks of documents send each of their words once, with its training count, to hash buckets that sum
them; every block gets the corpus counts of its words back. Only sums, the number of distinct words and the
most frequent words reach the driver, some rows of a bucket each.

Model. Of V distinct words the 12 * V ** 0.55 most frequent ones (``least`` at least) are predicted from the history. They are
factored into nested classes: every class is parted into two of about equal mass, P(word | history) is the product of
P(part | class, history) down to the word, and one leaf at the top is the rest, rarer and unknown words, whose last factor is the
smoothed unigram share. Words are parted along the main direction of what stands one and two places before them (shares
of the ``CONTEXTS`` most frequent words), so that classes hold words of like use. Every softmax reads single weights of
one table by a hash of the class and a feature of the history: the last word, the last two, and the word before the last
(a skip), beside a bias that gives the unigram distribution. Features hash the words themselves, predicted or not.

Training is by distributed gradient updates: in each of ``rounds`` rounds, every task takes AdaGrad steps on
minibatches of its part of a disjoint share of all training documents, from the same weights; in a tree of
groups the changes of each weight are averaged, by tokens, over the tasks that changed it. All training documents are used
once, by at most two tasks a core, so that what is gathered grows with the cores and the model. The table has ``rows`` weights
for a million training tokens and grows with the cube root of their number, as a power of two.

Scoring is in numpy batches that read only the weights of their tokens' paths.

Defined results: null and empty texts have one token, the end; a null id counts as the text ''; without training
documents the counts are 0 and all words are unknown; repeated rows are scored and learnt each; the whole text counts;
words are told apart by a 64-bit hash that is not linear in their bytes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ENTRIES, ENTRY_ARROW, block_of, buckets_of, by_bucket, mix, ranges, raw_texts, rows_batch, slices, summed, words_of, written

END = np.uint64(1)
BEGIN = np.uint64(2)
#: Tokens of a training step, and of a scoring batch: their paths stay in the cache.
BATCH, SCORED = 1024, 2048
#: Nested classes stand in groups of 2 ** LINE weights, a line of the processor's cache, for each feature.
LINE = 4
#: Frequent words whose shares among the words before say how a word is used.
CONTEXTS = 32
#: Words of a class from which it is parted by use, not by frequency.
PARTED = 256
LN10 = float(np.log(10))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(raw, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts, each with its end behind it, and the number of tokens of each text."""
    words, begin = words_of(raw, at)
    return np.insert(words, begin[1:], END), np.diff(begin) + 1


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def behind(values: np.ndarray, lengths: np.ndarray, k: int, none) -> np.ndarray:
    """Of each token what stands ``k`` places before it in its text, or ``none``."""
    out = np.full(values.size, none, values.dtype)
    out[k:] = values[:-k]
    first = np.cumsum(lengths) - lengths
    for j in range(k):
        at = first[lengths > j] + j
        out[at] = none
    return out


def features(words: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    h1, h2 = (behind(words, lengths, k, BEGIN) for k in (1, 2))
    one = mix(h1)
    return [one, mix(one * np.uint64(3) + h2), mix(h2 + np.uint64(1 << 33))]


@dataclass
class Model:
    """Weights and what is known of the vocabulary."""

    keys: np.ndarray  # hashes of the predicted words, ascending
    opens: np.ndarray  # where each word's path begins; the last but one is the rest's
    nodes: np.ndarray  # classes on the paths: a group of nested classes, and the place in it
    right: np.ndarray  # whether the path takes the second part
    doors: np.ndarray  # as opens, for the groups that a path goes through
    groups: np.ndarray  # these groups
    stay: np.ndarray  # how many classes of a path are in each
    bias: np.ndarray  # of each class
    table: np.ndarray  # hashed weights, a power of two
    train_tokens: int
    distinct: int
    rest: float  # smoothed count of all words that are not predicted
    _salts: np.ndarray | None = None
    _near: tuple | None = None

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the predicted ones, or their number: their hashes are even, so a table of leading bits leads near it."""
        if self._near is None:
            bits = self.keys.size.bit_length() + 2
            self._near = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), np.uint64(64 - bits), np.append(self.keys, ~np.uint64(0))
        near, shift, keys = self._near
        at = near[words >> shift]
        while (low := keys[at] < words).any():
            at += low
        return np.where(keys[at] == words, np.minimum(at, self.keys.size), self.keys.size)

    def steps(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every step of every token's path: its class, whether the second part is taken; and each token's first step."""
        at, first = _spans(self.opens, ranks)
        return self.nodes[at], self.right[at], first

    def places(self, found: list[np.ndarray], ranks: np.ndarray, node: np.ndarray, size: int, apart: int = LINE):
        """For each feature, which weights of a table of ``size`` every step reads; lines begin every 2 ** ``apart``."""
        at, first = _spans(self.doors, ranks)
        token = np.repeat(np.arange(ranks.size), np.diff(first, append=at.size))
        shift, slot, stay = np.uint64(65 + LINE - size.bit_length()), node & (1 << LINE) - 1, self.stay[at]
        salt = self.salts[self.groups[at]]
        for f in found:
            line = ((f[token] ^ salt) * _ODD >> shift).view(np.int64) << apart
            yield np.repeat(line, stay) + slot

    @property
    def salts(self) -> np.ndarray:
        if self._salts is None:
            self._salts = mix(np.arange(1, self.bias.size // (1 << LINE) + 1, dtype=np.uint64))
        return self._salts

    def score(self, words: np.ndarray, counts: np.ndarray, lengths: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token, given the corpus counts of the words (and their ranks)."""
        out, ranks, found = np.empty(words.size), self.ranks(words) if ranks is None else ranks, features(words, lengths)
        for at in range(0, words.size, SCORED):
            some = slice(at, at + SCORED)
            node, right, opens = self.steps(ranks[some])
            z = self.bias[node]
            for p in self.places([f[some] for f in found], ranks[some], node, self.table.size):
                z += self.table[p]
            np.negative(z, out=z, where=right)
            lost = np.log1p(np.exp(np.minimum(z, np.float32(80))))
            out[some] = -np.add.reduceat(lost, opens, dtype=np.float64)
        rest = ranks == self.keys.size
        out[rest] += np.log((counts[rest] + 0.5) / self.rest)
        return out / LN10


def _spans(opens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the spans ``which``, one behind the other, and where each begins among them."""
    a = opens[which]
    size = opens[which + 1] - a
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(a - ends + size, size), ends - size


def parted(mass: np.ndarray, use: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Nested classes of two parts: (class, word, whether in the second part) of all steps, and each class's log odds.

    Four levels are a group, numbered as in a heap from 1; place 0 of the first group is left for the top."""
    if use is not None:
        use = np.sqrt(use / np.maximum(use.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    nodes, words, right = [], [], []
    odds = [0.0] * (1 << LINE)
    todo = [(np.argsort(-mass, kind="stable"), 1)]
    while todo:
        some, at = todo.pop()
        if some.size < 2:
            continue
        if use is not None and some.size >= PARTED:
            x, w = use[some], (mass[some] / mass[some].sum()).astype(np.float32)
            x = x - w @ x
            main = np.linalg.eigh((x * w[:, None]).T @ x)[1][:, -1]
            some = some[np.argsort(x @ (main * np.sign(main[np.abs(main).argmax()])), kind="stable")]
        so_far = np.cumsum(mass[some])
        cut = int(np.clip(np.searchsorted(so_far, so_far[-1] / 2), 0, some.size - 2)) + 1
        for part, second in ((some[:cut], False), (some[cut:], True)):
            nodes.append(np.full(part.size, at, np.int32))
            words.append(part)
            right.append(np.full(part.size, second))
            below = (at & (1 << LINE) - 1) * 2 + second
            if below < 1 << LINE:
                todo.append((part, at >> LINE << LINE | below))
            elif part.size > 1:  # the first of a new group
                todo.append((part, len(odds) + 1))
                odds += [0.0] * (1 << LINE)
        odds[at] = float(np.log((so_far[-1] - so_far[cut - 1]) / so_far[cut - 1]))
    if not nodes:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool), odds
    return np.concatenate(nodes), np.concatenate(words), np.concatenate(right), odds


def start(keys: np.ndarray, counts: np.ndarray, n: int, v: int, rows: int, use: np.ndarray | None = None) -> Model:
    """The model before training, whose biases give the unigram distribution. ``keys`` ascend; ``use`` has a row for each."""
    counts = counts.astype(np.float64)
    rest = n - counts.sum() + 0.5 * (v - keys.size + 1)
    node, word, right, odds = parted(counts, use)
    order = np.argsort(word, kind="stable")
    size = np.append(np.bincount(word, minlength=keys.size) + 1, 1)  # the top class is on every path
    opens = np.concatenate([[0], np.cumsum(size)])
    nodes, turn = np.zeros(opens[-1], np.int32), np.zeros(opens[-1], bool)
    below = np.ones(opens[-1], bool)
    below[opens[:-1]] = False
    nodes[below], turn[below] = node[order], right[order]
    turn[-1] = True  # the rest
    group = nodes >> LINE
    door = np.ones(group.size, bool)
    door[1:] = group[1:] != group[:-1]
    door[opens[:-1]] = True
    doors = np.append(np.cumsum(door) - door, door.sum())[opens]
    top = float(np.log(rest / counts.sum())) if keys.size else 60.0
    odds[0] = top
    bits = max(2 * LINE, round(float(np.log2(rows))))
    return Model(keys, opens, nodes, turn, doors, group[door], np.diff(np.flatnonzero(door), append=door.size), np.array(odds, np.float32), np.zeros(1 << bits, np.float32), n, v, rest)


class Trainer:
    """AdaGrad steps on one task's documents. Each line of weights has its sums of squares beside it."""

    def __init__(self, model: Model, rate: float):
        self.m, self.rate, self.n = model, np.float32(rate), 0
        self.lines = np.full((model.table.size >> LINE, 2, 1 << LINE), 0.1, np.float32)
        self.lines[:, 0] = model.table.reshape(-1, 1 << LINE)

    @property
    def table(self) -> np.ndarray:
        return self.lines[:, 0].ravel()

    def learn(self, words: np.ndarray, lengths: np.ndarray) -> None:
        m, ranks, found, both = self.m, self.m.ranks(words), features(words, lengths), self.lines.reshape(-1)
        for at in range(0, words.size, BATCH):
            some = slice(at, at + BATCH)
            node, right, _ = m.steps(ranks[some])
            z, places = m.bias[node], []
            for p in m.places([f[some] for f in found], ranks[some], node, m.table.size, LINE + 1):
                places.append(p)
                z += both[p]
            g = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - right.astype(np.float32)
            square, step = g * g, g * -self.rate
            for p in places:  # the weights of one feature stay in the cache
                beside = p + (1 << LINE)
                seen = both[beside]
                seen += square
                both[beside] = seen  # of equal places in a batch one counts
                np.add.at(both, p, step / np.sqrt(seen))
        self.n += words.size


CHUNKS = 16
GATHERED = pa.schema([("node", pa.int64()), ("chunk", pa.int32()), ("n", pa.int64()), ("values", pa.binary())])


def _gather(made: DataFrame, tasks: int, join) -> list[np.ndarray] | None:
    """One array from those of all tasks, CHUNKS rows each, by ``join(weights, arrays)`` in a tree of groups of 64 tasks."""
    kind = "node long, chunk int, n long, values binary"

    def one(table: pa.Table) -> pa.Table:
        n = np.array(table["n"].to_pylist(), np.float64)
        total = join(n, [np.frombuffer(x, np.float16) for x in table["values"].to_pylist()])
        row = {"node": table["node"][0].as_py() // 64, "chunk": table["chunk"][0].as_py(), "n": int(n.sum()), "values": total.astype(np.float16).tobytes()}
        return pa.Table.from_pylist([row], schema=GATHERED)

    while True:
        made = made.withColumn("up", F.floor(F.col("node") / 64)).groupBy("up", "chunk").applyInArrow(one, kind)
        tasks = -(-tasks // 64)
        if tasks <= 1:
            break
    got = sorted(made.collect(), key=lambda r: r["chunk"])  # CHUNKS rows, the size of the model
    return np.concatenate([np.frombuffer(r["values"], np.float16) for r in got]).astype(np.float32) if got else None


def _chunks(values: np.ndarray, n: int) -> pa.RecordBatch:
    rows = [{"node": TaskContext.get().partitionId(), "chunk": k, "n": n, "values": x.tobytes()} for k, x in enumerate(np.array_split(values.astype(np.float16), CHUNKS))]
    return pa.RecordBatch.from_pylist(rows, schema=GATHERED)


def _roots(_, some: list[np.ndarray]) -> np.ndarray:
    return np.sqrt(sum(np.square(x.astype(np.float32)) for x in some))


def _mean(n: np.ndarray, some: list[np.ndarray]) -> np.ndarray:
    """Changes of each weight, averaged over those that changed it."""
    total, weight = np.zeros(some[0].size, np.float32), np.zeros(some[0].size, np.float32)
    for w, x in zip(n / n.sum(), some, strict=True):
        x = x.astype(np.float32)
        total += np.float32(w) * x
        weight += np.float32(w) * (x != 0)
    return total / np.maximum(weight, np.float32(1e-30))


def _texts(batches):
    """(words, lengths) of some texts at a time; their column is the only one."""
    for b in batches:
        raw, at = raw_texts(b.column(0))
        for i, j in slices(at):
            yield tokens(raw[int(at[i]) : int(at[j])], at[i : j + 1] - at[i])


def _uses(docs: DataFrame, keys: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
    """Of each predicted word how often each context stands one and two places before it, over all training documents."""
    sent = docs.sparkSession.sparkContext.broadcast((keys, np.argsort(-counts, kind="stable")[:CONTEXTS]))

    def count(batches):
        known, top = sent.value
        context = np.full(known.size + 1, CONTEXTS)
        context[top] = np.arange(top.size)
        total, n = np.zeros(known.size * 2 * (CONTEXTS + 1), np.float32), 0
        for words, lengths in _texts(batches):
            at = np.minimum(np.searchsorted(known, words), known.size - 1)
            rank = np.where(known[at] == words, at, known.size)
            here = rank < known.size
            for k in (1, 2):
                seen = behind(context[rank], lengths, k, CONTEXTS)[here]
                np.add.at(total, (rank[here] * 2 + k - 1) * (CONTEXTS + 1) + seen, np.float32(1))
            n += words.size
        if n:
            yield _chunks(np.sqrt(total), n)

    found = _gather(docs.mapInArrow(count, "node long, chunk int, n long, values binary"), docs.rdd.getNumPartitions(), _roots)
    return None if found is None else np.square(found).reshape(keys.size, -1)


def _round(docs: DataFrame, model: Model, rate: float) -> Model:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def train(batches):
        m = sent.value
        t = Trainer(m, rate)
        for words, lengths in _texts(batches):
            t.learn(words, lengths)
        if t.n:
            yield _chunks(t.table - m.table, t.n)

    change = _gather(docs.mapInArrow(train, "node long, chunk int, n long, values binary"), docs.rdd.getNumPartitions(), _mean)
    if change is not None:
        model.table = model.table + change
    return model


COUNTS = "block long, keys binary, vals binary, n long, v long"
COUNTS_ARROW = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("vals", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def predicted(v: int, least: int) -> int:
    """Words of ``v`` that are predicted from the history."""
    return min(v, max(least, int(12 * v**0.55)))


def word_counts(df: DataFrame, buckets: int, held_mod: int, held_rest: int, least: int) -> DataFrame:
    """COUNTS: of every block its words' training counts in the corpus; and, with a null block, sums and frequent words of every bucket."""

    def send(batches):
        for b in batches:
            b = b.take(pa.array(np.argsort(b.column(0).to_numpy(), kind="stable")))
            ids = b.column(1).to_pylist()
            learnt = np.fromiter((crc(i) % held_mod != held_rest for i in ids), bool, len(ids))
            raw, at = raw_texts(b.column(2))
            out: list[dict] = []
            for block, x, y in ranges(b.column(0).to_numpy()):
                words, weight = [], []
                for i, j in slices(at[x : y + 1]):
                    w, lengths = tokens(raw[int(at[x + i]) : int(at[x + j])], at[x + i : x + j + 1] - at[x + i])
                    words.append(w)
                    weight.append(np.repeat(learnt[x + i : x + j], lengths))
                keys, where = np.unique(np.concatenate(words), return_inverse=True)
                out += by_bucket(block, keys, np.bincount(where, weights=np.concatenate(weight), minlength=keys.size), buckets)
            if out:
                yield rows_batch(out, ENTRY_ARROW)

    def answer(table: pa.Table) -> pa.Table:
        distinct, total, where, at = summed(table)
        seen = int((total > 0).sum())
        share = predicted(buckets * seen, least) / buckets
        top = np.argsort(-total, kind="stable")[: min(seen, least + int(share + 8 * share**0.5))]
        out = [{"block": None, "keys": distinct[top].tobytes(), "vals": total[top].tobytes(), "n": int(total.sum()), "v": seen}]
        for i, block in enumerate(table["block"].to_pylist()):
            mine = np.minimum(total[where[at[i] : at[i + 1]]], 0xFFFFFFFF).astype(np.uint32)
            out.append({"block": block, "keys": table["keys"][i].as_py(), "vals": mine.tobytes(), "n": None, "v": None})
        return pa.Table.from_pylist(out, schema=COUNTS_ARROW)

    return df.mapInArrow(send, ENTRIES).groupBy("bucket").applyInArrow(answer, COUNTS)


def fit(df: DataFrame, counts: DataFrame, *, held_mod: int, held_rest: int, least: int, rows: int, rounds: int, rate: float) -> Model:
    """The trained model; ``df`` has doc_id and text, ``counts`` is from ``word_counts``."""
    stats = counts.where("n is not null").select("keys", "vals", "n", "v").collect()  # one row a bucket
    n, v = sum(r["n"] for r in stats), sum(r["v"] for r in stats)
    keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in stats)])
    times = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["vals"], np.int64) for r in stats)])
    top = np.lexsort((keys, -times))[: predicted(v, least)]
    top = top[np.argsort(keys[top])]
    keys, times = keys[top], times[top]
    size = int(rows * (n / 1e6) ** (1 / 3))
    if not n:
        return start(keys, times, n, v, rows)
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    learnt = df.where(number % held_mod != held_rest)
    few: Column = F.floor(number / held_mod) % rounds
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    model = start(keys, times, n, v, max(16, size), _uses(learnt.select("text").coalesce(tasks), keys, times) if keys.size >= PARTED else None)
    for turn in range(rounds):
        model = _round(learnt.where(few == turn).select("text").coalesce(tasks), model, rate)
    return model


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_mod: int = 5,
    held_rest: int = 1,
    least: int = 1024,
    rows: int = 1 << 19,
    rounds: int = 3,
    rate: float = 0.1,
    fitted: list | None = None,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document; the model is appended to ``fitted``."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    df = df.select(block_of(F.col("doc_id"), F.col("text")).alias("block"), "doc_id", "text")
    counts = written(word_counts(df, buckets_of(docs), held_mod, held_rest, least), "maxent-counts")
    model = fit(df, counts, held_mod=held_mod, held_rest=held_rest, least=least, rows=rows, rounds=rounds, rate=rate)
    if fitted is not None:
        fitted.append(model)
    n, v = model.train_tokens, model.distinct
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        m = sent.value  # loaded once a worker
        keys = np.frombuffer(b"".join(right["keys"].to_pylist()), np.uint64)
        vals = np.frombuffer(b"".join(right["vals"].to_pylist()), np.uint32)
        keys, first = np.unique(keys, return_index=True)  # a block's word has one count, however often it was asked
        vals = vals[first].astype(np.float64)
        ids = left["doc_id"].to_pylist()
        raw, at = raw_texts(left["text"])
        sizes, known, base, told = [], [], [], []
        for i, j in slices(at):
            words, lengths = tokens(raw[int(at[i]) : int(at[j])], at[i : j + 1] - at[i])
            distinct, where = np.unique(words, return_inverse=True)
            c = vals[np.searchsorted(keys, distinct)][where]
            opens = np.cumsum(lengths) - lengths
            sizes.append(lengths)
            known.append(np.add.reduceat((c > 0).astype(np.int64), opens))
            base.append(np.add.reduceat(np.log10((c + 0.5) / (n + 0.5 * (v + 1))), opens))
            told.append(np.add.reduceat(m.score(words, c, lengths, m.ranks(distinct)[where]), opens))
        whole = lambda some, kind: pa.array(np.concatenate([np.empty(0, kind), *some]))
        held = [crc(i) % held_mod == held_rest for i in ids]
        cols = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), whole(sizes, np.int64), whole(known, np.int64), pa.array(np.full(len(ids), n)), whole(base, np.float64), whole(told, np.float64)]
        return pa.table(cols, schema=SCORES)

    answers = counts.where("n is null").select("block", "keys", "vals")
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return df.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, kind)
