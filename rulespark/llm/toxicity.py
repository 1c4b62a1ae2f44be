"""Toxicity: a bidirectional gated recurrent network with attention pooling, over characters and words, in numpy.

Each word comes in as its own embedding and the mean of its character n-grams' embeddings. Words and n-grams that too few
training texts have share a row or have none, so unseen words say what their n-grams and the shared row say. The network
reads windows of words in both directions, pools its states by attention, and gives a logit for a window. A text's score is
a calibrated function of its highest logit over all its windows; windows overlap by half, and cover the whole text.

It is trained on the driver on most_docs labelled texts of each label at most, whole texts, those whose ids have the least
hashes. A toxic text says that some window is toxic. So embeddings are first trained with a readout of single words, pooled
softly towards the highest of a text; then with the network, on the window that stands for each text: the one with the
highest word at first, then the one of the network's highest logit. One text in five is left for the calibration.

Defined results: a null, empty or wordless text is one empty window, and gets that window's score; rows are scored each for
itself, so repeated rows get equal scores; an empty table gives an empty result; rows with a null label are no training
rows; an id with several labels is toxic if one says so; an id with several texts stands for the least of them; without
training rows of both labels, every score is 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.llm.bpe import held, tidy
from rulespark.llm.common import WordRows, pieces

#: Words of a window and between starts of windows, units of a direction, numbers of an embedding, and of a word's input.
LENGTH, STRIDE, HIDDEN, WIDTH = 32, 16, 12, 6
INPUTS = 2 * WIDTH
#: Punctuation and symbols at the ends of a word are no part of it.
EDGES = b".,;:!?\"'()[]{}#*$%&|<>-_"


def core(word: bytes) -> bytes:
    return word.strip(EDGES).lower()


def features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, then its character n-grams, word after word; and how many features each word has."""
    cores = [core(w) for w in found]
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in cores), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(cores)), np.fromiter((len(w) + 2 for w in cores), np.int64, len(cores)))
    values, words = [np.fromiter(map(xxhash.xxh64_intdigest, cores), np.uint64, len(cores))], [np.arange(len(cores))]
    for n in (4, 5, 6):  # an n-gram is its bytes, and its length above them
        total = np.full(max(0, len(flat) - n + 1), n, np.uint64)
        for i in range(n):
            total = (total << np.uint64(8)) | flat[i : i + len(total)]
        whole = word[: len(total)] == word[n - 1 :] if len(total) else np.zeros(0, bool)
        values.append(total[whole])
        words.append(word[: len(total)][whole])
    words = np.concatenate(words)
    return np.concatenate(values)[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(cores))


@dataclass
class Embeddings:
    """Trained vectors of words (row 0: all others) and character n-grams, by their sorted hashes."""

    word_keys: np.ndarray
    words: np.ndarray
    gram_keys: np.ndarray
    grams: np.ndarray

    @staticmethod
    def new(flat: np.ndarray, sizes: np.ndarray, texts: list[np.ndarray], seed: int, words: int = 50_000, grams: int = 100_000, least: tuple[int, int] = (4, 8)) -> Embeddings:
        """Random vectors of the features of words; texts: distinct words of each. At most so many words and n-grams, the most
        frequent, of least texts each."""
        first = np.cumsum(sizes) - sizes
        keys, code = np.unique(flat, return_inverse=True)
        in_texts = np.zeros(len(keys), np.int64)
        for own in texts:
            places = np.repeat(first[own] - (np.cumsum(sizes[own]) - sizes[own]), sizes[own]) + np.arange(int(sizes[own].sum()))
            in_texts[np.unique(code[places])] += 1
        is_word = np.zeros(len(keys), bool)
        is_word[code[first]] = True
        rng, out = np.random.default_rng(seed), []
        for side, most, few in ((is_word, words, least[0]), (~is_word, grams, least[1])):
            some = np.flatnonzero(side & (in_texts >= few))
            some = np.sort(some[np.lexsort((keys[some], -in_texts[some]))][:most])
            out += [keys[some], rng.normal(0, 0.1, (len(some) + int(side is is_word), WIDTH)).astype(np.float32)]
        return Embeddings(*out)

    def rows(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's row; and for each n-gram that has one: the word, and its row."""
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        is_gram = np.ones(len(flat), bool)
        is_gram[first] = False

        def look_up(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.full(len(found), -1)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            return np.where(keys[at] == found, at, -1)

        gram = look_up(self.gram_keys, flat[is_gram])
        return look_up(self.word_keys, flat[first]) + 1, word[is_gram][gram >= 0], gram[gram >= 0]

    def inputs(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """The input vector of each word: of the word itself, and the mean of its n-grams'."""
        own, word, gram = rows
        out = np.zeros((len(own), INPUTS), np.float32)
        out[:, :WIDTH] = self.words[own]
        if len(word):
            at = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[at], WIDTH:] = np.add.reduceat(self.grams[gram], at) / np.maximum(sizes[word[at]] - 1, 1)[:, None]
        return out

    def gradients(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the vectors, from those of the words' inputs."""
        own, word, gram = rows
        gw, gg = np.zeros_like(self.words), np.zeros_like(self.grams)
        share = dx[:, WIDTH:] / np.maximum(sizes - 1, 1)[:, None]
        for k in range(WIDTH):
            gw[:, k] = np.bincount(own, dx[:, k], len(self.words))
            if len(gram):
                gg[:, k] = np.bincount(gram, share[word, k], len(self.grams))
        return gw, gg


class Adam:
    """Steps of moving means of gradients and their squares."""

    def __init__(self, rate: float):
        self.rate, self.step, self.means = rate, 0, {}

    def update(self, values: dict[str, np.ndarray], gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            m1, m2 = self.means.get(k, (0.0, 0.0))
            m1, m2 = self.means[k] = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            values[k] -= (self.rate * (m1 / (1 - 0.9**self.step)) / (np.sqrt(m2 / (1 - 0.99**self.step)) + 1e-6)).astype(values[k].dtype)


def pretrain(emb: Embeddings, rows: tuple, sizes: np.ndarray, texts: list[np.ndarray], y: np.ndarray, seed: int, steps: int = 80, batch: int = 400, sharp: float = 3.0, decay: float = 1e-4) -> np.ndarray:
    """Train embeddings with a readout of single words, of which a text's logit is a soft maximum; returns each word's value."""
    rng = np.random.default_rng(seed)
    w = {"words": emb.words, "grams": emb.grams, "read": rng.normal(0, 0.5, INPUTS).astype(np.float32), "base": np.zeros(1, np.float32)}
    full = np.array([len(t) > 0 for t in texts])
    sides, adam = [np.flatnonzero(full & (y == side)) for side in (True, False)], Adam(0.05)
    for _ in range(steps if all(map(len, sides)) else 0):
        picked = np.concatenate([rng.choice(s, min(len(s), batch // 2), replace=False) for s in sides])
        some, word = np.unique(np.concatenate([texts[i] for i in picked]), return_inverse=True)
        text = np.repeat(np.arange(len(picked)), [len(texts[i]) for i in picked])
        first, own, own_sizes = np.flatnonzero(np.diff(text, prepend=-1)), _rows_of(rows, some), sizes[some]
        x = emb.inputs(own, own_sizes)
        s = (x @ w["read"])[word]
        a = np.exp(sharp * (s - np.maximum.reduceat(s, first)[text]))
        a /= np.add.reduceat(a, first)[text]
        pooled = np.add.reduceat(a * s, first)
        d = (sigmoid(pooled + w["base"][0]) - y[picked]) / len(picked)
        ds = np.bincount(word, d[text] * a * (1 + sharp * (s - pooled[text])), len(x)).astype(np.float32)
        gw, gg = emb.gradients(own, own_sizes, ds[:, None] * w["read"])
        adam.update(w, {"words": gw + decay * emb.words, "grams": gg + decay * emb.grams, "read": x.T @ ds + decay * w["read"], "base": d.sum(keepdims=True)})
    return emb.inputs(rows, sizes) @ w["read"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights: of inputs (both directions), of gates, of states, of attention and of the output."""

    w: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int) -> Network:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w |= {f"in_{d}": rng.normal(0, 0.3, (INPUTS, 3 * HIDDEN)), f"bias_{d}": np.zeros(3 * HIDDEN), f"gate_{d}": rng.normal(0, 0.2, (HIDDEN, 2 * HIDDEN)), f"state_{d}": rng.normal(0, 0.2, (HIDDEN, HIDDEN))}
        w |= {"attend": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "choose": rng.normal(0, 0.3, HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "base": np.zeros(1)}
        return Network({k: v.astype(np.float32) for k, v in w.items()})

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """What each word adds to the gates and states of both directions."""
        return np.hstack([inputs @ self.w[f"in_{d}"] + self.w[f"bias_{d}"] for d in "fb"]).astype(np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray | None, d: str, trace: list | None) -> list[np.ndarray]:
        """States after each word, by position; x: (windows, LENGTH, 3 * HIDDEN)."""
        gate, state, h = self.w[f"gate_{d}"], self.w[f"state_{d}"], np.zeros((len(x), HIDDEN), np.float32)
        out: list = [None] * x.shape[1]
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            g = x[:, t, : 2 * HIDDEN] + h @ gate
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)  # gates of update and reset
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            n = np.tanh(x[:, t, 2 * HIDDEN :] + (r * h) @ state)
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[:, t, None], new, h)
            if trace is not None:
                trace.append((t, h, z, r, n))
            h = out[t] = new
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray | None = None, trace: dict | None = None) -> np.ndarray:
        """The logit of each window; x: projections of its words, mask: which are words (None: all)."""
        steps = {d: [] if trace is not None else None for d in "fb"}
        ways = [self._pass(x[:, :, k * 3 * HIDDEN : (k + 1) * 3 * HIDDEN], mask, d, steps[d]) for k, d in enumerate("fb")]
        states = np.concatenate([np.stack(way, 1) for way in ways], 2)
        seen = np.tanh(states @ self.w["attend"])
        e = seen @ self.w["choose"]
        if mask is not None:
            e = np.where(mask, e, -30)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        if mask is not None:
            a = a * mask
        pooled = (a[:, :, None] * states).sum(axis=1)
        if trace is not None:
            trace |= {"steps": steps, "states": states, "seen": seen, "a": a, "pooled": pooled}
        return pooled @ self.w["out"] + self.w["base"][0]

    def gradients(self, inputs: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows, and its gradients, "inputs" among them; inputs: (windows, LENGTH, INPUTS)."""
        w, trace = self.w, {}
        logits = self.logits(self.project(inputs.reshape(-1, INPUTS)).reshape(*inputs.shape[:2], -1), mask, trace)
        p = sigmoid(logits)
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        dl = ((p - y) / len(y)).astype(np.float32)
        states, seen, a = trace["states"], trace["seen"], trace["a"]
        g = {"out": trace["pooled"].T @ dl, "base": dl.sum(keepdims=True)}
        dp = dl[:, None] * w["out"]
        da = (states * dp[:, None, :]).sum(axis=2)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["choose"] = (seen * de[:, :, None]).sum(axis=(0, 1))
        ds = de[:, :, None] * w["choose"] * (1 - seen**2)
        g["attend"] = np.einsum("bti,btj->ij", states, ds)
        dstates = a[:, :, None] * dp[:, None, :] + ds @ w["attend"].T
        for k, d in enumerate("fb"):
            gate, state = w[f"gate_{d}"], w[f"state_{d}"]
            g |= {f"gate_{d}": np.zeros_like(gate), f"state_{d}": np.zeros_like(state)}
            dx, dh = np.zeros((*inputs.shape[:2], 3 * HIDDEN), np.float32), np.zeros((len(y), HIDDEN), np.float32)
            for t, h, z, r, n in reversed(trace["steps"][d]):
                dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, t, None]
                new, dh = dh * m, dh * ~m
                dz, dn = new * (h - n) * z * (1 - z), new * (1 - z) * (1 - n**2)
                back = dn @ state.T
                dr = back * h * r * (1 - r)
                both = np.hstack([dz, dr])
                g[f"state_{d}"] += (r * h).T @ dn
                g[f"gate_{d}"] += h.T @ both
                dh = dh + new * z + back * r + both @ gate.T
                dx[:, t] = np.hstack([both, dn])
            g[f"in_{d}"] = np.einsum("bti,btj->ij", inputs, dx)
            g[f"bias_{d}"] = dx.sum(axis=(0, 1))
            g["inputs"] = g.get("inputs", 0) + dx @ w[f"in_{d}"].T
        return loss, g


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of n words: each word is in one, all but the ends in two."""
    return np.arange(max(1, -(-(n - STRIDE) // STRIDE))) * STRIDE


@dataclass
class ToxicModel:
    embeddings: Embeddings | None
    network: Network | None
    slope: float = 1.0
    shift: float = 0.0
    losses: list[float] = field(default_factory=list)

    def word_rows(self, found: list[bytes]) -> np.ndarray:
        flat, sizes = features(found)
        return self.network.project(self.embeddings.inputs(self.embeddings.rows(flat, sizes), sizes))

    def windows(self, rows: np.ndarray, table: np.ndarray, sizes: np.ndarray, batch: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word in it, logit) of all windows; rows: numbers of the texts' words in table, text after text."""
        starts = [window_starts(n) for n in sizes.tolist()]
        text = np.repeat(np.arange(len(sizes)), [len(s) for s in starts])
        ends, first = np.cumsum(sizes), np.concatenate([*starts, np.empty(0, np.int64)])
        start = first + (ends - sizes)[text]
        out, whole = np.empty(len(start), np.float32), start + LENGTH <= ends[text]
        for full in (True, False):
            picked = np.flatnonzero(whole == full)
            for k in range(0, len(picked), batch):
                own = picked[k : k + batch]
                at = start[own][:, None] + np.arange(LENGTH)
                mask = None if full else at < ends[text[own]][:, None]
                x = table[rows[np.minimum(at, len(rows) - 1)]] if len(rows) else np.zeros((*at.shape, 6 * HIDDEN), np.float32)
                out[own] = self.network.logits(x, mask)
        return text, first, out

    def highest(self, rows: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The highest logit over all windows of each text."""
        text, _, out = self.windows(rows, table, sizes)
        return np.maximum.reduceat(out, np.flatnonzero(np.diff(text, prepend=-1))) if len(out) else out

    def score(self, logits: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logits.astype(np.float64) + self.shift)


def train(texts: list[str], toxic: list[bool], *, seed: int = 0, steps: int = 240, batch: int = 192, rounds: int = 3) -> ToxicModel:
    """A model from labelled texts."""
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        return ToxicModel(None, None)
    rng, number, words = np.random.default_rng(seed), {}, []
    for t in texts:  # words by their numbers in a vocabulary
        words.append(np.array([number.setdefault(w, len(number)) for w in t.encode("utf-8", "replace").split()], np.int64))
    cores: dict[bytes, int] = {}
    place = np.array([cores.setdefault(core(w), len(cores)) for w in number], np.int64)
    words = [place[ws] if len(ws) else ws for ws in words]
    flat, sizes = features(list(cores))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kept = np.ones(len(y), bool)
    for side in (y, ~y):  # one text in five of each label is for calibration, if there are some
        kept[np.flatnonzero(side)[4::5]] = False
    learn = np.flatnonzero(kept)
    distinct = [np.unique(words[i]) for i in learn]
    emb = Embeddings.new(flat, sizes, distinct, seed)
    rows = emb.rows(flat, sizes)
    value = pretrain(emb, rows, sizes, distinct, y[learn], seed)
    model = ToxicModel(emb, Network.new(seed))
    flat_words, ends = np.concatenate([*words, np.empty(0, np.int64)]), np.cumsum(lengths)

    def window(i: int, start: int) -> np.ndarray:
        out = np.full(LENGTH, -1)
        part = words[i][start : start + LENGTH]
        out[: len(part)] = part
        return out

    best = [int(s[np.argmax([value[x[k : k + LENGTH]].max(initial=-np.inf) for k in s.tolist()])]) for x in words for s in [window_starts(len(x))]]
    fast, slow = Adam(0.02), Adam(0.005)
    yes, no = learn[y[learn]], learn[~y[learn]]
    for _ in range(rounds):
        for _ in range(steps // rounds):
            picked = np.concatenate([rng.choice(yes, batch // 2), rng.choice(no, batch // 2)])
            parts = []
            for i in picked.tolist():  # clean texts: their likeliest window, or any
                any_ = not y[i] and rng.random() < 0.5
                parts.append(window(i, int(rng.choice(window_starts(len(words[i])))) if any_ else best[i]))
            at = np.stack(parts)
            mask = at >= 0
            some, place = np.unique(at[mask], return_inverse=True)
            own, own_sizes = _rows_of(rows, some), sizes[some]
            inputs = np.zeros((*at.shape, INPUTS), np.float32)
            inputs[mask] = emb.inputs(own, own_sizes)[place]
            loss, g = model.network.gradients(inputs, mask, y[picked].astype(np.float32))
            model.losses.append(loss)
            d = g.pop("inputs")[mask]
            dx = np.stack([np.bincount(place, d[:, k], len(some)) for k in range(INPUTS)], 1).astype(np.float32)
            fast.update(model.network.w, g)
            slow.update({"words": emb.words, "grams": emb.grams}, dict(zip(("words", "grams"), emb.gradients(own, own_sizes, dx), strict=True)))
        table = model.network.project(emb.inputs(rows, sizes))
        text, first, z = model.windows(flat_words, table, lengths)
        by = np.lexsort((-z, text))  # each text's window of the highest logit comes first
        by = by[np.diff(text[by], prepend=-1) > 0]
        best, z = first[by].tolist(), z[by].astype(np.float64)
    slope, shift = 1.0, 0.0
    use = ~kept if (y & ~kept).any() and (~y & ~kept).any() else kept
    z, y = z[use], y[use]
    weight = np.where(y, 0.2 / y.sum(), 0.8 / (~y).sum())  # one toxic text in five
    for _ in range(400):  # calibration of the highest logit, with a weak pull to the logit itself
        p = sigmoid(slope * z + shift)
        slope -= 0.3 * (float((weight * (p - y) * z).sum()) + 0.01 * (slope - 1))
        shift -= 0.3 * (float((weight * (p - y)).sum()) + 0.01 * shift)
    model.slope, model.shift = max(slope, 0.1), shift
    return model


def _rows_of(rows: tuple[np.ndarray, np.ndarray, np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of some words, in ascending order, as rows of words 0, 1, ..."""
    own, word, gram = rows
    start, end = np.searchsorted(word, some), np.searchsorted(word, some, "right")
    n = end - start
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return own[some], np.repeat(np.arange(len(some)), n), gram[at]


def remainder(id_: Column, by: int) -> Column:
    """crc32 of an id as text, modulo a number; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % by


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = 1500, seed: int = 0) -> ToxicModel:
    """A model from most_docs labelled documents of each label at most, without those of remainder 1 modulo 3."""
    rows = labels.select(labels[id_col].alias("id"), (labels[label_col] == 1).alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull()).where(remainder(F.col("id"), 3) != 1)
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    rows = rows.where("toxic").orderBy(*order).limit(most_docs).unionAll(rows.where("NOT toxic").orderBy(*order).limit(most_docs))
    some = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(rows), "id")
    found = some.groupBy("id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).orderBy("id")  # most_docs of each label at most
    found = [(r.text, r.toxic) for r in found.toLocalIterator()]
    return train([t for t, _ in found], [x for _, x in found], seed=seed)


def score(docs: DataFrame, model: ToxicModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (0 to 1) of each row."""
    if model.network is None:
        return docs.select(docs[id_col].alias(id_col), F.lit(0.0).alias("score"))
    token = hash((tuple(model.network.w["out"].tolist()), model.embeddings.words.tobytes(), model.slope))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(f"toxicity {token}", ("words",), lambda: WordRows(model.word_rows, 250_000))
        for batch in batches:
            for start, end in pieces(batch, "_text", 2_000_000):
                found = [(x or b"").split() for x in batch.column(1).slice(start, end - start).to_pylist()]
                rows = words.rows([w for f in found for w in f])
                z = model.highest(rows, words.data, np.fromiter(map(len, found), np.int64, len(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(model.score(z))], names=[id_col, "score"])

    lean = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("_text"))
    return lean.mapInArrow(tidy(run, keep=True), lean.select(id_col, F.lit(0.0).alias("score")).schema)
