"""Language identification with a linear-chain conditional random field.

Each word gets a score per language from its affixes, character n-grams and lexicon
entries; learned transitions tie neighbouring words. Forward-backward labels every word, also where
languages alternate; a document's language has the largest mean marginal.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import bounded_sample, extended, sliced

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
DIM = 1 << 16
CACHED_WORDS = 150_000
LONG = 40  # characters up to which a word is kept in a worker's cache
SEGMENT = 64


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Feature name -> bucket; what is kept is bounded."""

    def __missing__(self, name: str) -> int:
        n = zlib.crc32(name.encode()) & (DIM - 1)
        if len(self) < 100_000:
            self[name] = n
        return n


_hashes = _Hashes()


def word_features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed affix, n-gram and lexicon features of one lower-cased word, whole however long."""
    w = f"^{word}$"
    names = [f"p{w[1:k]}" for k in (2, 3, 4)] + [f"s{w[-k:-1]}" for k in (2, 3, 4)]
    names += [w[k : k + 2] for k in range(len(w) - 1)] + [w[k : k + 3] for k in range(len(w) - 2)]
    names += [f"lex{k}" for k in lexicon.get(word, ())] or ["lex-"]
    return [_hashes[x] for x in names]


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # DIM x languages
    trans: np.ndarray  # languages x languages
    lexicon: dict[str, tuple[int, ...]]
    seen: np.ndarray = field(default_factory=lambda: np.zeros(DIM, bool))  # features that training met
    cache: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "cache": {}, "rows": None}

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the words, one row each, and the share of each word's features that training met. Frequent
        words are kept; the others of a batch are scored once in it."""
        both = self._emissions(words)
        return both[:, :-1], both[:, -1]

    def _emissions(self, words: list[str]) -> np.ndarray:
        if self.rows is None:
            self.rows = np.zeros((CACHED_WORDS, len(self.langs) + 1), np.float32)
        if not words:
            return self.rows[:0]
        get = self.cache.get
        at = [get(w, -1) for w in words]
        rows = self.rows
        if -1 in at:
            late: dict[str, int] = {}
            base = len(self.cache)
            for k, n in enumerate(at):
                if n < 0:
                    at[k] = late.setdefault(words[k], base + len(late))
            feats = [word_features(w, self.lexicon) for w in late]
            size = np.array([len(f) for f in feats])
            flat = np.fromiter((x for f in feats for x in f), np.int64, size.sum())
            starts = np.cumsum(size) - size
            new = np.empty((len(size), len(self.langs) + 1), np.float32)
            new[:, :-1] = np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(size)[:, None]
            new[:, -1] = np.add.reduceat(self.seen[flat].astype(np.float32), starts) / size
            room = min(len(new), CACHED_WORDS - base)
            self.rows[base : base + room] = new[:room]
            # a longer word keeps its place in the table but is scored again
            self.cache.update((w if len(w) <= LONG else f"{n}", n) for w, n in late.items() if n < CACHED_WORDS)
            if room < len(new):
                rows = np.vstack([self.rows[: base + room], new[room:]])
        return rows[np.array(at, np.int64)]


def _blocks(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How sequences of ``lengths`` lie in segments of ``size``: each token's flat
    position, each segment's rank in its sequence, each sequence's first segment."""
    per = (lengths + size - 1) // size
    first = np.cumsum(per) - per
    starts = np.cumsum(lengths) - lengths
    seq = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(lengths.sum()) - starts[seq]
    rank = np.arange(per.sum()) - np.repeat(first, per)
    return first[seq] * size + within, rank, first


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Exact forward-backward over many sequences at once.

    ``scores`` holds the tokens of all sequences one after another. Each is cut into
    segments whose transfer matrices carry the messages from one to the next, so a long
    sequence costs as many steps as a short one. Returns the token marginals and, with
    ``pairs``, the expected transition counts. The label before a sequence is uniform.
    """
    n = scores.shape[1]
    a = np.exp(trans - trans.max()).astype(np.float64)
    pos, rank, _ = _blocks(lengths, SEGMENT)
    segs = len(rank)
    if not segs:
        return np.zeros((0, n)), np.zeros((n, n))
    e = np.ones((segs * SEGMENT, n))
    e[pos] = np.exp(scores - scores.max(1, keepdims=True))
    live = np.zeros(segs * SEGMENT, bool)
    live[pos] = True
    e, live = e.reshape(segs, SEGMENT, n), live.reshape(segs, SEGMENT)
    m = np.broadcast_to(np.eye(n), (segs, n, n)).copy()
    for t in range(SEGMENT):
        k = live[:, t]
        step = (m[k].reshape(-1, n) @ a).reshape(-1, n, n) * e[k, t][:, None, :]
        m[k] = step / step.max((1, 2), keepdims=True)
    ranks = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[ranks], np.arange(rank.max() + 2))
    alpha, beta = np.full((segs, n), 1 / n), np.ones((segs, n))
    for r in range(1, rank.max() + 1):
        own = ranks[bounds[r] : bounds[r + 1]]
        x = np.einsum("si,sij->sj", alpha[own - 1], m[own - 1])
        alpha[own] = x / x.sum(1, keepdims=True)
    for r in range(rank.max(), 0, -1):
        own = ranks[bounds[r] : bounds[r + 1]]
        x = np.einsum("sij,sj->si", m[own], beta[own])
        beta[own - 1] = x / x.sum(1, keepdims=True)
    ahead = np.empty((SEGMENT + 1, segs, n))
    ahead[0] = alpha
    for t in range(SEGMENT):
        x = (ahead[t] @ a) * e[:, t]
        x /= x.sum(1, keepdims=True)
        ahead[t + 1] = np.where(live[:, t, None], x, ahead[t])
    out = np.empty((segs, SEGMENT, n))
    counts = np.zeros((n, n))
    inner = rank > 0
    for t in range(SEGMENT - 1, -1, -1):
        x = ahead[t + 1] * beta
        out[:, t] = x / x.sum(1, keepdims=True)
        back = e[:, t] * beta
        if pairs:
            k = live[:, t] & (inner | (t > 0))
            joint = ahead[t][k][:, :, None] * a * back[k][:, None, :]
            counts += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        x = back @ a.T
        x /= x.sum(1, keepdims=True)
        beta = np.where(live[:, t, None], x, beta)
    return out.reshape(-1, n)[pos], counts


def train(samples: dict[str, list[str]], steps: int = 40, rate: float = 0.3, decay: float = 1e-4, seed: int = 7) -> Crf:
    """Fit a CRF by Adam on the log-likelihood of labelled texts.

    Half of the training sequences are whole texts; the others string runs of 6 to 40
    words from texts of different languages together, for the transitions.
    """
    langs = sorted(samples)
    rng = np.random.default_rng(seed)
    texts = [(k, w) for k, lang in enumerate(langs) for t in samples[lang] if (w := words_of(t))]
    seen = [Counter() for _ in langs]
    for k, w in texts:
        seen[k].update(set(w))
    lexicon: dict[str, tuple[int, ...]] = {}
    for k in range(len(langs)):
        for w, c in seen[k].items():
            if c >= 5:
                lexicon[w] = (*lexicon.get(w, ()), k)
    sequences = [([k] * len(w), w) for k, w in texts]
    runs = []
    for k, w in texts:
        at = 0
        while at < len(w):
            size = int(rng.integers(6, 41))
            runs.append((k, w[at : at + size]))
            at += size
    rng.shuffle(order := np.arange(len(runs)))
    for j in range(0, len(order), 8):
        own = [runs[i] for i in order[j : j + 8]]
        sequences.append(([k for k, w in own for _ in w], [x for _, w in own for x in w]))
    n = max(1, len(langs))
    if not sequences:
        return Crf(langs or [UNKNOWN], np.zeros((DIM, n), np.float32), np.zeros((n, n)), {})
    types: dict[str, int] = {}
    ids = np.array([types.setdefault(x, len(types)) for _, w in sequences for x in w])
    gold = np.array([k for ks, _ in sequences for k in ks])
    lengths = np.array([len(w) for _, w in sequences])
    feats = [word_features(w, lexicon) for w in types]
    flat = np.concatenate([np.array(f) for f in feats])
    size = np.array([len(f) for f in feats])
    starts = np.cumsum(size) - size
    scale = 1 / np.sqrt(size)
    used, flat = np.unique(flat, return_inverse=True)
    w, trans = np.zeros((len(used), n)), np.zeros((n, n))
    one = np.eye(n)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(lengths) - lengths] = True
    follow = np.flatnonzero(~ends)
    told = np.zeros((n, n))
    np.add.at(told, (gold[follow - 1], gold[follow]), 1)
    state = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(trans), np.zeros_like(trans)]]
    owner = np.repeat(np.arange(len(types)), size)
    for step in range(1, steps + 1):
        emit = np.add.reduceat(w[flat], starts, axis=0) * scale[:, None]
        p, counts = marginals(emit[ids], lengths, trans, pairs=True)
        diff = p - one[gold]
        by_type = np.stack([np.bincount(ids, diff[:, k], len(types)) for k in range(n)], 1) * scale[:, None]
        grad = np.stack([np.bincount(flat, by_type[owner, k], len(used)) for k in range(n)], 1) / len(ids) * 100 + decay * w
        for x, g, s in ((w, grad, state[0]), (trans, (counts - told) / len(ids) * 100 + decay * trans, state[1])):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-6)
    weights = np.zeros((DIM, n), np.float32)
    weights[used] = w
    seen = np.zeros(DIM, bool)
    seen[used] = True
    return Crf(langs, weights, trans, lexicon, seen)


def predict(texts: list[str | None], model: Crf, batch_words: int = 50_000) -> list[tuple[str, float, float]]:
    """(language, mean marginal of its words, mean share of their features that training met) of each
    text; ``und`` without a letter."""
    out: list[tuple[str, float, float]] = []
    held: list[list[str]] = []

    def flush() -> None:
        lengths = np.array([len(w) for w in held], np.int64)
        flat = [x for w in held for x in w]
        scores, known = model.emissions(flat)
        p, _ = marginals(scores.astype(np.float64), lengths, model.trans)
        sums, near = np.zeros((len(held), len(model.langs))), np.zeros(len(held))
        full = np.flatnonzero(lengths)
        if len(full):
            starts = (np.cumsum(lengths) - lengths)[full]
            sums[full] = np.add.reduceat(p, starts, axis=0)
            near[full] = np.add.reduceat(known.astype(np.float64), starts)
        for s, k, n in zip(sums, near, lengths):
            out.append((model.langs[int(s.argmax())], float(min(1.0, s.max() / n)), float(min(1.0, k / n))) if n else (UNKNOWN, 0.0, 0.0))
        held.clear()

    size = 0
    for t in texts:
        words = words_of(t)
        if words and not any(map(str.isalpha, t)):
            words = []
        held.append(words)
        size += len(words)
        if size >= batch_words:
            flush()
            size = 0
    if held:
        flush()
    return out


def label_words(text: str, model: Crf) -> list[tuple[str, str]]:
    """Each word of a (code-switched) text with its language."""
    words = words_of(text)
    p, _ = marginals(model.emissions(words)[0].astype(np.float64), np.array([len(words)]), model.trans)
    return [(w, model.langs[k]) for w, k in zip(words, p.argmax(1))] if words else []


def held_out(id_col: str):
    """Whether crc32 of the id as text leaves 2 when divided by 4; false without id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 120, bytes_per_lang: int = 200_000, max_langs: int = 256,
) -> Crf:
    """Train on a sample of the labelled rows that are not held out: of each language whole texts, lowest hash of id
    and text first, until ``docs_per_lang`` or ``bytes_per_lang`` is reached. Longer texts are not taken.

    Equal rows count once, rows without text or language are left out, and a null id is like any other; so the
    driver gets no more than the bounds say. ``max_langs`` bounds the label set: more raise ValueError.
    An empty table gives a model that knows no language.
    """
    known = docs.filter(~held_out(id_col))
    lang, ident, text = (F.col(f"`{c}`") for c in (lang_col, id_col, text_col))
    return train(bounded_sample(known, lang.cast("string"), ident, text, docs_per_lang, bytes_per_lang, max_langs))


def language_id(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` with three more columns: lang_pred, score (0 to 1) and familiar (0 to 1): the mean share of a word's
    affixes and n-grams that training met in any language, which is low in a language that was not learned.

    Reads the whole text and nothing else. Null texts and those without a letter give
    ``und`` and 0; languages that tie are decided by alphabet. Ids are not used, so
    null and repeated ones are carried through; an empty table gives an empty result.
    Input columns with the names of added ones give way to them.
    """
    import pyarrow as pa

    docs = docs.drop("lang_pred", "score", "familiar")
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            got = predict(b.column(at).to_pylist(), held.value)
            cols = [b.column(k) for k in range(len(names))]
            found = [pa.array([g[0] for g in got], pa.string()), *(pa.array([g[k] for g in got], pa.float64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*cols, *found], [*names, "lang_pred", "score", "familiar"])

    return docs.mapInArrow(run, extended(docs.schema, "lang_pred string, score double, familiar double"))
