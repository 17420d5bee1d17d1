"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

Every passage of every training document is a query. As in WAND, sums of its terms' largest weights say
what can be skipped: the passage itself, by the largest in any item; then runs of blocks, then blocks of
items, by the largest in each. Skipping goes over all passages of a batch at once, run by run and block by block, in place
of one pivot after another; only blocks that may hold an item above the threshold are scored in full. All items
above it are retrieved, and each is verified by the overlap of its question and its answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import SLICE, drop_staged, extended, sliced, staged

K1, B = 1.2, 0.75
BLOCK, RUN = 4, 8  # items of an index block, blocks of a run
CELLS = 1 << 21  # postings or sums that a step holds at a time
ROUNDING = 1e-9  # by which a score may miss the threshold
EDGES = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
RAW_WORDS = 100_000
NO_TERM = -2  # the number of a word of punctuation only


def terms_of(text: str | None) -> list[bytes]:
    """Words at white space, A-Z lower-cased, without ASCII punctuation at their ends."""
    return [x for w in (text or "").encode().lower().split() if (x := w.strip(EDGES))]


def question_answer(text: str) -> tuple[str, str]:
    """An item's question and answer: the answer follows the last question mark or else
    is the last sentence of two words or more; one sentence alone is a question."""
    at = text.rfind("?")
    if 0 <= at < len(text.rstrip()) - 1:
        return text[: at + 1], text[at + 1 :]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    for e in reversed(ends):
        if len(text[e:].split()) >= 2:
            return text[:e], text[e:]
    return text, ""


def grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def overlap(part: list[bytes], passage: list[bytes], n: int) -> float:
    """The share of the part's word n-grams that the passage holds; 1 of an empty part."""
    own = grams(part, n)
    return len(own & grams(passage, min(n, len(part)))) / len(own) if own else 1.0


class _Numbers(dict):
    """Raw word -> term number, -1 if no item has it, NO_TERM without a term; what is kept is bounded."""

    def __init__(self, vocab: dict[bytes, int]):
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        x = self.vocab.get(own, -1) if (own := word.strip(EDGES)) else NO_TERM
        if len(self) < RAW_WORDS:
            self[word] = x
        return x


@dataclass
class Postings:
    """For each term the places that hold it and its weight there: items, or blocks or runs with the largest in them."""

    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    n: int  # how many places there are

    def coarser(self, by: int) -> Postings:
        """The same over runs of ``by`` places."""
        terms = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        n = -(-self.n // by)
        keys, inverse = np.unique(terms * n + self.places // by, return_inverse=True)
        most = np.zeros(len(keys))
        np.maximum.at(most, inverse, self.weights)
        return Postings(np.searchsorted(keys, np.arange(len(self.starts)) * n), keys % max(1, n), most, n)

    def sums(self, win: np.ndarray, term: np.ndarray, wins: int, open_: np.ndarray | None, by: int) -> np.ndarray:
        """wins x places: the summed weights of each window's terms, only in places whose coarser one is open for it."""
        out = np.zeros(wins * self.n)
        size = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(size)
        at = 0
        while at < len(term):  # so many postings at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, side="right")))
            own = size[at:to]
            k = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - self.starts[term[at:to]], own)
            w, place = np.repeat(win[at:to], own), self.places[k]
            if open_ is not None:
                live = open_[w, place // by]
                w, place, k = w[live], place[live], k[live]
            out += np.bincount(w * self.n + place, self.weights[k], len(out))
            at = to
        return out.reshape(wins, self.n)


@dataclass
class Index:
    """A bounded shard of items. Weights are BM25 over the item's score of itself, so a
    passage that holds a whole item scores about 1 on it."""

    ids: list
    parts: list[tuple[list[bytes], list[bytes]]]
    vocab: dict[bytes, int]
    items: Postings
    blocks: Postings
    runs: Postings
    term_max: np.ndarray
    window: int
    numbers: _Numbers | None = None  # filled by each worker

    @staticmethod
    def build(rows: list[tuple[object, str]], df: dict[bytes, int], total: int, mean_len: float) -> Index:
        vocab: dict[bytes, int] = {}
        post: list[tuple[int, int, float]] = []
        longest = 1
        for k, (_, text) in enumerate(rows):
            words = terms_of(text)
            longest = max(longest, len(words))
            tf: dict[bytes, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(words) / max(1.0, mean_len))
            own = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            whole = sum(own.values())
            post += [(vocab.setdefault(w, len(vocab)), k, x / whole) for w, x in own.items()]
        post.sort()
        t, i, x = (np.array(c) for c in zip(*post)) if post else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        items = Postings(np.searchsorted(t, np.arange(len(vocab) + 1)), i, x, len(rows))
        blocks = items.coarser(BLOCK)
        term_max = np.maximum.reduceat(x, items.starts[:-1]) if post else np.zeros(0)
        parts = [tuple(terms_of(p) for p in question_answer(text or "")) for _, text in rows]
        return Index([r[0] for r in rows], parts, vocab, items, blocks, blocks.coarser(RUN), term_max, max(64, 2 * (longest + longest // 4)))


def candidates(docs: list[np.ndarray], index: Index, least: float) -> list[tuple[int, int, int, float]]:
    """(document, window, item, score) of all windows and items that reach ``least``, up to ROUNDING.

    ``docs`` holds each document's term numbers by term, -1 for terms no item has.
    Windows overlap by half, which holds the longest item and a quarter more, so any item lies in one whole,
    also with so many words put into it.
    """
    least -= ROUNDING
    step = index.window // 2
    lengths = np.array([len(d) for d in docs])
    wins = np.maximum(1, (lengths + step - 1) // step)
    base = np.cumsum(wins) - wins
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    known = np.flatnonzero(flat >= 0)
    doc = np.repeat(np.arange(len(docs)), lengths)[known]
    pos = known - (np.cumsum(lengths) - lengths)[doc]
    win = base[doc] + pos // step
    term = flat[known]
    vocab = len(index.vocab)
    back = pos >= step
    keys = np.unique(np.concatenate([win * vocab + term, (win[back] - 1) * vocab + term[back]]))
    win, term = keys // vocab, keys % vocab
    live = np.bincount(win, index.term_max[term], int(wins.sum()))[win] >= least
    win, term = win[live], term[live]
    out: list[tuple[int, int, int, float]] = []
    if not len(win):
        return out
    which, win = np.unique(win, return_inverse=True)
    width = max(1, CELLS // index.items.n)  # windows whose sums fit
    for lo in range(0, len(which), width):
        a, b = np.searchsorted(win, [lo, lo + width])
        w, t = win[a:b] - lo, term[a:b]
        n = min(width, len(which) - lo)
        open_ = index.runs.sums(w, t, n, None, 1) >= least
        keep = open_.any(1)[w]
        w, t = w[keep], t[keep]
        open_ = index.blocks.sums(w, t, n, open_, RUN) >= least
        keep = open_.any(1)[w]
        scores = index.items.sums(w[keep], t[keep], n, open_, BLOCK)
        for k, i in zip(*np.nonzero(scores >= least)):
            at = int(which[lo + k])
            d = int(np.searchsorted(base, at, side="right") - 1)
            out.append((d, at - int(base[d]), int(i), float(scores[k, i])))
    return out


def matches(texts: list[str | None], index: Index, least: float, n: int, question: float, answer: float) -> list[dict[int, tuple[float, float, float]]]:
    """For each text its verified items: item number -> (score, question and answer overlap)."""
    if index.numbers is None:
        index.numbers = _Numbers(index.vocab)
    numbers = index.numbers
    words = [(t or "").encode().lower().split() for t in texts]
    docs = [np.array([numbers[w] for w in own], np.int64) for own in words]
    at = [np.flatnonzero(x != NO_TERM) for x in docs]  # the words that are terms
    docs = [x[k] for x, k in zip(docs, at)]
    found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
    step = index.window // 2
    for d, w, i, score in candidates(docs, index, least):
        passage = [words[d][k].strip(EDGES) for k in at[d][w * step : w * step + 2 * step]]
        q, a = (overlap(p, passage, n) for p in index.parts[i])
        if q >= question and a >= answer:
            found[d][i] = max(found[d].get(i, (0.0, 0.0, 0.0)), (score, q, a))
    return found


def shards_of(items: DataFrame, id_col: str, text_col: str, shard_items: int, shard_bytes: int) -> Iterator[Index]:
    """The index in shards of about ``shard_items`` items and ``shard_bytes`` bytes of text at most, each bounded for the driver
    and a broadcast; document frequencies are those of all items."""
    import pyarrow as pa

    narrow = items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).filter(F.col("t").isNotNull())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            terms, sizes = [], []
            for t in b.column("t").to_pylist():
                own = terms_of(t)
                terms += sorted(set(own))
                sizes += [len(own)] + [0] * (len(set(own)) - 1) if own else []
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(sizes, pa.int64())], ["term", "words"])

    freq = staged(narrow.mapInArrow(split, "term binary, words long").groupBy("term").agg(F.count("*").alias("df"), F.sum("words").alias("words")), "item-terms")
    total, size = narrow.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    mean = (freq.agg(F.sum("words")).first()[0] or 0) / max(1, total)
    shards = max(1, -(-total // shard_items), -(-size // shard_bytes))
    shards = 2 * shards if shards > 1 else 1  # so that chance makes none much larger
    dealt = narrow.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)).cast("int"))
    dealt = staged(dealt, "items", "shard") if shards > 1 else dealt
    for k in range(shards):
        rows = [(r["i"], r["t"]) for r in dealt.filter(F.col("shard") == k).select("i", "t").collect()]
        rows = sorted((r for r in rows if terms_of(r[1])), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        if not rows:
            continue
        if shards == 1:
            df = {bytes(r["term"]): r["df"] for r in freq.collect()}
        else:
            wanted = items.sparkSession.createDataFrame([(bytearray(w),) for w in {w for _, t in rows for w in terms_of(t)}], "term binary")
            df = {bytes(r["term"]): r["df"] for r in freq.join(wanted, "term").collect()}
        yield Index.build(rows, df, total, mean)
    drop_staged(freq)


def find_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    least: float = 0.5, n: int = 5, question: float = 0.5, answer: float = 0.5, shard_items: int = 4096, shard_bytes: int = 1 << 25,
) -> DataFrame:
    """``docs`` with two more columns: _items, the sorted ids of benchmark items found in it, and _score,
    the best BM25 score over an item's own (0 if none).

    An item is found if a passage of the document scores ``least`` or more on it and holds at least the
    shares ``question`` and ``answer`` of the ``n``-word runs of its two parts. Passages are runs
    of two and a half times the longest item's terms that overlap by half and cover the whole text; words
    of punctuation only are no terms. Items
    without words, and null and empty texts, are in nothing. Ids of documents are not used;
    an item without id is listed as null, ids of items may be of any type that sorts, and of items that repeat or tie each is
    listed, an id once for each of its rows. An empty table of documents gives an empty result, one of items finds nothing.
    Input columns with the names of added ones give way to them.

    The index goes over the documents in shards of about ``shard_items`` items; one batch of documents after another meets all
    of them, and a worker holds one at a time. All shards are broadcast, so what executors keep, in blocks that go to disk
    where memory is short, grows with the benchmark and not with the documents.
    """
    import pyarrow as pa

    docs = docs.drop("_items", "_score")
    sc = docs.sparkSession.sparkContext
    held = [sc.broadcast(index) for index in shards_of(items, item_id_col, item_text_col, shard_items, shard_bytes)]
    names = docs.columns
    at = names.index(text_col)
    kind = items.schema[item_id_col].dataType
    schema = extended(docs.schema, f"_items array<{kind.simpleString()}>, _score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, SLICE if len(held) < 2 else 16 * SLICE):
            texts = b.column(at).to_pylist()
            ids, scores = [[] for _ in texts], [0.0] * len(texts)
            for h in held:
                index = h.value
                for k in range(0, len(texts), 256):
                    for j, own in enumerate(matches(texts[k : k + 256], index, least, n, question, answer), k):
                        ids[j] += [index.ids[i] for i in own]
                        scores[j] = max([scores[j], *(x[0] for x in own.values())])
                if len(held) > 1:
                    del index
                    vars(h).pop("_value", None)  # read again from the worker's disk when its turn comes
            ids = [sorted(x, key=lambda i: (i is None, i if i is not None else 0)) for x in ids]
            cols = [b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, id_list), pa.array(scores, pa.float64())], [*names, "_items", "_score"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_list = to_arrow_type(schema["_items"].dataType)
    return docs.mapInArrow(run, schema)
