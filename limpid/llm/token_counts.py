"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.llm.common import sliced

#: A single space between two characters that are no space: no piece of a
#: sentencepiece vocabulary with white space as prefix crosses it.
SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

_processors: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_encoder(name: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(texts -> token counts, whether texts may be split at SAFE), once per worker."""
    if name not in _processors:
        path = name if "/" in name else tokenizer_path(name)
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = (sp.id_to_piece(i) for i in range(sp.vocab_size()))
            splits = not any("▁" in p.lstrip("▁") for p in pieces)
            _processors[name] = (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), splits
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _processors[name] = (lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]), False
    return _processors[name]


def split_text(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters whose token counts add up to the whole's.

    Every part after the first loses the space that the encoder puts before it.
    A text without a safe boundary stays whole.
    """
    parts, start = [], 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        parts.append(text[start : m.start()])
        start = m.end()
    parts.append(text[start:])
    return parts


def balanced(parts: list[tuple[int, str]], batch_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Runs of parts with about ``batch_bytes`` bytes of text each."""
    batch, size = [], 0
    for part in parts:
        batch.append(part)
        size += len(part[1]) * (1 if part[1].isascii() else 2)
        if size >= batch_bytes:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def count_texts(texts: list[str], model: str, batch_bytes: int, split_chars: int) -> list[int]:
    encode, splits = load_encoder(model)
    counts = [0] * len(texts)
    parts = [(k, p) for k, t in enumerate(texts) for p in (split_text(t, split_chars) if splits and len(t) > split_chars else [t])]
    for batch in balanced(parts, batch_bytes):
        for (k, _), n in zip(batch, encode([p for _, p in batch])):
            counts[k] += n
    return counts


def token_counts(
    docs: DataFrame,
    model: str = "piece_bpe_32k.model",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
    split_chars: int = 1 << 14,
) -> DataFrame:
    """One row per document: (id, n_bytes, n_tokens, over_limit).

    Counts the tokens of the whole text without begin, end or added special tokens.
    ``model`` is a file name of ``public_tokenizers`` or a path. A null text counts
    as empty, with 0 bytes and tokens; null and repeated ids are carried through; an
    empty table gives an empty result; other columns are not read.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t or "" for t in b.column("t").to_pylist()]
            n = pa.array(count_texts(texts, model, batch_bytes, split_chars), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("n"), n], ["i", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("i"), text.alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"))
    out = narrow.mapInArrow(run, f"i {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("i").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
