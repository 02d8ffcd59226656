"""Encoding a corpus with a public byte-level tokenizer, and decoding it again."""

from __future__ import annotations

import base64
import json
import os
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary file lies on every executor; the files are never part of this repository.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: The same vocabulary as a list of ranks, for the other library: it gives the same ids in about a quarter of the time.
BYTE_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this vocabulary's texts are split before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text longer than this many characters is encoded in parts, so that the tokenizer's own objects stay small.
PART = 50_000
#: So many characters go to the tokenizer in one call.
CALL = 400_000


def _kept(what: str, path: str, make):
    """What make(path) gave the first time in this process. Workers get this module's functions by value with each
    task, so what they keep can't lie in the module."""
    store = sys.__dict__.setdefault("_tidemark_kept", {})
    if (what, path) not in store:
        store[what, path] = make(path)
    return store[what, path]


def tokenizer(path: str):
    """The tokenizer of a worker process; the strings of special tokens count as ordinary text."""
    return _kept("tokenizer", path, _load)


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    return t


def byte_table() -> dict[str, int]:
    """Character of the vocabulary -> byte. Printable bytes stand for themselves, the others follow from 256 up in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def vocabulary(path: str) -> list[bytes]:
    """The bytes of each id; an id the file does not use has none."""
    return _kept("vocabulary", path, _read_vocabulary)


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _load_ranks(path: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=_read_ranks(path), special_tokens={})


def _read_vocabulary(path: str) -> list[bytes]:
    if path.endswith(".tiktoken"):
        ranks = _read_ranks(path)
        out = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            out[i] = token
        return out
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    table = byte_table()
    out = [b""] * (max([*known["model"]["vocab"].values(), *(a["id"] for a in known["added_tokens"])]) + 1)
    for text, i in known["model"]["vocab"].items():
        out[i] = bytes(table[c] for c in text) if all(c in table for c in text) else text.encode()
    for a in known["added_tokens"]:
        out[a["id"]] = a["content"].encode()
    return out


def byte_lengths(path: str) -> np.ndarray:
    return _kept("lengths", path, lambda p: np.array([len(b) for b in vocabulary(p)], dtype=np.int64))


_SPLIT = re.compile(r"(?<=\S)(?=[ \n])")


def parts(text: str, most: int = PART) -> list[str]:
    """text in parts of about most characters whose encodings, joined, are the encoding of text.

    The tokenizer's own pattern always breaks between a visible character and white space after it, and what it finds
    before such a place does not depend on what follows. Without such a place the part goes on.
    """
    out, start = [], 0
    while len(text) - start > most:
        m = _SPLIT.search(text, start + most)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def _clean(text: str) -> str:
    # Lone surrogates have no UTF-8 form; they become the replacement character.
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _by_ranks(texts: list[str | None], path: str) -> Iterator[np.ndarray]:
    e = _kept("ranks", path, _load_ranks)
    for text in texts:
        ids = [e.encode_to_numpy(p, disallowed_special=()).astype(np.int32) for p in parts(_clean(text))] if text else []
        yield ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.zeros(0, np.int32)


def encode(texts: list[str | None], path: str = BYTE_BPE) -> Iterator[np.ndarray]:
    """The ids of each text without special tokens; null and empty texts have none. Yields in order.

    path is a vocabulary of the tokenizers library or, if it ends in .tiktoken, a list of ranks.
    """
    if path.endswith(".tiktoken"):
        yield from _by_ranks(texts, path)
        return
    t = tokenizer(path)
    queue: list[list[str]] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        flat = [p for q in queue for p in q]
        done = iter(t.encode_batch_fast(flat, add_special_tokens=False)) if flat else iter(())
        for q in queue:
            ids = [np.array(next(done).ids, dtype=np.int32) for _ in q]
            yield np.concatenate(ids) if ids else np.zeros(0, np.int32)

    for text in texts:
        queue.append(parts(_clean(text)) if text else [])
        held += len(text or "")
        if held >= CALL:
            yield from flush()
            queue, held = [], 0
    yield from flush()


def decode_bytes(ids, path: str = BYTE_BPE) -> bytes:
    """The bytes that ids stand for. A run of ids may begin or end inside a character."""
    v = vocabulary(path)
    return b"".join(v[i] for i in ids)


def decode(ids, path: str = BYTE_BPE) -> str:
    """The text of ids; bytes of a character that the ids hold only in part come out as one replacement character each run."""
    return decode_bytes(ids, path).decode("utf-8", "replace")


def char_offsets(ids: np.ndarray, text_bytes: bytes, path: str = BYTE_BPE) -> tuple[np.ndarray, np.ndarray]:
    """For each place between ids (0 to len(ids)): the count of characters begun before it, and whether it lies
    between characters rather than inside one."""
    ends = np.concatenate([[0], np.cumsum(byte_lengths(path)[ids])]) if len(ids) else np.zeros(1, np.int64)
    raw = np.frombuffer(text_bytes, dtype=np.uint8)
    lead = (raw & 0xC0) != 0x80
    begun = np.concatenate([[0], np.cumsum(lead)])
    clean = np.append(lead, True)[np.minimum(ends, len(raw))]
    return begun[ends], clean


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def small_batches(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about so many bytes, at least one row each."""
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def token_ids(df: DataFrame, *, id: str, text: str, path: str = BYTE_BPE) -> DataFrame:
    """(id, ids): the ids of each row's text, in one pass over Arrow batches without a shuffle.

    Null and empty texts give an empty list, repeated rows one list each; special tokens' strings are ordinary text.
    Other columns aren't read.
    """
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_batches(whole, "t"):
                yield pa.RecordBatch.from_arrays([b.column("i"), _lists(list(encode(b.column("t").to_pylist(), path)))], names=[id, "ids"])

    return df.selectExpr(f"`{id}` as i", f"`{text}` as t").mapInArrow(run, f"`{id}` {kind}, ids array<int>")


def token_counts(df: DataFrame, *, text: str, keep: list[str], path: str = BYTE_RANKS, name: str = "n_tokens") -> DataFrame:
    """The columns in keep and the number of tokens of text (0 for null and empty), without the ids."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_batches(whole, "__text"):
                n = np.array([len(x) for x in encode(b.column("__text").to_pylist(), path)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n)], names=[*keep, name])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as __text").mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{name}` bigint")


def decoded(df: DataFrame, *, id: str, ids: str, path: str = BYTE_BPE) -> DataFrame:
    """(id, text): the text of each list of ids; null gives null. Ids outside the vocabulary raise an error."""
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode(x, path) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(texts, pa.string())], names=[id, "text"])

    return df.selectExpr(f"`{id}` as i", f"`{ids}` as x").mapInArrow(run, f"`{id}` {kind}, text string")
