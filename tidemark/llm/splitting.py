"""Texts cut into overlapping pieces under a limit of tokens, at natural boundaries where there are any.

For every place of a text at which a piece may start, the end of that piece and the start of the next one follow from
the boundaries alone. These successors form a table; squaring it again and again (pointer doubling) gives the starts
that are reached from the beginning, that is, all cuts of the greedy walk, in a logarithmic number of steps and for all
texts of a batch together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.tokens import BYTE_RANKS, char_offsets, encode, small_batches

#: Ranks of boundaries, the places where the next piece would begin: paragraphs, sentences and lines, words.
PARAGRAPH, SENTENCE, WORD = 3, 2, 1
_PLACES = [(PARAGRAPH, regex.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*+")), (SENTENCE, regex.compile(r"(?:[.!?…]+[\"'»”’)\]]*+(?=\s)|[。！？]+[」』”]*+|\r\n|\r|\n)"))]
#: Whether each of the first characters of Unicode is white space; there's none behind them.
_BLANK = np.array([bool(regex.match(r"\s", chr(c))) for c in range(0x3001)] + [False])


def boundary_ranks(text: str, starts: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The rank of each place between tokens, 0 where there's no natural boundary, -1 inside a character.

    starts holds for each place the number of characters before it. A boundary that falls inside a token doesn't
    count. White space between two sentences may go with either; a boundary is taken on each side of it.
    """
    rank = np.zeros(len(text) + 1, dtype=np.int8)
    blank = _BLANK[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), len(_BLANK) - 1)]
    # A word begins or ends where white space meets another character.
    rank[1:-1][blank[1:] != blank[:-1]] = WORD
    for value, pattern in reversed(_PLACES):
        for m in pattern.finditer(text):
            rank[m.end()] = max(rank[m.end()], value)
            if value == PARAGRAPH:
                rank[m.start()] = max(rank[m.start()], value)
    rank[0] = rank[len(text)] = PARAGRAPH
    return np.where(clean, rank[starts], -1)


def successors(rank: np.ndarray, limit: int, overlap: int, hard: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place a piece's end, the next piece's start (its own place at the end of the text), and whether the end is natural.

    An end is the farthest boundary of the best rank in the second half of the limit, else the farthest natural
    boundary that carries the text on (more than overlap away), else hard tokens on. The next start is the first
    boundary among the last overlap tokens of the piece; if there's none, the first place of them between characters.
    """
    n = len(rank) - 1
    at = np.arange(n + 1)
    hard = hard or limit
    whole = np.flatnonzero(rank >= 0)
    hard_end = whole[np.searchsorted(whole, np.minimum(at + hard, n), side="right") - 1]
    # A character longer than the limit in tokens can't be cut at all: its end is the next place between characters.
    stuck = hard_end <= at
    hard_end[stuck] = whole[np.minimum(np.searchsorted(whole, at[stuck], side="right"), len(whole) - 1)]
    end, natural = hard_end.copy(), np.zeros(n + 1, dtype=bool)
    for value, least in ((WORD, overlap), (SENTENCE, limit // 2), (PARAGRAPH, limit // 2)):
        places = np.flatnonzero(rank >= value)
        if len(places):
            far = places[np.maximum(np.searchsorted(places, at + limit, side="right") - 1, 0)]
            ok = far > at + least
            end[ok], natural[ok] = far[ok], True
    end[at + limit >= n], natural[at + limit >= n] = n, True
    first = np.maximum(end - overlap, at + 1)
    soft = np.flatnonzero(rank >= WORD)
    start = soft[np.minimum(np.searchsorted(soft, first), len(soft) - 1)]
    late = (start > end) | (start < first)
    start[late] = whole[np.minimum(np.searchsorted(whole, first[late]), len(whole) - 1)]
    start = np.minimum(start, end)
    return end, np.where(end >= n, at, start), natural


def reached(succ: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places reached from begin by succ, which ends in fixed points, in ascending order, by pointer doubling."""
    seen = np.zeros(len(succ), dtype=bool)
    seen[begin] = True
    jump = succ
    while True:
        new = jump[np.flatnonzero(seen)]
        grown = bool((~seen[new]).any())
        seen[new] = True
        squared = jump[jump]
        if not grown and np.array_equal(squared, jump):
            return np.flatnonzero(seen)
        jump = squared


def pieces(texts: list[str | None], limit: int, overlap: int, path: str = BYTE_RANKS) -> Iterator[tuple[int, list[tuple[int, int, int, int, bool]], int]]:
    """(index of the text, [(first token, last token + 1, first character, last character + 1, natural)], tokens) of each text over the limit."""
    held, size, base = [], 0, 0

    def solve() -> Iterator[tuple[int, list[tuple[int, int, int, int, bool]], int]]:
        tables, begins, shift = [], [], 0
        for _, _, _, starts, rank, hard in held:
            end, succ, natural = successors(rank, limit, overlap, hard)
            tables.append((end, natural, shift, succ))
            begins.append(shift)
            shift += len(rank)
        every = reached(np.concatenate([succ + s for _, _, s, succ in tables]), np.array(begins))
        for (i, text, n, starts, rank, hard), (end, natural, s, _) in zip(held, tables):
            mine = every[np.searchsorted(every, s) : np.searchsorted(every, s + len(rank))] - s
            yield i, [(int(a), int(end[a]), int(starts[a]), int(starts[end[a]]), bool(natural[a])) for a in mine], n

    def checked() -> Iterator[tuple[int, list[tuple[int, int, int, int, bool]], int]]:
        nonlocal held
        # A piece cut inside a word may take more tokens by itself than it had in the text: then hard cuts come earlier.
        while held:
            again = []
            for (i, text, n, starts, rank, hard), (_, cuts, _) in zip(held, list(solve())):
                loose = [text[c:d] for k, (a, b, c, d, natural) in enumerate(cuts) if not natural or rank[a] < WORD]
                if loose and max(len(x) for x in encode(loose, path)) > limit:
                    if hard <= 1:
                        raise ValueError(f"a piece of text {i} has more than {limit} tokens however it is cut")
                    again.append((i, text, n, starts, rank, max(1, hard - max(1, limit // 32))))
                else:
                    yield i, cuts, n
            held = again

    # A token has at least one byte: a text of no more bytes than the limit needs no counting.
    long = [i for i, text in enumerate(texts) if text and (len(text) > limit or len(text.encode("utf-8", "replace")) > limit)]
    for i, ids in zip(long, encode([texts[i] for i in long], path)):
        if len(ids) > limit:
            text = texts[i]
            raw = text.encode("utf-8", "replace")
            starts, clean = char_offsets(ids, raw, path)
            held.append((i, text, len(ids), starts, boundary_ranks(text, starts, clean), limit))
            size += len(ids)
        if size > 2_000_000:
            yield from checked()
            held, size = [], 0
    yield from checked()


def split_texts(df: DataFrame, *, id: str, text: str, limit: int = 512, overlap: int = 64, with_text: bool = True, path: str = BYTE_RANKS) -> DataFrame:
    """(id, piece_no, first_token, end_token, first_char, end_char, natural_end, n_tokens[, piece]) of each text of more than limit tokens.

    Pieces have at most limit tokens and cover the text without gaps; each after the first repeats the last overlap
    tokens of the piece before, or fewer so as to start at a boundary. natural_end tells whether a piece ends at a
    paragraph, sentence, line or word. Texts within the limit, null and empty ones give no rows. Only a text without
    any white space for most of a limit is cut inside a word, never inside a character; a piece so cut that takes more
    than limit tokens by itself is cut earlier, and if no cut helps (a character of more tokens than the limit), an
    error is raised. Repeated rows give their pieces each time. n_tokens is the number of tokens of the whole text. Other columns aren't read.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half of the limit")
    kind = dict(df.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_batches(whole, "t"):
                texts = b.column("t").to_pylist()
                rows: list[list] = [[] for _ in range(9)]
                for i, cuts, n in pieces(texts, limit, overlap, path):
                    for k, (a, z, c, d, natural) in enumerate(cuts):
                        for column, x in zip(rows, (i, k + 1, a, z, c, d, natural, n, texts[i][c:d] if with_text else None)):
                            column.append(x)
                arrays = [b.column("i").take(pa.array(rows[0], pa.int32())), *[pa.array(rows[j], pa.int32()) for j in (1, 2, 3, 4, 5)], pa.array(rows[6], pa.bool_()), pa.array(rows[7], pa.int32())]
                names = [id, "piece_no", "first_token", "end_token", "first_char", "end_char", "natural_end", "n_tokens"]
                if with_text:
                    arrays, names = [*arrays, pa.array(rows[8], pa.string())], [*names, "piece"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"`{id}` {kind}, piece_no int, first_token int, end_token int, first_char int, end_char int, natural_end boolean, n_tokens int" + ", piece string" * with_text
    return df.selectExpr(f"`{id}` as i", f"`{text}` as t").mapInArrow(run, schema)
