"""Cutting oversized texts into pieces at their own boundaries.

A text is a tree: sections by headings, in them blocks (paragraphs, marked-up blocks), list items, lines, sentences, words.
Neighbouring subtrees are merged from the bottom up as long as they fit together; only a node that is too large by itself
is entered. Sizes are tokens of the encoder, counted once for the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.tokens import VOCABULARY, encoder, slices, spread, vocabulary

EOL = r"(?:\r\n|[\n\r\x85\u2028\u2029])"
#: Where nodes begin, from the coarsest to the finest kind: a match's end, or its start for what opens a node.
LEVELS = [
    re.compile(r"^\#[ \t]+\S|<h1\b", re.M | re.I),
    re.compile(r"^\#\#[ \t]+\S|<h2\b", re.M | re.I),
    re.compile(r"^\#{3,6}[ \t]+\S|<h[3-6]\b|^[A-Z][A-Z0-9 ,&/()-]{3,79}$|^(?:Section|Part|Article|Chapter)[ \t]+[\dIVX]+\b", re.M),
    re.compile(rf"{EOL}[ \t]*{EOL}\s*|(?=<(?:p|div|table|section|ul|ol)\b)"),
    re.compile(r"^[ \t]*(?:[-*•]|\(?\d{1,3}[.)]|\(?[a-z][.)])[ \t]+\S|<(?:li|tr)\b", re.M),
    re.compile(rf"{EOL}\s*"),
    re.compile(r"[.!?…][\"')\]”’]*\s+|[。！？।؟۔]\s*"),
    re.compile(r"[,;:、，；]\s+|[、，；]"),
]
OPENS = {0, 1, 2, 4}  # kinds whose nodes begin where the match begins


def token_starts(text: str, sizes: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(first character, whether it begins there) of each token; a token may begin inside a character."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begin = np.cumsum(sizes[ids]) - sizes[ids]
    lead = (raw & 0xC0) != 0x80
    chars = np.cumsum(lead) - 1
    return chars[begin], lead[begin]


def boundaries(text: str, starts: np.ndarray, clean: np.ndarray) -> list[list[int]]:
    """Of each level, the tokens at which its nodes begin; last, every token that begins a character."""
    out, n = [], len(starts)
    at = starts.tolist()
    for level, pattern in enumerate(LEVELS):
        found = set()
        for m in pattern.finditer(text):
            pos = m.start() if level in OPENS else m.end()
            i = bisect_right(at, pos) - 1  # a token often takes a blank along with the word after it
            while i >= 0 and not clean[i]:
                i -= 1
            if text[at[i] : pos].strip():
                i = bisect_left(at, pos)
                while i < n and not clean[i]:
                    i += 1
            if 0 < i < n:
                found.add(i)
        out.append(sorted(found))
    words = [i for i in np.flatnonzero(clean).tolist() if i and text[at[i]].isspace()]
    return [*out, words, np.flatnonzero(clean).tolist()]


def packed(n: int, marks: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token spans [lo, hi) that follow one another: the first of at most ``limit`` tokens, the others ``limit - overlap``."""
    room = lambda lo: limit if lo == 0 else limit - overlap
    done: list[tuple[int, int]] = []

    def put(lo: int, hi: int) -> None:
        """A subtree that fits joins the siblings before it if they fit together."""
        if done and hi - done[-1][0] <= room(done[-1][0]):
            done[-1] = (done[-1][0], hi)
        else:
            done.append((lo, hi))

    todo = [(0, n, 0)]  # nodes still to come, the next one last
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= room(lo):
            put(lo, hi)
            continue
        while level < len(marks):
            own = marks[level]
            inner = own[bisect_left(own, lo + 1) : bisect_left(own, hi)]
            if inner:
                break
            level += 1
        if level >= len(marks):  # nothing inside where it could be cut: whole, should a single character be that long
            put(lo, hi)
            continue
        edges = [lo, *inner, hi]
        todo.extend((a, b, level + 1) for a, b in reversed(list(zip(edges, edges[1:]))))
    return done


def pieces_of(text: str, enc, sizes: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, body, end, tokens) in characters of each piece of a text that is too large; no pieces of others.

    ``[body, end)`` of the pieces put together are the text; ``[start, body)`` is repeated from the piece before.
    """
    ids = enc.encode_ordinary(text)
    n = len(ids)
    if n <= limit:
        return []
    starts, clean = token_starts(text, sizes, ids)
    marks = boundaries(text, starts, clean)
    out, before = [], 0
    char = lambda i: int(starts[i]) if i < n else len(text)
    for lo, hi in packed(n, marks, limit, overlap):
        own = max(before, lo - overlap) if lo else 0
        while own < lo and not clean[own]:
            own += 1
        # cut out by itself, a piece may be split into words in another way; then it repeats less
        while own < lo and len(enc.encode_ordinary(text[char(own) : char(hi)])) > limit:
            own = min(lo, own + 8)
            while own < lo and not clean[own]:
                own += 1
        out.append((char(own), char(lo), char(hi), len(enc.encode_ordinary(text[char(own) : char(hi)]))))
        before = own
    return out


def split_oversized(docs: DataFrame, id_column: str, text_column: str, limit: int = 1024, overlap: int = 64, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(id, piece, pieces, start_char, body_char, end_char, n_tokens, text) of the texts of more than ``limit`` tokens.

    Pieces count from 0 and have at most ``limit`` tokens. Cuts are at the coarsest boundary there is: sections, blocks,
    list items, lines, sentences, clauses, words, and only then between characters. A piece after the first begins with
    the last ``overlap`` tokens of the one before (``[start_char, body_char)``), or fewer where a character or a word
    asks for it. Bodies put together are the text. Texts within the limit, empty and null ones give no rows; rows with
    a null id are left out; repeated texts are each cut. Other columns play no part.

    Scale: nothing is shuffled. A text of n bytes has at most n tokens, so short texts are dropped before they reach
    Python; each other text is handled whole in one task, in time that grows as its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    kind = docs.schema[id_column].dataType.simpleString()
    long = spread(docs.select(F.col(f"`{id_column}`").alias("d"), F.col(f"`{text_column}`").alias("t")).where(F.col("d").isNotNull() & (F.octet_length("t") > limit)), "d")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        enc = encoder(ranks)
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            sizes[i] = len(piece)
        for b in slices(batches, 128):
            which, rows = [], []
            for i, t in enumerate(b["t"].to_pylist()):
                found = pieces_of(t, enc, sizes, limit, overlap)
                which += [i] * len(found)
                rows += [(k, len(found), *p, t[p[0] : p[2]]) for k, p in enumerate(found)]
            cols = [pa.array([r[j] for r in rows], pa.int32()) for j in range(6)]
            yield pa.RecordBatch.from_arrays([b["d"].take(pa.array(which, pa.int64())), *cols, pa.array([r[6] for r in rows], pa.string())], names=["d", "piece", "pieces", "start_char", "body_char", "end_char", "n_tokens", "text"])

    out = long.mapInArrow(cut, f"d {kind}, piece int, pieces int, start_char int, body_char int, end_char int, n_tokens int, text string")
    return out.withColumnRenamed("d", id_column)
