"""Which texts of a corpus contain passages of held-out items.

Patterns of one Aho-Corasick automaton are blocks of half the wanted number of words, at every such step of an item: every
run of the wanted number holds one of them whole. A hit is extended word by word to both sides along the item and counts if
it is long enough, so nothing is lost or added by the shorter patterns. Both sides are normalised to words; a word of the
items is two characters, of alphabets of their own, so that no node of the automaton has many branches and no match begins
inside a word; every other word is two that no pattern has. A text is scanned once, whatever the number of items. Hits carry the word's place in the original text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.tokens import slices, spread

WORD, ASCII_WORD = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
#: Characters of the alphabets: code points from 1 on, without the surrogates; 0 stands for words of no item.
LOW, SURROGATES = 1, (0xD800, 0xE000)
#: Characters of a word; the one for words of no item; and one that no text gets.
WIDE, OTHER, NEVER = 2, "\0\0", "\U0010ffff"
#: Characters and distinct words of the items that one automaton takes; more items are scanned for in several passes.
ITEM_CHARS, ITEM_WORDS = 8_000_000, 1_000_000


def normal_words(text: str) -> list[str]:
    """Unbroken runs of letters and digits, without letter case."""
    return ASCII_WORD.findall(text.lower()) if text.isascii() else [w.casefold() for w in WORD.findall(text)]


def letter(n: int) -> str:
    """The n-th character of the alphabet."""
    c = LOW + n
    return chr(c if c < SURROGATES[0] else c + SURROGATES[1] - SURROGATES[0])


def word_codes(words: Iterable[str], base: int) -> dict[str, str]:
    """Each word as a character of the first alphabet, of ``base`` characters, and one of the second."""
    return {w: letter(n % base) + letter(base + n // base) for n, w in enumerate(words)}


@dataclass
class Machine:
    """What finds the items in texts: built once, sent to the workers as it is, loaded once in each."""

    run: int
    alphabet: dict[str, str]
    #: items as texts of the alphabet
    coded: list[tuple[int, str]]
    #: of each pattern the (item's place in ``coded``, word in it) where it stands; None if no item is long enough
    automaton: object

    @property
    def block(self) -> int:
        return block_of(self.run)


def block_of(run: int) -> int:
    """Words of a pattern: blocks of so many at every such step, of which every ``run`` words in a row hold one whole."""
    return (run + 1) // 2


def built(items: list[tuple[int, str]], run: int) -> Machine:
    """The machine for (id, text) of items that have ITEM_WORDS distinct words at most."""
    import ahocorasick

    long = [(i, words) for i, text in items if len(words := normal_words(text)) >= run]
    distinct = dict.fromkeys(w for _, words in long for w in words)
    base = math.isqrt(len(distinct)) + 1
    alphabet = word_codes(distinct, base)
    coded: list[tuple[int, str]] = []
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    step = block_of(run)
    for item, words in long:
        one = "".join([alphabet[w] for w in words])
        for i in range(0, len(words) - step + 1, step):
            places[one[WIDE * i : WIDE * (i + step)]].append((len(coded), i))
        coded.append((item, one))
    a = ahocorasick.Automaton()
    # the root looks its branches up in the order in which they came: first what begins no pattern but stands in every text
    for c in [OTHER[0], *map(letter, range(base, base + len(distinct) // base + 1))]:
        a.add_word(c + NEVER, ())
    for pattern, where in places.items():
        a.add_word(pattern, tuple(where))
    if places:
        a.make_automaton()
    return Machine(run, alphabet, coded, a if places else None)


def stretches(words: str, m: Machine) -> list[tuple[int, int, int]]:
    """(item, first word, last word) of each stretch of a coded text that is unbroken runs of an item."""
    seen: dict[tuple[int, int], int] = {}  # by item and its shift against the text, the last word that is known to agree
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    n = len(words) // WIDE
    at_word = lambda t, i: t[WIDE * i : WIDE * (i + 1)]
    for end, where in m.automaton.iter(words):
        last = end // WIDE
        first = last - m.block + 1
        for which, at in where:
            shift = first - at
            if seen.get((which, shift), -1) >= last:
                continue
            item, one = m.coded[which]
            lo, hi, size = first, last, len(one) // WIDE
            while lo > 0 and lo - 1 >= shift and at_word(words, lo - 1) == at_word(one, lo - 1 - shift):
                lo -= 1
            while hi + 1 < n and hi + 1 - shift < size and at_word(words, hi + 1) == at_word(one, hi + 1 - shift):
                hi += 1
            seen[which, shift] = hi
            if hi - lo + 1 >= m.run:
                runs[item].append((lo, hi))
    out = []
    for item, parts in runs.items():
        parts.sort()
        lo, hi = parts[0]
        for a, b in parts[1:]:
            if a + m.run - 1 <= hi + 1:  # its first run ends right after one that is in already
                hi = max(hi, b)
            else:
                out.append((item, lo, hi))
                lo, hi = a, b
        out.append((item, lo, hi))
    return out


def spans(text: str, m: Machine) -> list[tuple[int, int, int, int]]:
    """(item, start, end, words) of each stretch of the text that is unbroken runs of an item; offsets are of characters."""
    get = m.alphabet.get
    found = stretches("".join([get(w, OTHER) for w in normal_words(text)]), m)
    if not found:
        return []
    at = [w.span() for w in WORD.finditer(text)]
    return [(item, at[lo][0], at[hi][1], hi - lo + 1) for item, lo, hi in found]


def leaked_spans(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, run: int = 15) -> DataFrame:
    """(doc, item, start_char, end_char, words): each stretch of a text that holds at least ``run`` consecutive words of an item.

    A word is an unbroken run of letters and digits; case, punctuation and spacing don't matter. ``start_char`` and
    ``end_char`` (exclusive) count characters of the original text from 0. Stretches of one item that lie in a text one
    right after the other come as one. Null texts and items, and items of fewer words than ``run``, match nothing; rows
    with null ids are left out. Repeated documents are each reported; empty tables give no rows.

    Scale: nothing is shuffled; a text is read once for every ITEM_CHARS characters (or ITEM_WORDS distinct words) of items.
    The items are held out and few by their purpose. The machine of a block of them is built once, in the driver, and a
    Python worker loads it once for all its tasks; it has two nodes a word at most, and
    takes a worker some 320 MB for a full block.
    """
    spark = docs.sparkSession
    kinds = f"doc {docs.schema[doc_id].dataType.simpleString()}, item bigint, start_char int, end_char int, words int"
    texts = spread(docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where("d is not null and t is not null"), "d")
    held = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null")

    def scanner(block: list[tuple[int, str]]) -> DataFrame:
        m = built(block, run)
        shared = spark.sparkContext.broadcast((m.run, m.alphabet, m.coded, m.automaton))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = Machine(*shared.value)
            for b in slices(batches) if machine.automaton else ():
                rows = [(i, *s) for i, t in enumerate(b["t"].to_pylist()) for s in spans(t, machine)]
                which = pa.array([r[0] for r in rows], pa.int64())
                cols = [pa.array([r[j] for r in rows], pa.int64() if j == 1 else pa.int32()) for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays([b["d"].take(which), *cols], names=["doc", "item", "start_char", "end_char", "words"])

        return texts.mapInArrow(scan, kinds)

    parts: list[DataFrame] = []
    block: list[tuple[int, str]] = []
    chars, distinct = 0, set()
    for r in held.toLocalIterator():  # one block at a time stands in the driver
        more = set(normal_words(r.t)) - distinct
        if block and (chars + len(r.t) > ITEM_CHARS or len(distinct) + len(more) > ITEM_WORDS):
            parts.append(scanner(block))
            block, chars, distinct, more = [], 0, set(), set(normal_words(r.t))
        block.append((r.i, r.t))
        chars += len(r.t)
        distinct |= more
    parts.append(scanner(block))
    return reduce(DataFrame.unionByName, parts)


def leaked_items(*args, **kwargs) -> DataFrame:
    """(doc, item) of ``leaked_spans``, each pair once for each row of the document table that has it."""
    return leaked_spans(*args, **kwargs).select("doc", "item").distinct()
