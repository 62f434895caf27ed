"""Linking the spellings of one organisation or person.

Each distinct spelling is read into a form: distinctive tokens, line of business, legal form. Which words tell a line of
business is a general vocabulary, widened by the words that very many firms of the table have; which of them stand together
is counted in the table. A symmetric-delete index over the distinct tokens finds tokens a small edit apart and gives each the
nearest, most frequent of its neighbours as common token. Forms that share a common token, and the first letter of the other
token, with an anchor (any form that ranks higher; of one token, if both have one only) are aligned with it: tokens are
assigned to each other in the cheapest way, where an edit, an abbreviation or an initial has a cost. Every form takes at most
one parent, the cheapest anchor that ranks higher, so links are as many as forms at most, and entities are the trees that
result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodeworks.sources.shared import settle

# Legal forms, titles, given names and their short forms.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "ltd": "ltd", "limited": "ltd", "llc": "llc", "lp": "lp", "llp": "llp", "plc": "plc", "gmbh": "gmbh",
}
LEGAL_PHRASES = {"limited liability company": "llc", "limited liability partnership": "llp", "limited partnership": "lp"}
TITLES = {"dr", "mr", "mrs", "ms", "prof", "sir", "jr", "sr", "ii", "iii", "esq", "phd", "md"}
FILLERS = {"the", "and", "of", "group", "grp"}
SHORT_NAMES = {
    "alexander": "alex al sandy lex", "alexandra": "alexa lexi", "andrew": "andy drew", "anthony": "tony", "barbara": "barb",
    "benjamin": "ben benny benji", "catherine": "cathy cath", "charles": "charlie chuck", "christina": "tina chrissy",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "donald": "don donny",
    "edward": "ed eddie ned", "elizabeth": "liz beth betty eliza lizzie betsy", "frederick": "fred freddie freddy", "george": "georgie",
    "gregory": "greg gregg", "harold": "hal harry", "henry": "hank", "isabella": "bella isa izzy bel", "jacob": "jake",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "john": "johnny jack", "jonathan": "jon jonny", "joseph": "joe joey",
    "katherine": "kate kathy katie kat kath kay", "kenneth": "ken kenny", "lawrence": "larry laurie lars", "leonard": "len lenny",
    "margaret": "peggy maggie meg marge greta", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat nathan",
    "nicholas": "nick nicky", "oliver": "ollie olly", "patricia": "pat patty trish tricia", "patrick": "paddy", "peter": "pete",
    "philip": "phil", "quentin": "quin quinn quint", "raymond": "ray", "rebecca": "becky becca", "richard": "rick rich dick ricky",
    "robert": "rob bob bobby robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy", "stephen": "steve stevie",
    "susan": "sue susie", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim", "ursula": "ulla uschi",
    "victoria": "vicky vicki tori vic", "vincent": "vince vinny", "william": "bill will billy willy liam", "yolanda": "yoli yola",
    "zachary": "zack zach zac",
}
GIVEN = {s: full for full, short in SHORT_NAMES.items() for s in [full, *short.split()]}
#: Common words of lines of business, of any trade; words that a table's firms have besides are learned from it.
LINE_WORDS = """
accounting advisors aerospace agriculture apparel appliances archive associates automation automotive aviation bank biotech builders
building capital cargo catering cement center chemical cleaning communications components computer computing construction consultants
consulting contracting contractors controls cooling data decommissioning defense dental design development digital distribution
dynamics education electric electrical electronics energy engineering enterprises entertainment environmental equipment express
fabrication fashion federal films finance financial fitness foods forestry foundation freight furniture gas general global government
graphics hardware hauling healthcare heating holdings hospital industrial industries information infrastructure innovations instruments
integration international investments janitorial laboratories labs landscaping leasing legal lighting logistics lumber machinery
maintenance management manufacturing marine marketing masonry materials mechanical media medical metals mining motors moving national
natural network offshore oil packaging painting partners petroleum pharmaceuticals pharmacy plastics plumbing power printing processing
products properties publishing railway realty records recycling rental repair research resources retail robotics safety salvage
scientific security services shipping software solar solutions steel storage supply systems technical technologies technology telecom
towing trading training transport transportation travel trucking utilities warehousing waste welding wholesale works
""".split()
#: A word is learned if it stands in this share of all distinct spellings, and in LEARNED_LEAST of them, mostly along with a legal
#: form; a phrase of such words if it stands in the smaller share. So words are at most tokens a spelling / LEARNED_SHARE.
LEARNED_SHARE, LEARNED_LEAST, PHRASE_SHARE = 0.01, 20, 0.0005
ALIAS = re.compile(r"[\s,(]+(?:d\s?/\s?b\s?/\s?a|dba|d\.b\.a\.|f/k/a|fka|a/k/a|aka|doing business as|formerly known as)\b\.?[\s,:]*")
LEET = str.maketrans({"0": "o", "3": "e", "5": "s"})
FORM = "a string, b string, mid string, biz string, legal string"

#: Different anchors of a key that one task compares with the key's forms; more are spread over blocks.
CROWD = 5_000

#: Costs of aligned tokens, and what two tokens together may cost.
TYPO, TWO_TYPOS, ABBREVIATED, INITIAL, MOST = 0.5, 1.0, 1.0, 1.5, 2.5


def osa(a: str, b: str, most: int = 2) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def shortened(s: str, whole: str) -> bool:
    """``s`` abbreviates ``whole``: its beginning, or the first letter and further letters in order."""
    if len(s) < 2 or len(s) >= len(whole) or s[0] != whole[0]:
        return False
    rest = iter(whole)
    return all(c in rest for c in s)


def _skeleton(w: str) -> str:
    return w[:1] + re.sub("[aeiou]", "", w[1:])


def token_cost(x: str, y: str) -> float | None:
    """Cost of taking ``x`` and ``y`` for one word; None if they aren't."""
    if x == y:
        return 0.0
    if not x or not y:
        return None
    s, w = sorted((x, y), key=len)
    if len(s) == 1:
        return INITIAL if w[0] == s else None
    if len(s) >= 4:
        d = osa(s, w)
        if d == 1 or d == 2 and len(w) >= 6:
            return TYPO if d == 1 else TWO_TYPOS
    if len(s) >= 3 and (w.startswith(s) or s == _skeleton(w)):
        return ABBREVIATED
    if len(s) >= 4 and (osa(s, w[: len(s)], 1) <= 1 and s[0] == w[0] and len(s) <= len(w) - 2 or osa(s, _skeleton(w), 1) <= 1 and s == _skeleton(s)):
        return ABBREVIATED + TYPO
    return None


def abbreviates(token: str, word: str) -> bool:
    """``token`` is a short way to write ``word``: its beginning, its consonants or some letters after the same first three."""
    if not 3 <= len(token) <= min(7, len(word) - 2) or token[0] != word[0]:
        return False
    if word.startswith(token):
        return True
    bare = token == _skeleton(token) or token[:-1] == _skeleton(token[:-1])
    return (word[:3] == token[:3] or bare and len(token) >= 0.35 * len(_skeleton(word))) and shortened(token, word)


class Lines:
    """Words of lines of business with the number of spellings that have them, and phrases of them with theirs.

    Where a table's words are given, a token abbreviates only such as stand in it somewhere.
    """

    def __init__(self, words: Iterable[tuple[str, int]] | None = None, phrases: Iterable[tuple[tuple[str, ...], int]] = ()):
        counts = dict(words or ())
        self.words = {w: 0 for w in LINE_WORDS} | counts
        self.phrases = {frozenset(p): n for p, n in phrases if len(p) > 1}
        self.initials = {"".join(sorted(w[0] for w in p)) for p in self.phrases}
        self._first: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.words if words is None else counts):
            self._first[w[0]].append(w)
        self._within: dict[str, list[frozenset[str]]] = defaultdict(list)
        for p in self.phrases:
            for w in p:
                self._within[w].append(p)
        self._read: dict[str, list[str]] = {}

    def words_for(self, token: str) -> list[str]:
        """The words that the token is or abbreviates."""
        if token in self.words:
            return [token]
        if len(token) < 3 or token in FILLERS:
            return []
        if token not in self._read:
            same = self._first.get(token[0], [])
            short = [w for w in same if abbreviates(token, w)]
            self._read[token] = short or [w for w in same if len(token) >= 6 and osa(token, w, 1) == 1]
        return self._read[token]

    def line(self, options: list[list[str]]) -> str:
        """One line of business of words that may each be read in several ways: the most frequent phrase that they can be, or
        of each the most frequent word."""
        sure = {o[0] for o in options if len(o) == 1}
        open_ = [o for o in options if len(o) > 1]
        if open_:
            start = [next(iter(sure))] if sure else open_[0]
            fits = {p for w in start for p in self._within.get(w, ()) if sure <= p and len(p) <= len(options) and all(p & set(o) for o in open_)}
            if fits:
                return " ".join(sorted(max(fits, key=lambda p: (self.phrases[p], sorted(p)))))
            sure |= {max(o, key=lambda w: (self.words[w], w)) for o in open_}
        return " ".join(sorted(sure))


PLAIN = Lines()


def _read_part(text: str, lines: Lines) -> tuple[list[str], str, str]:
    """(other tokens, line of business, legal form) of one name without its alias."""
    text = re.sub(r"\b([a-z])\.\s?(?=[a-z]\b)", r"\1", text.replace("&", " and ").replace("'", ""))
    legal = ""
    for phrase, form in LEGAL_PHRASES.items():
        if phrase in text:
            text, legal = text.replace(phrase, " "), form
    tokens = [t.translate(LEET) if re.search("[a-z]", t) else t for t in re.findall(r"[^\W_]+", text)]
    rest = []
    for t in tokens:
        if t in LEGAL and (len(tokens) > 1):
            legal = legal or LEGAL[t]
        elif t not in TITLES or len(tokens) <= 2 and t in ("md",):
            rest.append(t)
    kept, words = [], []
    for t in rest:
        w = lines.words_for(t) if t not in GIVEN else []
        if w:
            words.append(w)
        elif t not in FILLERS:
            kept.append(t)
    biz = lines.line(words) if words else ""
    if not biz and len(kept) > 1:
        known = [t for t in kept if len(t) > 1 and "".join(sorted(t)) in lines.initials]
        two = [t for t in kept if len(t) == 2 and t.isalpha() and legal and (len(kept) > 2 or max(map(len, kept)) >= 8)]
        if (known and (legal or len(kept) > 2)) or two:
            told = known[-1] if known and (legal or len(kept) > 2) else two[-1]
            biz = "." + "".join(sorted(told))
            kept.remove(told)
    return kept, biz, legal


def read_name(name: str | None, lines: Lines = PLAIN) -> tuple[str, str, str, str, str] | None:
    """(a, b, mid, biz, legal) of a spelling; None if it has no letter or digit.

    ``a`` and ``b`` are the distinctive tokens in alphabetical order, for persons given name and surname; ``b`` is empty if
    there is one token only (as when two were run together). Of more tokens ``b`` holds all but the first, in order, joined by blanks.
    ``biz`` is the words of the line of business in order, or a dot and the initials of such words.
    """
    if name is None:
        return None
    s = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    s = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", s).casefold().strip()
    main, *alias = ALIAS.split(" " + s, maxsplit=1)
    kept, biz, legal = _read_part(main, lines)
    if alias:
        other, biz2, _ = _read_part(alias[0], lines)
        biz = biz or biz2
        kept = kept or other
    if not kept:  # nothing but words of lines of business: they are the name
        first, *more = sorted(t for t in re.findall(r"[^\W_]+", main) if t not in LEGAL) or sorted(re.findall(r"[^\W_]+", s)) or [""]
        return (first, " ".join(more), "", "", legal) if first else None
    mid = ""
    if not biz and not legal:
        kept = [x for t in kept for x in (list(t) if len(t) == 2 and len(kept) == 2 and t not in GIVEN else [t])]
        if len(kept) == 3 and sum(len(t) == 1 for t in kept):
            one = [t for t in kept if len(t) == 1]
            long = [t for t in kept if len(t) > 1]
            if len(long) == 2:
                kept, mid = long, one[0]
            elif len(long) == 1:
                kept, mid = [one[0], long[0]], one[1]
    if len(kept) == 2 and not biz and not legal:
        x, y = kept
        if y in GIVEN and x not in GIVEN or len(y) == 1 < len(x):
            x, y = y, x
        if x in GIVEN or len(x) == 1:
            return GIVEN.get(x, x), y, mid, "", ""
    a, *more = sorted(kept)
    return a, " ".join(more), mid, biz, legal


def _lines_agree(x: str, y: str) -> bool:
    """Two lines of business can be one: one isn't told, one has all words of the other, or one is the other's initials."""
    if not x or not y or x == y:
        return True
    if x[0] == "." or y[0] == ".":
        short, whole = (x, y) if x[0] == "." else (y, x)
        letters = [w[0] for w in whole.split()]
        return short[1:] in ("".join(sorted(letters)), "".join(sorted([*letters, "g"])))  # a group's letter may be among them
    p, q = set(x.split()), set(y.split())
    return p < q or q < p


def assigned(costs: list[list[float]]) -> list[int]:
    """The column of each row in the cheapest assignment; rows are at most as many as columns (Hungarian method)."""
    n, m = len(costs), len(costs[0])
    u, v, row, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row[0], j = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while row[j]:
            used[j], at, step, to = True, row[j], float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    c = costs[at - 1][k - 1] - u[at] - v[k]
                    if c < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < step:
                        step, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row[k]], v[k] = u[row[k]] + step, v[k] - step
                else:
                    least[k] -= step
            j = to
        while j:
            row[j], j = row[way[j]], way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row[k]:
            out[row[k] - 1] = k - 1
    return out


def _list_cost(p: list[str], q: list[str], mid: str) -> float | None:
    """Cost of two lists of two or more tokens, one of them longer than two; tokens left over cost one abbreviation together.

    ``mid`` is the middle initial of the shorter list, which one of the tokens left over must bear out.
    """
    same = Counter(p) & Counter(q)
    if min(len(p), len(q)) - same.total() > MOST / TYPO:
        return None
    never = 1e6
    costs = [[never if (c := token_cost(s, t)) is None else c for t in q] for s in p]
    to = assigned(costs)
    paid = [costs[i][j] for i, j in enumerate(to)]
    over = [t for j, t in enumerate(q) if j not in set(to)]
    if mid and over and not any(t[0] == mid for t in over):
        return None
    total = sum(paid) + (ABBREVIATED if over else 0.0)
    return total if total <= MOST and min(paid) < ABBREVIATED else None


def _run_together(one: str, tokens: list[str]) -> float | None:
    """Cost of taking ``one`` for three or more tokens without blanks, in any order: up to two edits, or all but one exact."""
    if len(one) < 8:
        return None
    best: float | None = None
    if abs(len(one) - sum(map(len, tokens))) <= 2:
        todo = [("", tuple(tokens))]
        seen = set(todo)
        while todo:
            head, rest = todo.pop()
            if not rest:
                if (d := osa(one, head, 2)) <= 2:
                    best = min(0.25 + TYPO * d, best if best is not None else 9.0)
                continue
            for i, t in enumerate(rest):
                step = (head + t, rest[:i] + rest[i + 1 :])
                if step not in seen and any(osa(step[0], one[: max(0, len(step[0]) + k)], 2) <= 2 for k in range(-2, 3)):
                    seen.add(step)
                    todo.append(step)
    if best is None:
        ends = [(one, tuple(tokens))]
        seen = set(ends)
        while ends:
            left, rest = ends.pop()
            if len(rest) == 1:
                if len(left) >= 3 and (c := token_cost(left, rest[0])) is not None:
                    best = min(0.25 + c, best if best is not None else 9.0)
                continue
            for i, t in enumerate(rest):
                for cut in ([left[len(t) :]] if left.startswith(t) else []) + ([left[: -len(t)]] if left.endswith(t) else []):
                    step = (cut, rest[:i] + rest[i + 1 :])
                    if step not in seen:
                        seen.add(step)
                        ends.append(step)
    return best


def form_cost(x: tuple[str, ...], y: tuple[str, ...]) -> float | None:
    """Cost of taking two forms for one entity, by the cheapest assignment of their tokens; None if they can't be."""
    if not _lines_agree(x[3], y[3]) or x[4] and y[4] and x[4] != y[4] or x[2] and y[2] and x[2] != y[2]:
        return None
    if x[0] in SHORT_NAMES and y[0] in SHORT_NAMES and x[0] != y[0] and not (x[3] or y[3]):
        return None
    loss = 0.1 * (bool(x[3]) != bool(y[3])) + 0.1 * (bool(x[4]) != bool(y[4]))
    p, q = [x[0], *x[1].split()], [y[0], *y[1].split()]
    best: float | None = None
    if min(len(p), len(q)) > 1 and max(len(p), len(q)) > 2:
        best = _list_cost(p, q, x[2]) if len(p) <= len(q) else _list_cost(q, p, y[2])
    elif max(len(p), len(q)) > 2:
        best = _run_together(p[0], q) if len(p) == 1 else _run_together(q[0], p)
    elif len(p) == len(q):
        for order in permutations(q):
            costs = [token_cost(s, t) for s, t in zip(p, order)]
            if None not in costs and (len(p) == 1 and sum(costs) <= TWO_TYPOS or len(p) == 2 and sum(costs) <= MOST and min(costs) < ABBREVIATED):
                best = min(sum(costs), best if best is not None else 9.0)
    elif 0 < len(p) and 0 < len(q):
        one, two = (p[0], q) if len(p) == 1 else (q[0], p)
        for order in permutations(two):
            d = osa(one, "".join(order), 2)
            if len(one) >= 8 and d <= 2:
                best = min(0.25 + TYPO * d, best if best is not None else 9.0)
            for cut in (range(3, len(one) - 3) if len(one) >= 8 and d > 2 else ()):
                costs = [token_cost(one[:cut], order[0]), token_cost(one[cut:], order[1])]
                if None not in costs and min(costs) == 0:
                    best = min(0.25 + sum(costs), best if best is not None else 9.0)
    return None if best is None else best + loss


def _reader(lines: Lines) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            read = [(n, *f) for n in df["name"] if (f := read_name(n, lines))]
            yield pd.DataFrame(read, columns=["name", "a", "b", "mid", "biz", "legal"], dtype=object)

    return read_all


def learned_lines(spellings: DataFrame, n: int) -> Lines:
    """What the ``n`` distinct spellings (name) say of lines of business; the words and phrases that reach the driver are so many at most as
    the shares allow."""
    tokens = F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"))
    rows = spellings.select(tokens.alias("ts"), F.arrays_overlap(tokens, F.array(*map(F.lit, LEGAL))).alias("legal"))
    heard = rows.select(F.explode("ts").alias("w"), "legal").where(F.length("w") >= 3).groupBy("w").agg(F.count("*").alias("n"), F.avg(F.col("legal").cast("int")).alias("firms"))
    apart = [*LEGAL, *FILLERS, *TITLES, *GIVEN, "limited", "liability", "partnership", "doing", "business", "dba", "fka", "aka", "formerly", "known"]
    often = (F.col("n") >= F.greatest(F.lit(LEARNED_SHARE * n), F.lit(LEARNED_LEAST))) & (F.col("firms") >= 0.5) & ~F.col("w").isin(apart)
    words = {r.w: r.n for r in heard.where(often | F.col("w").isin(LINE_WORDS)).select("w", "n").collect()}
    # what abbreviates a more frequent word is no word of its own
    words = {w: k for w, k in words.items() if w in LINE_WORDS or not any(m > k and (abbreviates(w, v) or len(w) >= 6 and osa(w, v, 1) == 1) for v, m in words.items())}
    if not words:
        return Lines([])
    told = F.array_sort(F.array_intersect("ts", F.array(*map(F.lit, sorted(words)))))
    phrases = rows.select(told.alias("p")).where(F.size("p") > 1).groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= max(PHRASE_SHARE * n, 2)).collect()
    return Lines(list(words.items()), [(tuple(r.p), r.n) for r in phrases])


@F.pandas_udf(DoubleType())
def _cost(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
    return pd.Series([form_cost(p, q) for p, q in zip(x.itertuples(index=False, name=None), y.itertuples(index=False, name=None))], dtype="float64")


def _deletes(token: Column) -> Column:
    """The token, and the token without each of its letters."""
    without = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.array_distinct(F.concat(F.array(token), without))


def common_tokens(tokens: DataFrame, rounds: int = 2) -> DataFrame:
    """(token, common) of (token, f): of the tokens a small edit away that are more frequent the nearest, among those the most
    frequent; else itself.

    Every two tokens of a delete key are compared. A key has the tokens that one letter more makes of it, so at most its
    length times the letters there are, however large the table. ``rounds`` of following common tokens of common tokens end chains.
    """
    keys = tokens.where(F.length("token") >= 4).withColumn("key", F.explode(_deletes(F.col("token"))))
    other = keys.select("key", F.col("token").alias("t"), F.col("f").alias("g"))
    edits = F.levenshtein("token", "t", 2)
    near = keys.join(other, "key").where(F.struct("g", "t") > F.struct("f", "token")).withColumn("edits", edits).where(F.col("edits").between(1, F.when(F.length("token") >= 6, 2).otherwise(1)))
    best = near.groupBy("token").agg(F.max(F.struct(-F.col("edits"), "g", "t")).alias("m")).select("token", F.col("m.t").alias("common"))
    links = settle(tokens.join(best, "token", "left").select("token", F.coalesce("common", "token").alias("common")), "tokens")
    for _ in range(rounds):
        links = links.join(links.select(F.col("token").alias("common"), F.col("common").alias("next")), "common").select("token", F.col("next").alias("common"))
    return links


def _told(biz: str) -> Column:
    """The line of business stands in words."""
    return (F.col(biz) != "") & ~F.startswith(F.col(biz), F.lit("."))


def _listed(a: str = "a", b: str = "b") -> Column:
    """The distinctive tokens of a form, as an array."""
    return F.concat(F.array(a), F.when(F.col(b) != "", F.split(b, " ")).otherwise(F.array().cast("array<string>")))


def _probes(forms: DataFrame, common: DataFrame) -> DataFrame:
    """(id, key, stands): where a form is looked for: under a common token and the first letter of the other token.

    A form of one token stands under its common token, where those of one token meet; of tokens that were run together every
    cut is tried too, and under those it doesn't stand as an anchor (``stands``).
    """
    pair = lambda t, o: F.struct(t.alias("token"), F.substring(o, 1, 1).alias("first"))
    a, b, several = F.col("a"), F.col("b"), _listed()
    head, rest = lambda i: F.substring(a, F.lit(1), i), lambda i: F.substring(a, i + 1, F.length(a))
    cuts = F.flatten(F.transform(F.sequence(F.lit(3), F.length(a) - 3), lambda i: F.array(pair(head(i), rest(i)), pair(rest(i), head(i)))))
    both_ways = F.flatten(F.transform(several, lambda t, i: F.array_distinct(F.transform(F.filter(several, lambda o, j: j != i), lambda o: pair(t, o)))))
    asked = forms.select("id", (b != "").alias("stands"), F.explode(F.when(b != "", both_ways).when(F.length(a) >= 8, cuts)).alias("p")).select("id", "stands", "p.token", "p.first").where(F.length("token") >= 3)
    paired = asked.join(common, "token").select("id", F.concat_ws("|", "common", "first").alias("key"), "stands").distinct()
    single = forms.where(b == "").select("id", a.alias("token")).join(common, "token", "left").select("id", F.concat_ws("|", F.coalesce("common", "token"), F.lit("")).alias("key"), F.lit(True).alias("stands"))
    return paired.unionByName(single)


def _may_agree(x: str, y: str) -> Column:
    """False only where ``form_cost`` has no cost whatever the tokens are: told things differ, or given names do."""
    of = lambda c: (F.col(f"{x}.{c}"), F.col(f"{y}.{c}"))
    open_ = lambda p, q: (p == "") | (q == "") | (p == q)
    p, q = of("biz")
    within = lambda s, w: F.size(F.array_except(F.split(s, " "), F.split(w, " "))) == 0
    given, other = of("a")
    people = given.isin(*SHORT_NAMES) & other.isin(*SHORT_NAMES) & (given != other) & (p == "") & (q == "")
    return open_(*of("legal")) & open_(*of("mid")) & ~people & (open_(p, q) | F.startswith(p, F.lit(".")) | F.startswith(q, F.lit(".")) | within(p, q) | within(q, p))


def _met(asked: DataFrame, anchors: DataFrame) -> DataFrame:
    """Forms (id, key, rank, form) with every higher-ranking anchor (key, to_rank, to_form) of a key that may agree.

    Anchors of a key beyond CROWD are spread over blocks, each of which meets all forms of the key, so that a crowded key is
    shared by many tasks; no pair is left out.
    """
    most = max(CROWD, 1)
    crowded = anchors.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    left = asked.join(crowded, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    right = anchors.join(crowded, "key", "left").withColumn("block", F.pmod(F.xxhash64("to_rank.id"), blocks).cast("int")).drop("blocks")
    return left.join(right, ["key", "block"]).where((F.col("to_rank") > F.col("rank")) & _may_agree("form", "to_form"))


def linked_forms(forms: DataFrame) -> DataFrame:
    """(id, root) of forms (id, a, b, mid, biz, legal, f); a root stands for an entity."""
    tokens = forms.select(F.explode(_listed()).alias("token"), "f").where(F.length("token") >= 3).groupBy("token").agg(F.sum("f").alias("f"))
    common = settle(common_tokens(tokens), "common")
    whole = (F.col("b") != "") & F.forall(_listed(), lambda t: F.length(t) >= 4)
    clean = -F.col("unclean")
    weight = F.struct(((F.col("b") != "").cast("int") * 8 + (F.col("biz") != "").cast("int") * 4 + _told("biz").cast("int") * 2 + (F.col("legal") != "").cast("int") + whole.cast("int") * 16).alias("told"), clean.alias("clean"), "f", (F.length("a") + F.length("b")).alias("long"), "id")
    spelled = forms.select("id", F.explode(_listed()).alias("token")).join(common, "token", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.coalesce("common", "token"))).alias("commons"), F.sum(F.coalesce((F.col("common") != F.col("token")).cast("int"), F.lit(0))).alias("unclean"))
    named = forms.join(spelled, "id")
    ranked = settle(named.withColumn("rank", weight).withColumn("form", F.struct("a", "b", "mid", "biz", "legal")), "ranked")
    probes = settle(_probes(forms, common), "probes")
    kept = ranked.select("id", "rank", "form")
    # Anchors: of a key and entity-like group of forms, only the highest-ranking stands for the others.
    anchors = probes.where("stands").join(ranked, "id")
    anchors = settle(anchors.groupBy("key", "commons", "mid", "biz", "legal").agg(F.max(F.struct("rank", "form")).alias("m")).select("key", F.col("m.rank").alias("to_rank"), F.col("m.form").alias("to_form")), "anchors")
    pairs = _met(probes.join(kept, "id"), anchors).select("id", "rank", "form", "to_rank", "to_form").dropDuplicates(["id", "to_rank"])
    scored = pairs.withColumn("cost", _cost("form", "to_form")).where("cost is not null")
    best = Window.partitionBy("id")
    scored = scored.withColumn("least", F.min("cost").over(best)).where(F.col("cost") <= F.col("least") + 0.2)
    # A form that doesn't tell its business (or given name) and fits several equally well stays alone.
    said = F.when(_told("to_form.biz"), F.col("to_form.biz")).otherwise(F.when((F.col("to_form.biz") == "") & (F.col("to_form.legal") == ""), F.concat(F.lit("~"), F.col("to_form.a"))))
    choice = scored.groupBy("id").agg(F.max(F.struct(-F.col("cost"), F.col("to_rank"))).alias("m"), F.collect_set(F.when(F.col("cost") <= F.col("least"), said)).alias("kinds"), F.max("form.biz").alias("biz"), F.max("form.a").alias("a"))
    parents = choice.where((F.size("kinds") <= 1) | (F.col("biz") != "")).select("id", F.col("m.to_rank.id").alias("parent"))
    links = settle(forms.select("id").join(parents, "id", "left").select("id", F.coalesce("parent", "id").alias("root")), "links")
    while True:  # twice as far up the tree each time
        up, moved = links.select(F.col("id").alias("root"), F.col("root").alias("next")), Observation()
        further = links.join(up, "root").observe(moved, F.count_if(F.col("next") != F.col("root")).alias("n")).select("id", F.col("next").alias("root"))
        links = settle(further, "links")
        if not moved.get["n"]:
            return links


def entities(names: DataFrame, column: str = "name") -> DataFrame:
    """(name, root) of each distinct non-null spelling; spellings of one organisation or person have the same root.

    Spellings stay as they are stored, blanks and letter case included. Null counts for nothing; a spelling without any
    letter or digit is linked with none. Repeated rows change nothing, very long names are read whole. An empty table
    gives no rows. Other columns play no part.

    Scale: work is by distinct spelling, then by distinct form, then by distinct token; forms are compared with all
    anchors under their keys, so a key's work is its forms times its anchors, in blocks of CROWD anchors. A spelling with k
    tokens of n letters makes k * n index entries.
    """
    seen = Observation()
    distinct = settle(names.select(F.col(f"`{column}`").alias("name")).where("name is not null").distinct().observe(seen, F.count("*").alias("n")), "spellings")
    read = settle(distinct.mapInPandas(_reader(learned_lines(distinct, seen.get["n"])), "name string, " + FORM), "names").withColumn("id", F.concat_ws("|", "a", "b", "mid", "biz", "legal"))
    forms = settle(read.groupBy("id", "a", "b", "mid", "biz", "legal").agg(F.count("*").alias("f")), "forms")
    return read.select("name", "id").join(linked_forms(forms), "id").select("name", "root")


def same_entity_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b in code point order: every pair of spellings with one root."""
    left = linked.select("root", F.col("name").alias("name_a"))
    right = linked.select("root", F.col("name").alias("name_b"))
    return left.join(right, "root").where("name_a < name_b").select("name_a", "name_b")
