"""Variant spellings of names of companies and persons linked to one entity.

1. A name is read into coined words (its core), trade, number, legal form, given name and initials. Abbreviations of trades
   and nicknames come from word lists, typing errors in them are bridged by edit distance.
2. A symmetric-delete index on the words of cores finds neighbours: a core gives one key for each pair of its two parts
   with at most one character deleted from each; parts are its words, or runs of words written apart, or what a word
   written together splits into. Three and more words also give keys without order, for errors in two of them, and all
   words but one give keys with the beginning of that one, for abbreviations and nicknames that no list has. Each key's
   heaviest core is the candidate for all others; cores left without a neighbour are then tried with the key's next ones,
   in steps that double, until none is left untried.
3. Candidates are verified by the optimal assignment of words, whose costs are Damerau-Levenshtein edits and, dearer,
   initials and abbreviations; words written apart or together are compared as one. A core follows its nearest heavier
   neighbour of a step up to a root. Cores of a trusted register stay.
4. Within a root, names are one entity if number and trade (companies) or given name (persons) agree. A name without trade
   or with an initial only joins if that leaves one choice, else it stays alone.

Null and void names ('N/A', '-', blanks, no letters) belong to no entity. Repeated rows count once. Words of more than 48
characters are compared exactly, as are names of under three letters and, against the same letters split into another
number of words, cores of more than 96. Cores of more than 256 words are found if one word differs. Other columns are
not looked at.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import cut, release, tasks

# Words of company names by trade, with their customary abbreviations.
TRADES = {
    "industries": "industry industries inds ind",
    "enterprises": "enterprise enterprises entpr ent enterp entps",
    "technologies": "technology technologies technol tech techs",
    "logistics": "logistics logistic logist log",
    "services": "service services serv svc svcs servs srv",
    "plastics": "plastic plastics plast plas",
    "engineering": "engineering engg engrg eng engr engin",
    "shipping": "shipping shpg shippg shipg",
    "chemicals": "chemical chemicals chem chems",
    "foods": "food foods fds",
    "construction": "construction constructions constr const constrn",
    "furniture": "furniture furn furnit",
    "development": "development developments devel dev devt dvlpt",
    "electronics": "electronic electronics elec electr elect electron",
    "holdings": "holding holdings hldg hldgs",
    "manufacturing": "manufacturing mfg manuf manufact manufac mfrg",
    "pharmaceuticals": "pharmaceutical pharmaceuticals pharm pharma pharms",
    "packaging": "packaging packg pkg packag pckg",
    "textiles": "textile textiles tex txtl text txtls",
    "paper mills": "paper mills ppr mill mls papermills",
    "steel works": "steel works stl steelworks stlwks",
    "solar systems": "solar systems syst sys system",
    "automotive parts": "automotive parts auto autom pts automot",
    "medical supplies": "medical supplies med supl medic supp suppl supls",
    "marine equipment": "marine equipment mar equip eqpt eqp",
    "international trading": "international trading intl trdg trd trade int internat internatl",
    "consulting": "consulting consultants consult consultancy",
    "insurance": "insurance insur",
    "energy": "energy energies",
    "transport": "transport transports transp transportation",
    "mining": "mining mines",
    "motors": "motors motor",
}
# Legal forms as single words, and words without meaning in a name.
LEGAL = set(
    "ab ag aktiebolag aktiengesellschaft ao aps asa bv bvba cjsc co companies company corp corporation cv eg ev gbr gesellschaft"
    " gmbh inc incorporated jsc kft kg kgaa kk lda limitada limitata limited llc llp lp ltd ltda mbh nv nyrt oao ohg ojsc ooo ou oy oyj pao"
    " pjsc plc private public psa pte pty pvt rt sa sab sagl sapi sarl sas sl slp slu snc spa sprl spzoo srl sro ug vof zao zrt zoo cia cie".split()
)
LONG_LEGAL = [w for w in LEGAL if len(w) >= 7]
LINKS = set("y e la el los lo del von van und et di da".split())  # between the words of a person's name
VOID = set("the and of de mr mrs ms miss dr sr sra jr hon prof usa hq attn m/s ms co/ c/o no nr num number unit branch".split())
# Given names with their nicknames.
GIVEN = {
    "alexander": "alex sandy sasha alec lex xander", "robert": "rob bob bobby robbie bert", "william": "will bill billy willy liam",
    "katherine": "kate katie kathy kat kitty catherine kathryn", "elizabeth": "liz beth betty eliza lizzie libby bess",
    "margaret": "maggie peggy meg greta madge", "theodore": "ted teddy theo", "nathaniel": "nate nat nathan",
    "henrietta": "hettie etta harriet", "dorothea": "dora thea dot dorothy", "francisco": "paco pancho frank cisco",
    "guillermo": "memo guille", "vladimir": "vova volodya vlad", "yevgenia": "zhenya evgenia eugenia", "cornelius": "kees neil corny cor",
    "johannes": "hans jo jan johan", "richard": "rick dick richie", "james": "jim jimmy jamie", "john": "jack johnny", "charles": "charlie chuck",
    "thomas": "tom tommy", "michael": "mike mick mickey misha", "joseph": "joe joey pepe", "edward": "ed eddie ned", "george": "georgie jorge",
    "henry": "harry hank", "david": "dave davey", "daniel": "dan danny", "samuel": "sam sammy", "benjamin": "ben benny", "anthony": "tony anton",
    "christopher": "chris kit", "patricia": "pat patty trish", "susan": "sue susie", "mary": "molly polly", "barbara": "barb babs",
    "jennifer": "jen jenny", "rebecca": "becky", "victoria": "vicky tori", "anna": "annie anya", "maria": "masha mia", "ivan": "vanya",
    "dmitri": "dima mitya", "nikolai": "kolya nick", "sergei": "seryozha", "tatiana": "tanya", "ekaterina": "katya", "natalia": "natasha",
}

_DOTTED = re.compile(r"\b(?:[^\W\d_](?:\.\s?|\s|\b)){2,}")  # letters with points or spaces between
_WORD = re.compile(r"[^\W\d_]+[01][^\W\d_][^\W_]*|[^\W\d_]{3,}0(?![^\W_])|[^\W\d_]+|\d+")
_BLANK_NAMES = set("n/a na none null unknown tbd nil void test x xx xxx -".split())
MIN_PART = 3
#: Words beyond this length are compared exactly.
LONGEST_WORD = 48
#: From so many words on, the index leaves whole words out instead of letters; beyond the second number, one word only.
MANY_WORDS, MOST_WORDS = 6, 256


def fold(word: str) -> str:
    """Sounds written in several ways: one way."""
    return word.replace("0", "o").replace("1", "l").replace("ph", "f").replace("c", "k").replace("w", "v").replace("y", "i")


def plain(text: str) -> str:
    t = unicodedata.normalize("NFKD", text)
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein (adjacent transpositions), at most `most` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def allowed(a: str, b: str) -> int:
    """Typing errors in a word of this length."""
    n = min(len(a), len(b))
    return 0 if n < 4 or n > LONGEST_WORD else 1 if n < 7 else 2


class Lexicon:
    """Folded words to what they stand for; errors of one letter are bridged for the full words."""

    def __init__(self, table: dict[str, str], full: int = 5):
        self.exact = {fold(w): name for name, words in table.items() for w in [*words.split(), *name.split()]}
        self.by_delete: dict[str, list[str]] = {}
        for w in {fold(w) for name, words in table.items() for w in [*name.split(), *words.split()[:2]]}:
            if len(w) >= full:
                for d in deletes(w):
                    self.by_delete.setdefault(d, []).append(w)

    @lru_cache(maxsize=200_000)
    def find(self, word: str, loose: bool = False) -> str | None:
        """What a word stands for; loose takes any single error even in short words, which coined words may look like."""
        if word in self.exact or not 4 <= len(word) <= LONGEST_WORD:
            return self.exact.get(word)
        best = None
        for d in deletes(word):
            for w in self.by_delete.get(d, ()):
                n = distance(word, w, 2)
                # short words are told from coined ones by their letters: only swapped, lost or doubled ones
                if n > 1 and len(w) < 9 or n > 2 or not loose and len(w) <= 6 and len(w) == len(word) and sorted(w) != sorted(word):
                    continue
                if best is None or (n, w) < best:
                    best = (n, w)
        return self.exact[best[1]] if best else None


def half(word: str, trade: str) -> str:
    """Which word of a trade of two words a folded word stands for: '0', '1', or '' for both or where that can't be told."""
    a, b = map(fold, trade.split())
    if len(word) > len(a) + 2:  # written together
        return ""
    n = 2 if a[0] == b[0] else 1
    return {(True, False): "0", (False, True): "1"}.get((word[:n] == a[:n], word[:n] == b[:n]), "")


def deletes(word: str) -> set[str]:
    """The word and all forms with one character less; of short and of very long words the word alone."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if MIN_PART < len(word) <= LONGEST_WORD else {word}


_LEXICA: list[Lexicon] = []


def lexica() -> list[Lexicon]:
    if not _LEXICA:
        _LEXICA.extend([Lexicon(TRADES), Lexicon(GIVEN)])
    return _LEXICA


FOLDED_LEGAL = {fold(w) for w in LEGAL}
FOLDED_LONG = [fold(w) for w in LONG_LEGAL]
FOLDED_VOID = {fold(w) for w in VOID}
#: A single error leaves the first or the last three letters of a long word as they are.
LONG_HEADS, LONG_TAILS = {w[:3] for w in FOLDED_LONG}, {w[-3:] for w in FOLDED_LONG}


def is_legal(w: str) -> bool:
    """A legal form, or a long one with an error."""
    return w in FOLDED_LEGAL or len(w) >= 6 and (w[:3] in LONG_HEADS or w[-3:] in LONG_TAILS) and any(distance(w, x, 1) <= 1 for x in FOLDED_LONG)


def _undot(m: re.Match) -> str:
    letters = re.sub(r"[.\s]", "", m.group())
    return letters + " " if fold(letters) in FOLDED_LEGAL else m.group()


def read_name(name: str | None) -> tuple[str, str, str, str, str, bool] | None:
    """(core words in order of code points, number, trade, given, initials, legal) of a name; None if it is void."""
    if name is None:
        return None
    t = plain(name)
    if t.strip() in _BLANK_NAMES:
        return None
    t = t.replace("m/s", " ").replace("c/o", " ").replace("'", "")
    t = _DOTTED.sub(_undot, t)
    trade_of, given_of = lexica()
    words, numbers, given, initials, legal = [], [], [], [], False
    trades: dict[str, set[str]] = {}  # with the halves of it that were read
    pieces: list[tuple[int, str]] = []  # letters and small words, with their place: initials and links, or words written apart
    found = _WORD.findall(t)
    for i, raw in enumerate(found):
        if raw.isdigit():
            if raw.strip("0"):
                numbers.append(raw.lstrip("0"))
            continue
        w = fold(raw)
        if len(w) == 1:
            if raw not in "yei" or not (0 < i < len(found) - 1 and len(found[i - 1]) > 2 and len(found[i + 1]) > 2):
                initials.append(raw)  # else a link between surnames
            pieces.append((len(words), w))
        elif raw in LINKS:
            pieces.append((len(words), w))
        elif is_legal(w):
            legal = True
        elif w in FOLDED_VOID:
            continue
        elif trade := trade_of.find(w):
            trades.setdefault(trade, set()).add(half(w, trade) if " " in trade else "")
        else:
            words.append(w)
    if (trades or legal or numbers) and words:
        for at, w in reversed(pieces):
            words.insert(at, w)
        initials = []
    for w in words[:]:  # more words than a name has beside its trade: one of them may be the trade
        if len(words) > 2 and len(w) > 3 and (trade := trade_of.find(w, True)) and (not trades or trade in trades):
            trades.setdefault(trade, set()).add(half(w, trade) if " " in trade else "")
            words.remove(w)
    if not trades and not legal:
        rest = []
        for w in words:
            g = given_of.find(w)
            if g and len(words) > 1:
                given.append(g)
            else:
                rest.append(w)
        words = rest
    if not words:
        words, given = given, []
    if not words:
        return None
    said = [t if "" in h or len(h) > 1 else f"{t}/{min(h)}" for t, h in trades.items()]
    return " ".join(words), " ".join(sorted(numbers)), "|".join(sorted(said)), " ".join(sorted(set(given))), "".join(sorted(set(initials))), legal


def parts(core: list[str]) -> Iterator[tuple[str, ...]]:
    """Ways to see a core as two parts: its words, runs of words, or splits of a single word."""
    if len(core) == 1:
        w = core[0]
        yield (w,)
        for i in range(MIN_PART + 1, len(w) - MIN_PART if len(w) <= LONGEST_WORD else 0):
            yield w[:i], w[i:]
    if sum(map(len, core)) <= 2 * LONGEST_WORD or len(core) == 2:
        for i in range(1, len(core)):
            yield "".join(core[:i]), "".join(core[i:])
    if len(core) > 1 and sum(map(len, core)) > 2 * LONGEST_WORD:
        yield ("".join(core),)  # written apart or together it is compared exactly


def unordered(core: list[str], h) -> list[np.ndarray]:
    """Hashes of three or more words in any order: two of them with at most a character deleted from each and the first
    letters of the others, which may be abbreviated; or both left out where many words remain."""
    n = len(core)
    if n >= MANY_WORDS:
        one = h(core)
        rest = one.sum() - one
        if n <= MOST_WORDS:
            rest = np.subtract.outer(rest, one)[np.triu_indices(n, 1)]
        return [(rest + np.uint64(n)) * np.uint64(7)]
    letters = h([f"<{w[0]}" for w in core])
    changes = [h(deletes(w)) - x for w, x in zip(core, letters)]
    return [(letters.sum() + np.add.outer(a, b).ravel()) * np.uint64(5) for a, b in combinations(changes, 2)]


def shortened(core: list[str], h) -> np.ndarray:
    """Hashes for abbreviations: all words but one, with the other one's first three letters or its first and last; of three
    and more words also with its first letter, for initials."""
    one = h(core)
    looks = [[f"<{w[:3]}", f"<{w[0]}>{w[-1]}", *([f"<{w[0]}<"] if len(core) > 2 else [])] for w in core]
    sound = [any(len(x) >= ANCHOR for x in core[:i] + core[i + 1 :]) for i in range(len(core))]
    looks = [look if ok else [] for look, ok in zip(looks, sound)]
    rest = np.repeat((one.sum() - one) * np.uint64(11), list(map(len, looks)))
    return rest + h([x for look in looks for x in look])


def keys(core: list[str]) -> np.ndarray:
    """Hashes of the symmetric-delete index; the order of the two parts, or of three and more words, doesn't matter."""
    import xxhash

    h = lambda words: np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = []
    for p in parts(core):
        a = h(deletes(p[0]))
        out.append(a * np.uint64(3) if len(p) == 1 else np.add.outer(a, h(deletes(p[1]))).ravel())
    if len(core) > 2:
        out += unordered(core, h)
    if 1 < len(core) <= MOST_WORDS:
        out.append(shortened(core, h))
    return np.unique(np.concatenate(out)).view(np.int64)


def cheapest(costs: list[list[int]]) -> int:
    """Cost of the optimal assignment of rows to columns (Hungarian method)."""
    n = len(costs)
    u, v, row = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row[0], j = i, 0
        least, used, way = [math.inf] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while row[j]:
            used[j], r = True, row[j]
            for k in range(1, n + 1):
                if not used[k] and (c := costs[r - 1][k - 1] - u[r] - v[k]) < least[k]:
                    least[k], way[k] = c, j
            step, j = min((least[k], k) for k in range(1, n + 1) if not used[k])
            for k in range(n + 1):
                if used[k]:
                    u[row[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
        while j:
            row[j] = row[way[j]]
            j = way[j]
    return -v[0]


def abbreviates(short: str, long: str) -> bool:
    """Initials, beginnings of three letters or more, and letters of the word in order from its first: four or more, or
    consonants only."""
    if len(short) > len(long) - 2 or short[0] != long[0]:
        return False
    if len(short) == 1 or len(short) >= 3 and long.startswith(short):
        return True
    rest = iter(long)
    return (len(short) >= ANCHOR or len(short) == 3 and not set(short) & set("aeiou")) and all(c in rest for c in short)


#: Letters of a word that an abbreviation beside it can lean on; what an abbreviation counts beside typing errors, and how
#: an assignment keeps the two apart.
ANCHOR, ABBREVIATION_EDITS, ABBREVIATION = 4, 2, 1000


def word_cost(x: str, y: str) -> int | None:
    """Typing errors between two words, or ABBREVIATION, None if they are different words."""
    most = allowed(x, y)
    d = distance(x, y, most)
    if d <= most:
        return d
    return ABBREVIATION if abbreviates(*sorted((x, y), key=len)) else None


def align(a: list[str], b: list[str]) -> int | None:
    """Edits between two cores under the best assignment of words, None if they are too far apart. Typing errors, initials and
    abbreviations are costs of the assignment; at most half of the words may be abbreviated, and one that isn't must have
    four letters."""
    if len(a) == len(b):
        if sorted(a) == sorted(b):
            return 0
        far = ABBREVIATION * (len(a) + 1)  # more than any assignment within what is allowed
        costs = [[far if (c := word_cost(x, y)) is None else c for y in b] for x in a]
        if any(min(row) >= far for row in costs):
            return None
        total = min(sum(row[j] for row, j in zip(costs, p)) for p in permutations(range(len(b)))) if len(a) <= 3 else cheapest(costs)
        short, edits = divmod(total, ABBREVIATION)
        if total >= far or short and (2 * short > len(a) or not any(len(x) >= ANCHOR and min(row) < ABBREVIATION for x, row in zip(a, costs))):
            return None
        return edits + ABBREVIATION_EDITS * short
    if sum(map(len, a)) > 2 * LONGEST_WORD:
        return 0 if "".join(a) == "".join(b) else None
    best, x = None, "".join(a)  # words written apart or together
    for p in permutations(b) if len(b) <= 4 else [b]:
        d = distance(x, "".join(p), 2)
        if d <= 2 and min(len(x), sum(map(len, b))) >= 7:
            best = d if best is None else min(best, d)
    return best


def neighbours(cores: DataFrame) -> DataFrame:
    """(core, center) from cores (core, weight, trusted): a heavier neighbour of each core that has one, the nearest of
    those tried in the same step."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = [keys(c.split(" ")) for c in b.column(1).to_pylist()]
            at = np.cumsum([0, *map(len, ks)])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(ks) if ks else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["n", "ks"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = [align(x.split(" "), y.split(" ")) for x, y in zip(b["core"], b["center"])]
            yield pd.DataFrame({"core": b["core"], "center": b["center"], "c": b["c"], "edits": pd.array(d, dtype="Int32")}).dropna()

    spark = cores.sparkSession
    # numbered from the heaviest core of the trusted ones down: the index holds numbers only
    down = [F.desc("trusted"), F.desc("weight"), F.desc("core")]
    numbered = cut(cores.repartitionByRange(tasks(spark), *down).sortWithinPartitions(*down).select(F.monotonically_increasing_id().alias("n"), "core", "trusted"))
    # a core becomes about a hundred keys: the small table is spread first, over a fixed number of tasks
    spread = numbered.select("n", "core").repartition(tasks(spark), "n")
    indexed = spread.mapInArrow(index, "n long, ks array<long>").select("n", F.explode("ks").alias("k"))
    w = "over (partition by k order by n)"
    ranked = cut(indexed.selectExpr("*", f"row_number() {w} as r", f"first(n) {w} as c", f"lead(n) {w} as after").where("r > 1 or after is not null").drop("after"))
    name, free = numbered.select("n", "core"), numbered.where("not trusted").select("n")
    # each key's first core is beside every row already; the next ones are joined by key, for the few cores still left
    pairs = ranked.where("r > 1").select("n", "c").distinct().join(free, "n", "left_semi")
    left, found, start = ranked.where("r > 2").select("n", "k", "r").join(free, "n", "left_semi"), None, 2
    while True:
        spelled = pairs.join(name, "n").join(name.selectExpr("n as c", "core as center"), "c").select("core", "center", "c")
        checked = spelled.mapInPandas(verify, "core string, center string, c long, edits int")
        link = cut(checked.groupBy("core").agg(F.min_by("center", F.struct("edits", "c")).alias("center")))
        found = link if found is None else found.unionByName(link)
        old, left = left, cut(left.where(f"r > {start}").join(link.join(name, "core").select("n"), "n", "left_anti"))
        release(old)
        if left.isEmpty():
            release(ranked)
            release(left)
            return found
        centers = ranked.where(f"r between {start} and {2 * start - 1}").selectExpr("k", "n as c")
        pairs, start = left.join(centers, "k").where("c < n").select("n", "c").distinct(), 2 * start


def roots(cores: DataFrame) -> DataFrame:
    """(core, root): centers followed to the end. Every step leads to a heavier core, so there are no cycles."""
    link = cut(neighbours(cores))
    found = cut(cores.select("core").join(link, "core", "left").select("core", F.coalesce("center", "core").alias("root")))
    while True:
        ahead = found.where("core <> root").selectExpr("core as root", "root as next")
        if ahead.join(found.where("core <> root").select("root").distinct(), "root", "left_semi").isEmpty():
            return found
        old, found = found, cut(found.join(ahead, "root", "left").select("core", F.coalesce("next", "root").alias("root")))
        release(old)


def entities(names: DataFrame) -> DataFrame:
    """(name, entity) for names (name, weight, trusted), each name once. A name without entity has no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["core", "number", "trade", "given", "initials", "legal"]
        for b in batches:
            got = [(n, w, t, *r) for n, w, t in zip(b["name"], b["weight"], b["trusted"]) if (r := read_name(n)) is not None]
            yield pd.DataFrame(got, columns=["name", "weight", "trusted", *cols])

    schema = "name string, weight long, trusted boolean, core string, number string, trade string, given string, initials string, legal boolean"
    spelled = cut(names.mapInPandas(read, schema).repartition("core"))
    cores = cut(spelled.groupBy("core").agg(F.sum("weight").alias("weight"), F.max("trusted").alias("trusted")))
    rooted = cut(spelled.join(roots(cores), "core"))
    # what the names of a root and number say: trades and given names are few, words of a list or its errors
    says = rooted.groupBy("root", "number").agg(
        F.collect_set(F.expr("nullif(trade, '')")).alias("trades"), F.collect_set(F.expr("nullif(given, '')")).alias("givens"), F.max("legal").alias("company")
    )
    # half of a trade stands for all of it where its root says all of it somewhere
    whole = lambda t, trades: F.when(t.endswith("/0") | t.endswith("/1"), F.when(F.array_contains(trades, F.substring(t, F.lit(1), F.length(t) - 2)), F.substring(t, F.lit(1), F.length(t) - 2))).otherwise(t)
    known = rooted.join(says, ["root", "number"]).withColumn("trade", F.coalesce(whole(F.col("trade"), F.col("trades")), "trade"))
    known = known.withColumn("trades", F.array_distinct(F.transform("trades", lambda t: F.coalesce(whole(t, F.col("trades")), t))))
    by_initial = F.filter("givens", lambda g: F.contains(F.col("initials"), F.left(g, F.lit(1))))
    one = lambda a: F.when(F.size(a) == 1, a[0])
    entity = (
        F.when(F.col("trade") != "", F.concat(F.lit("t:"), "trade"))
        .when(F.col("given") != "", F.concat(F.lit("g:"), "given"))
        .when(F.col("legal") | ((F.size("givens") == 0) & (F.size("trades") > 0)), F.when(F.size("trades") == 0, F.lit("t:")).otherwise(F.concat(F.lit("t:"), one(F.col("trades")))))
        .when((F.col("initials") != "") & (F.size(by_initial) > 0), F.concat(F.lit("g:"), one(by_initial)))
        .when(F.col("initials") != "", F.concat(F.lit("i:"), "initials"))
        .when(F.size("givens") == 1, F.when(F.size("trades") == 0, F.concat(F.lit("g:"), F.col("givens")[0])))
        .when((F.size("givens") == 0) & (F.size("trades") == 0), F.lit("t:"))
    )
    return known.select("name", F.concat_ws("\x1f", "root", "number", entity).alias("entity"), entity.alias("e")).where("e is not null").select("name", "entity")


def _known(records: DataFrame) -> DataFrame:
    """(entity, key), a row each, from records (key, name, trusted)."""
    rows = cut(records.where("key is not null and name is not null").select("key", "name", "trusted").distinct())
    names = rows.groupBy("name").agg(F.count_distinct("key").alias("weight"), F.max("trusted").alias("trusted"))
    return cut(rows.join(entities(names), "name").select("entity", "key").distinct())


def members(records: DataFrame) -> DataFrame:
    """(key, group_key, links): each record that belongs to an entity, with the smallest key of the entity and the number of
    other records in it; no pairs are made. A key whose rows bear names of two entities has a row in each."""
    known = _known(records)
    groups = known.groupBy("entity").agg(F.min("key").alias("group_key"), (F.count("*") - 1).alias("links"))
    return known.join(groups, "entity").select("key", "group_key", "links")


def same_entity(records: DataFrame) -> DataFrame:
    """(key_a, key_b): pairs of different keys of one entity, smaller key first, from records (key, name, trusted)."""
    known = _known(records)
    a, b = known.withColumnRenamed("key", "key_a"), known.withColumnRenamed("key", "key_b")
    return a.join(b, "entity").where("key_a < key_b").select("key_a", "key_b").distinct()
