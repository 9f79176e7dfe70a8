"""Linking the spellings of one person's or group's name.

Method: a symmetric-delete index on tokens finds tokens a few typing errors
apart without comparing all of them: each token is filed under what remains
when up to two characters of its first seven are deleted, together with the
part of the name that must agree. Candidates are then aligned token by token by
optimal assignment, where initials, nicknames and mistyped tokens may stand for
whole ones.

Every distinct spelling is read into a type (surname, given name, initials).
Types attach to types: nicknames to the formal name of the family, mistyped
names to the established one, initials to the only full name they can stand
for. Whether a full name is the only one is an aggregate (least and greatest
candidate), so a family name with any number of bearers needs no pairs. Each
type attaches to at most one other, and the roots of these chains are the
entities. Spellings are paired within entities only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.canon import edits
from quirelake.llm.mojibake import repaired
from quirelake.operators.staging import staged

#: Characters of a token that are filed, and deletions among them.
FILED, DELETIONS = 7, 2
#: Partners that an established given name, and that no family name has: so many at least, and such a share of what given names typically have.
GIVEN_PARTNERS, GIVEN_SHARE = 3, 0.01
WIDESPREAD, WIDE_SHARE = 12, 0.05
#: How many times as large a family must be as one of several names that is taken for a spelling of it.
LARGER = 5
#: Pointers are followed in steps that double; no chain is longer than two to this power.
MOST_JUMPS = 40

# Letters that have no accent to take off.
_LETTERS = str.maketrans(_PLAIN := {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "ħ": "h", "ŧ": "t"})
# Titles and degrees beside a name.
_TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "herr", "frau", "doktor", "doctor"}
_DEGREES = {"phd", "md", "msc", "bsc", "ma", "ba", "mba", "jr", "sr", "dphil", "dsc", "frs", "esq"}
# Words by which groups of authors are known.
_GROUPS = {"collaboration", "consortium", "group", "team", "network", "project", "initiative", "committee", "society", "institute", "alliance", "investigators", "collaborators", "study", "association", "centre", "center", "laboratory", "council", "partnership", "trialists"}
# Particles that belong to the surname that follows.
_PARTICLES = {"van", "von", "der", "den", "de", "da", "di", "del", "la", "le", "dos", "das", "du", "ter", "ten", "zu", "bin", "ibn", "al", "el"}
# Short forms and the given names they stand for.
NICKNAMES = {
    "alex": "alexander alexandra alexandre alejandro", "sasha": "alexander alexandra", "sandra": "alexandra", "lex": "alexander", "xander": "alexander", "andy": "andrew andreas", "tony": "anthony antonio antonia", "toni": "anthony antonia", "bart": "bartholomew", "barty": "bartholomew",
    "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "tina": "christina martina", "chris": "christopher christina christine christian", "chrissy": "christine christina", "kirsten": "christine", "dan": "daniel", "danny": "daniel", "dani": "daniel daniela", "danya": "daniel", "ella": "daniela gabriella", "dima": "dmitri", "mitya": "dmitri",
    "ed": "edward edouard edward", "eddie": "edward edouard", "doudou": "edouard", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "paco": "francisco", "pancho": "francisco", "cisco": "francisco", "frank": "francis francisco", "fred": "frederick friedrich alfred", "fritz": "friedrich",
    "gabi": "gabriella gabriel", "gaby": "gabriella", "beppe": "giuseppe", "pino": "giuseppe", "peppe": "giuseppe", "rik": "henrik richard", "henk": "henrik", "hank": "henry henrik", "isa": "isabella", "bella": "isabella", "izzy": "isabella", "hans": "johannes", "jo": "johannes joseph", "hannes": "johannes", "johan": "johannes", "jannik": "jan", "honza": "jan", "janka": "jana", "joe": "joseph", "pepe": "jose", "josh": "joshua", "jim": "james", "john": "johannes jonathan",
    "kat": "katarina", "katya": "katarina ekaterina", "kate": "katarina katherine", "kati": "katarina", "lori": "ludovica", "vica": "ludovica", "lulu": "ludovica", "leo": "leonardo leonard", "lars": "laurentius", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret", "masha": "maria", "mia": "maria", "mary": "maria", "mike": "michael", "mick": "michael", "misha": "michael mikhail", "kolya": "nikolai", "nick": "nicholas nikolai", "niko": "nikolai", "oxana": "oksana", "ksenia": "xenia oksana", "ksyusha": "oksana xenia",
    "pasha": "pavel", "pavlik": "pavel", "pauly": "paul", "paulie": "paul", "polly": "paula", "paulina": "paula", "quin": "quentin", "rick": "richard", "dick": "richard", "rich": "richard", "ricky": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert", "rosa": "rosalind", "ros": "rosalind", "roz": "rosalind", "lindy": "rosalind", "sam": "samuel samantha", "sammy": "samuel", "stefi": "stefania", "steffi": "stefania", "stefa": "stefania", "sue": "susanna susan", "susie": "susanna", "sanna": "susanna", "susi": "susanna", "tanya": "tatiana", "tania": "tatiana", "thea": "theodora", "dora": "theodora", "teddy": "theodora theodore", "tom": "tomas thomas", "tomek": "tomas", "tommy": "tomas thomas", "ulla": "ursula", "uschi": "ursula", "vik": "viktor", "vitya": "viktor", "vic": "viktor victor", "volodya": "vladimir", "vlad": "vladimir", "vova": "vladimir", "bill": "william", "will": "william", "billy": "william", "liam": "william", "zosia": "zofia", "zosha": "zofia", "sofie": "zofia", "hanna": "hana johanna", "ines": "agnes", "ingo": "ingrid", "inga": "ingrid", "bego": "begona", "delfi": "delphine", "fina": "delphine josefina", "leila": "layla", "jorg": "georg", "jurgen": "georg", "xeni": "xenia", "noora": "noor", "matt": "matthew matthias", "max": "maximilian", "steve": "stephen stefan", "greg": "gregory", "gus": "august gustav", "manu": "manuel emmanuel", "nacho": "ignacio", "lola": "dolores", "chema": "josemaria", "zeca": "jose", "ze": "jose", "chico": "francisco", "kiko": "francisco", "lena": "elena helena magdalena", "natasha": "natalia", "olya": "olga", "yura": "yuri", "zhenya": "evgeny evgenia", "vanya": "ivan", "seryozha": "sergei", "lyosha": "alexei", "grisha": "grigori",
}
_ANY_LETTER = re.compile(f"[{''.join(_PLAIN)}]")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_SPLIT = re.compile(r"[^\w.'’-]+|_")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?-?){1,3}$")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.casefold()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))
    return text.translate(_LETTERS) if _ANY_LETTER.search(text) else text


@lru_cache(maxsize=1)
def established_names() -> frozenset[str]:
    """Given names that need no proof: short forms and the names they stand for."""
    return frozenset(NICKNAMES) | frozenset(f for names in NICKNAMES.values() for f in names.split())


@lru_cache(maxsize=1)
def formal_names() -> dict[str, tuple[str, ...]]:
    return {short: tuple(dict.fromkeys(names.split())) for short, names in NICKNAMES.items()}


def read_name(name: str) -> tuple[list[str], list[str], str, bool]:
    """(full tokens, initials, hint, group): hint names the surname among the full tokens, '' if nothing does."""
    text = repaired(name) or ""
    parts = [p.strip() for p in text.split(",")]
    parts = [p for p in parts if p and fold(p).replace(".", "") not in _DEGREES]
    full: list[str] = []
    initials: list[str] = []
    hint = ""
    split = [[w for w in _SPLIT.split(p) if w] for p in parts]
    words = [w for p in split for w in p]
    if len(words) > 2 and any(fold(w).strip(".") in _GROUPS for w in words):
        return sorted(x for w in words if (x := re.sub(r"[^\w]", "", fold(w))) and x not in ("the", "of", "for", "on", "and")), [], "", True
    mixed = any(any(map(str.islower, w)) for w in words)
    shouted = [w for w in words if w.upper() == w and len(re.sub(r"\W", "", w)) > 3 and any(c.isalpha() for c in w)]
    for at, part in enumerate(split):
        pending = ""
        for word in part:
            bare = fold(word)
            if not bare.isalnum():
                bare = re.sub(r"[^\w]", "", bare)
            if not bare or bare in _TITLES and len(words) > 1:
                continue
            if bare in _DEGREES and word.upper() == word and len(words) > 2 and "." not in word and len(bare) > 2:
                continue
            alone = len(bare) == 1 or "." in word and _INITIALS.match(word) or len(bare) <= 3 and word.upper() == word and mixed and _INITIALS.match(word) and word.isalpha()
            if alone and len(words) > 1:
                initials.extend(c for c in bare if c.isalpha())
                continue
            if bare in _PARTICLES and not pending and len(words) > 2:
                pending = bare
                continue
            token = pending + bare
            pending = ""
            full.append(token)
            if at == 0 and len(parts) == 2 or len(shouted) == 1 and word == shouted[0] and mixed:
                hint = hint or token
    return full, initials, hint, False


#: read_name for callers that meet the same names again and again; they mustn't change what it gives.
name_parts = lru_cache(maxsize=200_000)(read_name)


def key_hash(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x01".join(parts)) - (1 << 63)


def filings(token: str) -> set[str]:
    """What remains of a token's beginning when up to two characters are deleted."""
    head = token[:FILED]
    found = {head}
    for n in range(1, DELETIONS + 1):
        if len(head) - n >= 2:
            found.update("".join(head[i] for i in range(len(head)) if i not in gone) for gone in combinations(range(len(head)), n))
    return found


def most_edits(token: str) -> int:
    return 2 if len(token) >= 5 else 1


def token_cost(a: str, b: str) -> float:
    """Cost at which one token stands for another; above 2 it can't."""
    if a == b:
        return 0.0
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 9.0
    if a in formal_names().get(b, ()) or b in formal_names().get(a, ()):
        return 0.5
    most = min(most_edits(a), most_edits(b))
    d = edits(a, b, most)
    return float(d) if d <= most else 9.0


def alignment_cost(a: list[str], b: list[str]) -> float:
    """Least total cost of assigning the tokens of the shorter name to those of the longer; spare whole tokens cost too."""
    if len(a) > len(b):
        a, b = b, a
    if a == b:
        return 0.0
    spare = [0.2 if len(y) == 1 else 3.0 for y in b]
    # spare tokens are assigned to nothing
    costs = [[token_cost(x, y) for y in b] for x in a] + [spare] * (len(b) - len(a))
    return least_assignment(costs)


def least_assignment(costs: list[list[float]]) -> float:
    """Least total cost of assigning each row of a square matrix to a column of its own, by shortest augmenting paths."""
    n = len(costs)
    row_price, column_price, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for row in range(n):
        owner[n], at = row, n
        reach, before, done = [float("inf")] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        while True:
            done[at] = True
            i = owner[at]
            step, to = float("inf"), n
            for j in range(n):
                if not done[j]:
                    cost = costs[i][j] - row_price[i] - column_price[j]
                    if cost < reach[j]:
                        reach[j], before[j] = cost, at
                    if reach[j] < step:
                        step, to = reach[j], j
            for j in range(n + 1):
                if done[j]:
                    row_price[owner[j]] += step
                    column_price[j] -= step
                else:
                    reach[j] -= step
            at = to
            if owner[at] == n:
                break
        while at != n:
            owner[at], at = owner[before[at]], before[at]
    return sum(costs[owner[j]][j] for j in range(n))


def _token_facts(names: DataFrame) -> DataFrame:
    """(token, partners, surname, given): how widespread a token is, and how often its form shows its role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int, int]] = []
            for name in batch.column(0).to_pylist():
                full, initials, hint, group = read_name(name)
                if group:
                    continue
                if len(full) == 1 and initials:
                    out.append((full[0], "", 1, 0))
                elif len(full) == 2:
                    for t, other in (full, full[::-1]):
                        out.append((t, other, int(hint == t), int(hint == other)))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["token", "other", "s", "g"])

    pairs = names.select("name").mapInArrow(run, "token string, other string, s int, g int")
    once = pairs.groupBy("token", "other").agg(F.max("s").alias("s"), F.max("g").alias("g"))
    return once.groupBy("token").agg(F.count(F.when(F.col("other") != "", 1)).alias("partners"), F.sum("s").alias("surname"), F.sum("g").alias("given"))


#: What is known of a token that stands nowhere else.
_UNKNOWN = (1, 0, 0)


def split_roles(full: list[str], hint: str, first: tuple[int, int, int], second: tuple[int, int, int], widespread: float = WIDESPREAD) -> list[tuple[str, str]]:
    """(surname, given) readings of two full tokens or more, one if the tokens or the form decide; `first` and `second` are the facts of the tokens."""
    if hint in full:
        rest = [t for t in full if t != hint]
        return [(hint, " ".join(rest))]
    if len(full) > 2:
        return [(full[-1], " ".join(full[:-1]))]
    a, b = full

    def facing(one: tuple[int, int, int], other: tuple[int, int, int]) -> bool:
        """Whether the forms and partners of a token show a given name beside the other."""
        (p, s, g), (q, r, h) = one, other
        return p * (1 + 2 * g) / (1 + 2 * s) > 1.8 * q * (1 + 2 * h) / (1 + 2 * r) and (p >= widespread or g > s or r > h)

    if facing(first, second):
        return [(b, a)]
    if facing(second, first):
        return [(a, b)]
    return [(b, a), (a, b)]


def _read(names: DataFrame) -> DataFrame:
    """(name, n, full, mid, hint, group, one, two): the parts of each spelling; `one` and `two` are its tokens where they are two of unknown role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fulls, mids, hints, groups, ones, twos = [], [], [], [], [], []
            for name in batch.column(0).to_pylist():
                full, initials, hint, group = read_name(name)
                open_ = not group and len(full) == 2 and hint not in full
                fulls.append(full)
                mids.append("".join(initials))
                hints.append(hint)
                groups.append(group)
                ones.append(full[0] if open_ else None)
                twos.append(full[1] if open_ else None)
            columns = [pa.array(fulls, pa.list_(pa.string())), pa.array(mids, pa.string()), pa.array(hints, pa.string()), pa.array(groups, pa.bool_()), pa.array(ones, pa.string()), pa.array(twos, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["name", "n", "full", "mid", "hint", "group", "one", "two"])

    return names.select("name", "n").mapInArrow(run, "name string, n bigint, full array<string>, mid string, hint string, group boolean, one string, two string")


def _types(names: DataFrame, facts: DataFrame, widespread: float) -> DataFrame:
    """(name, n, kind, surname, given, mid, first, rank): the readings of each spelling; rank 0 is the likelier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for name, n, full, mid, hint, group, *known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group:
                    out.append((name, n, "group", " ".join(full), "", "", "", 0))
                elif not full:
                    out.append((name, n, "other", fold(name).strip(), "", "", "", 0))
                elif len(full) == 1:
                    out.append((name, n, "initials" if mid else "single", full[0], "", mid[1:], mid[:1], 0))
                else:
                    one, two = (tuple(known[k : k + 3]) if known[k] is not None else _UNKNOWN for k in (0, 3))
                    for rank, (surname, given) in enumerate(split_roles(full, hint, one, two, widespread)):
                        out.append((name, n, "full", surname, given, mid, given[0], rank))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["name", "n", "kind", "surname", "given", "mid", "first", "rank"])

    read = _read(names)
    of = lambda side: facts.select(F.col("token").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("partners", "surname", "given")))
    joined = read.join(of("one"), "one", "left").join(of("two"), "two", "left")
    taken = joined.select("name", "n", "full", "mid", "hint", "group", *(f"{side}_{c}" for side in ("one", "two") for c in ("partners", "surname", "given")))
    return taken.mapInArrow(run, "name string, n bigint, kind string, surname string, given string, mid string, first string, rank int")


_FILE = "file bigint, id bigint, side tinyint, kind tinyint, family bigint, alone boolean"


def _filed(types: DataFrame, established: float) -> DataFrame:
    """(file, id, side, kind, family, alone): the index entries of each type.

    A type is filed by its mistyped surname with the given name or the initial
    in the file's key, by its mistyped given name with the surname there, and a
    group by each of its words with the other words there. Entries of side 1
    only look for others, those of side 0 are only found, those of side 2 both:
    a short form looks for its formal name, never the other way round. kind is
    1 for initials, 2 for full names, 0 for groups; family tells the surname,
    alone whether no more than one full name has it. So pairs that can't attach
    are left out while entries meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, ids, sides, kinds, families, lone = [], [], [], [], [], []

            def put(side: int, who: int, kind: str, agreed: str, token: str, code: int, family: int, alone: bool) -> None:
                found = filings(token)
                files.extend(key_hash(kind, agreed, f) for f in found)  # noqa: B023
                for values, value in ((ids, who), (sides, side), (kinds, code), (families, family), (lone, alone)):  # noqa: B023
                    values.extend([value] * len(found))

            for who, kind, surname, given, first, partners, family_size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = (key_hash(surname), family_size <= 1)
                if kind == "full":
                    put(2, who, "s", given, surname, 2, *rest)
                    for formal in formal_names().get(given, ()):
                        put(1, who, "s", formal, surname, 2, *rest)
                    doubtful = (partners or 1) < established and given not in established_names()
                    put(2 * doubtful, who, "g", surname, given, 2, *rest)
                    put(2 * doubtful, who, "i", first, surname, 2, *rest)
                elif kind == "initials":
                    put(1, who, "i", first, surname, 1, *rest)
                elif kind == "group":
                    words = surname.split(" ")
                    for i, w in enumerate(words):
                        put(2, who, "w", " ".join(words[:i] + words[i + 1 :]), w, 0, *rest)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(ids, pa.int64()), pa.array(sides, pa.int8()), pa.array(kinds, pa.int8()), pa.array(families, pa.int64()), pa.array(lone, pa.bool_())], names=["file", "id", "side", "kind", "family", "alone"])

    return types.select("id", "kind", "surname", "given", "first", "partners", "family").mapInArrow(run, _FILE)


def _verified(pairs: DataFrame) -> DataFrame:
    """(a, b, cost) of the candidate types whose tokens can be assigned to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, costs = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_kind", "a_surname", "a_given", "a_mid", "b_kind", "b_surname", "b_given", "b_mid")), strict=True)
            for i, (ak, asur, agiv, amid, bk, bsur, bgiv, bmid) in enumerate(rows):
                if ak == "group" or bk == "group":
                    cost = alignment_cost(asur.split(" "), bsur.split(" ")) if ak == bk else 9.0
                else:
                    if agiv and bgiv:
                        given = token_cost(agiv, bgiv) if " " not in agiv + bgiv else alignment_cost(agiv.split(" "), bgiv.split(" "))
                    else:
                        given = 0.5
                    middle = 9.0 if amid and bmid and not set(amid) & set(bmid) else 0.0
                    cost = token_cost(asur, bsur) + given + middle
                if cost <= 2.6:
                    at.append(i)
                    costs.append(cost)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(costs, pa.float64())], names=["a", "b", "cost"])

    return pairs.mapInArrow(run, "a bigint, b bigint, cost double")


def entities(rows: DataFrame, authors: str) -> DataFrame:
    """(name, root): every distinct spelling with the number of its entity.

    Null and blank elements are no names. A spelling of initials that several
    full names of the family fit is an entity of its own with the spellings of
    the same initials. Nothing depends on the order of rows; ties go to the
    type with more spellings, then more uses, then the smaller number.
    """
    spark = rows.sparkSession
    names = rows.select(F.explode(rows[authors]).alias("name")).where(F.trim("name") != "").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    names = staged(names)
    facts = staged(_token_facts(names).where("partners > 1 or surname + given > 0"))
    # what a given name typically has, weighed by how many it has
    typical = facts.where("given > surname").agg((F.sum(F.col("partners").cast("double") * F.col("partners")) / F.greatest(F.sum("partners"), F.lit(1))).alias("p")).collect()[0].p or 0.0
    established, widespread = max(GIVEN_PARTNERS, GIVEN_SHARE * typical), max(WIDESPREAD, WIDE_SHARE * typical)

    read = staged(_types(names, facts, widespread).withColumn("id", F.xxhash64("kind", "surname", "given", F.when(F.col("kind") == "initials", F.concat("first", "mid")).otherwise(F.lit("")))))
    # readings of a spelling that are less likely count only if another spelling has the type as its likeliest
    likely = read.where("rank = 0").groupBy("id", "kind", "surname", "given", "first").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("uses"), F.max("mid").alias("mid"))
    others = read.where("rank > 0").join(likely.select("id", "names", "uses"), "id").groupBy("name").agg(F.max(F.struct("names", "uses", "id")).alias("alt"))
    first = read.where("rank = 0").join(likely.select("id", "names"), "id").join(others, "name", "left")
    chosen = staged(first.select("name", "n", F.when((F.col("names") == 1) & F.col("alt").isNotNull(), F.col("alt.id")).otherwise(F.col("id")).alias("id")))
    used = chosen.groupBy("id").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("uses"))
    types = staged(likely.drop("names", "uses").join(used, "id"))

    families = types.where("kind = 'full'").groupBy("surname").agg(F.count(F.lit(1)).alias("family"))
    sized = types.join(families, "surname", "left").withColumn("family", F.coalesce("family", F.lit(0)))
    weighed = sized.select("id", "kind", "surname", "given", "mid", "first", F.struct((F.col("family") > 1).alias("kin"), "names", "uses", F.col("id").alias("id")).alias("w"), "family")
    filed = _filed(sized.join(facts.select(F.col("token").alias("given"), "partners"), "given", "left"), established)
    seek, found = filed.where("side >= 1"), filed.where("side <> 1")
    # full names never look for initials; initials look for other surnames; of two surnames the mistyped one has no family, or a much smaller one
    fits = "a.file = b.file and a.id <> b.id and b.kind <> 1 and not (a.kind = 1 and a.family = b.family) and (a.family = b.family or a.kind = 0 or a.alone or not b.alone)"
    near = seek.alias("a").join(found.alias("b"), F.expr(fits)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    pairs = near.join(_side(weighed, "a"), "a").join(_side(weighed, "b"), "b")
    # the lesser type attaches to the greater
    pairs = pairs.where("a_w < b_w or (a_kind = 'initials' and b_kind = 'full')").where(f"a_surname = b_surname or a_family <= 1 or {LARGER} * a_family <= b_family").where("not (a_kind = 'full' and b_kind = 'initials')").where("not (a_kind = 'initials' and a_surname = b_surname)")
    mistyped = _verified(pairs).join(_side(weighed, "b").select("b", "b_w"), "b").groupBy("a").agg(F.min(F.struct("cost", (-F.col("b_w.names")).alias("k"), (-F.col("b_w.uses")).alias("u"), "b")).alias("best"))
    typed = staged(mistyped.select(F.col("a").alias("id"), F.col("best.b").alias("up")))

    short = [(s, f) for s, names_ in formal_names().items() for f in names_]
    table = spark.createDataFrame(short, "given string, formal string")
    full = types.where("kind = 'full'")
    nick = full.join(F.broadcast(table), "given").select("id", "surname", "formal").join(full.select("surname", F.col("given").alias("formal"), F.col("id").alias("up")), ["surname", "formal"])
    nick = nick.groupBy("id").agg(F.min("up").alias("up"), F.max("up").alias("other")).where("up = other").select("id", "up")
    nick = staged(nick)
    up = staged(typed.join(nick, "id", "left_anti").select("id", "up").unionByName(nick))
    full_up = staged(_roots(full.select("id"), up.join(types.where("kind <> 'initials'").select("id"), "id", "left_semi")))

    # initials stand for the only full name of the family that fits
    heads = full.join(full_up, "id").select("surname", "first", "mid", F.col("root").alias("head"))
    any_mid = heads.groupBy("surname", "first").agg(F.min("head").alias("low"), F.max("head").alias("high"))
    by_mid = heads.groupBy("surname", "first", F.coalesce("mid", F.lit("")).alias("m")).agg(F.min("head").alias("low"), F.max("head").alias("high"))
    initial = types.where("kind = 'initials'").select("id", "surname", "first", F.col("mid").alias("m"))
    free = initial.join(any_mid, ["surname", "first"]).where("m = ''").select("id", "low", "high")
    # all middle initials of the shorter form must begin the longer one; a full name with any of them goes before one with none
    beside = initial.where("m <> ''").join(by_mid.withColumnRenamed("m", "fm"), ["surname", "first"]).where("startswith(fm, m) or startswith(m, fm)")
    bound = beside.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(F.col("fm") != "", F.col("low"))).alias("exact_low"), F.max(F.when(F.col("fm") != "", F.col("high"))).alias("exact_high"))
    bound = bound.select("id", F.coalesce("exact_low", "low").alias("low"), F.coalesce("exact_high", "high").alias("high"))
    stands = staged(free.unionByName(bound))
    sure = stands.where("low = high").select("id", F.col("low").alias("up"))
    # without a full name, initials of one family go together if each begins the longest of them
    alone = initial.join(stands.select("id"), "id", "left_anti").join(typed.select("id"), "id", "left_anti")
    longest = alone.groupBy("surname", "first").agg(F.min("id").alias("up"), F.max_by("m", F.struct(F.length("m"), F.col("m"))).alias("all"))
    compared = alone.join(longest, ["surname", "first"])
    torn = compared.where("not startswith(all, m)").select("surname", "first").distinct()
    together = compared.join(torn, ["surname", "first"], "left_anti").select("id", "up")
    unsure = stands.where("low <> high").select("id").join(initial, "id")
    doubtful = unsure.join(unsure.groupBy("surname", "first", "m").agg(F.min("id").alias("up")), ["surname", "first", "m"]).select("id", "up")
    typed_initials = typed.join(initial.select("id"), "id", "left_semi").join(stands.select("id"), "id", "left_anti").select("id", "up")
    links = staged(up.join(types.where("kind <> 'initials'").select("id"), "id", "left_semi").unionByName(sure).unionByName(together).unionByName(doubtful).unionByName(typed_initials).where("id <> up"))
    return chosen.join(_roots(types.select("id"), links), "id").select("name", "root")


def _side(types: DataFrame, side: str) -> DataFrame:
    return types.select(F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("kind", "surname", "given", "mid", "w", "family")))


def _roots(ids: DataFrame, up: DataFrame) -> DataFrame:
    """(id, root): the end of the chain of attachments, followed until nothing changes; chains lead to greater types, so they end."""
    at = staged(ids.join(up.groupBy("id").agg(F.min("up").alias("up")), "id", "left").select("id", F.coalesce("up", "id").alias("root")))
    for _ in range(MOST_JUMPS):
        to = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = staged(at.join(to, "root", "left").select("id", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        at = moved.select("id", "root")
        if moved.where("moved").isEmpty():
            break
    return at


def find_variants(rows: DataFrame, authors: str) -> DataFrame:
    """(name_a, name_b): each two different spellings of one entity, name_a < name_b by code point.

    An empty table, null lists and blank elements give no pairs; repeated rows
    add nothing; names of any length are read whole.
    """
    named = staged(entities(rows, authors))
    a, b = named.select("root", F.col("name").alias("name_a")), named.select("root", F.col("name").alias("name_b"))
    return a.join(b, "root").where("name_a < name_b").select("name_a", "name_b")
