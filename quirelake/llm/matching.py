"""Matching records of two tables that share no identifier.

Method: a graph of records, their attributes (authors, venue, year) and the
tokens in them. Random walks over it train skip-gram vectors of the tokens until
the loss settles; what all vectors have in common is taken out of them. A
record's vector is the sum of its title's and its authors' tokens, weighted by
rarity over all records, each token together with its trigrams, by which
mistyped words stay near. Random hyperplanes hash the vectors in several
tables. Records of one table are filed under one bucket a table; those of the
other look into their bucket and the buckets across their nearest hyperplanes.
What meets there, agrees in enough of a sketch of further hyperplanes and has
enough trigrams in common is compared exactly, field by field (`matchrules`).
The confidence is calibrated on records that were perturbed on purpose, from
the cosine and the agreement. Matches spread to the rows that carry the same
DOI or id.

The vectors are fitted on a bounded sample (`SAMPLED`), as an index may be; all
rows are filed, and the number of buckets follows the number of rows, so that
buckets stay small. The more buckets, the rarer two near records meet in one
table; so the number of tables follows the number of buckets (`tables_for`),
and near records meet as surely at every size. Rarity is counted over all rows;
only the `COMMON_TOKENS` most frequent tokens need to be known for it, all
others are rare, and likewise for the titles that many rows share.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quirelake.llm import matchrules
from quirelake.llm.held import held
from quirelake.llm.names import fold, name_parts
from quirelake.operators.staging import staged

#: Records from which the vectors are fitted.
SAMPLED = 12_000
#: Buckets and dimensions of token vectors.
SLOTS, WIDTH = 1 << 15, 128
#: Rounds of training at most, walks from each record in one, and the gain of the loss below which training ends.
ROUNDS, WALKS, SETTLED = 12, 4, 0.005
#: Directions common to all trained vectors that are taken out.
COMMON_DIRECTIONS = 40
#: Tokens and titles whose frequency the workers hold.
COMMON_TOKENS, COMMON_TITLES = 50_000, 50_000
#: How far rarity weighs; at 1 one mistyped rare word would move a record too far.
RARITY = 0.6
#: Weight of the authors' part of a vector against the title's.
AUTHORS = 0.5
#: Two records whose sketches differ in `MEET_AT` bits shall meet in one of the tables with this probability, whatever the number of rows.
MEET_AT, MEET = 30, 0.9
LEAST_TABLES = 6
#: Sampled records from which their middle is known, and from so many at most; the hyperplanes of smaller tables go through the origin.
BALANCED_FROM, MIDDLE_OF = 1_000, 4_000
#: Bits of the sketch, and how many of them may differ.
SKETCH, DIFFER = 128, 45
#: Nearest hyperplanes that are crossed alone, and in pairs.
CROSS_ONE, CROSS_TWO = 6, 3
#: Shares of the smaller set of trigrams, as bits, that titles and authors must both have, and with half the authors' share, and the cosine with both.
SHARED_TITLE, SHARED_AUTHORS, SHARED, SHARED_NEAR = 0.78, 0.5, 1.2, 1.85
#: Titles of fewer than `SHORT` words need only such a share.
SHORT, SHARED_SHORT = 6, 0.5
TITLE_BITS, AUTHOR_BITS = 256, 128
SEED = 20240229


def record_tokens(title, authors) -> tuple[list[str], list[str]]:
    """The different words of a title, and the different name parts of authors."""
    words = dict.fromkeys(w for w in matchrules.words_of_title(title) if len(w) > 1 or w.isdigit())
    people = dict.fromkeys(t for a in authors or [] if a for t in name_parts(a)[0] if len(t) > 2 and t not in ("et", "al"))
    return list(words), list(people)


def graph_tokens(title, authors, year, venue) -> list[str]:
    """A record's edges in the graph: to the tokens of its title and to its attributes and theirs."""
    words, people = record_tokens(title, authors)
    found = words + ["a:" + t for t in people]
    if year:
        found.append(f"y:{year}")
    return found + ["v:" + w for w in dict.fromkeys(matchrules.words_of(venue or "")) if not w.isdigit()]


def slot(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) & (SLOTS - 1)


def trigrams(token: str) -> list[str]:
    text = f"<{token}>"
    return [text[i : i + 3] for i in range(len(text) - 2)]


def train_vectors(sample: list[list[str]], rounds: int = ROUNDS, walks: int = WALKS, step: float = 0.1, losses: list[float] | None = None) -> np.ndarray:
    """Skip-gram vectors with negative sampling from random walks record - token - record - token.

    Frequent tokens are passed over in proportion to their frequency, negatives
    are drawn by frequency to the power 3/4, and rounds go on until the loss
    gains less than `SETTLED`. Slots that no walk visits keep their random
    start, which sets unknown tokens and trigrams apart from each other.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.standard_normal((SLOTS, WIDTH)).astype(np.float32) / math.sqrt(WIDTH)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)
    records = [[slot(t) for t in r] for r in sample if len(r) > 1]
    if not records:
        return unit(vectors)
    sizes = np.array([len(r) for r in records])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    tokens = np.concatenate([np.array(r) for r in records])
    owner = np.repeat(np.arange(len(records)), sizes)
    order = np.argsort(tokens, kind="stable")
    at_token = np.searchsorted(tokens[order], np.arange(SLOTS + 1))
    records_of = owner[order]
    frequency = np.bincount(tokens, minlength=SLOTS).astype(np.float64)
    kept = np.minimum(1.0, np.sqrt(1e-3 * len(tokens) / np.maximum(frequency, 1)))
    noise = np.cumsum(frequency**0.75)
    pick = lambda r: tokens[starts[r] + (rng.random(len(r)) * sizes[r]).astype(np.int64)]
    contexts = np.zeros((SLOTS, WIDTH), np.float32)
    before = math.inf
    for _ in range(rounds):
        record = np.tile(np.arange(len(records)), walks)
        first = pick(record)
        low, high = at_token[first], at_token[first + 1]
        beyond = records_of[low + (rng.random(len(first)) * (high - low)).astype(np.int64)]
        second = pick(record)
        centre, context = np.concatenate([first, second]), np.concatenate([second, pick(beyond)])
        fine = (rng.random(len(centre)) < kept[centre]) & (rng.random(len(centre)) < kept[context]) & (centre != context)
        centre, context = centre[fine], context[fine]
        if not len(centre):
            break
        loss = 0.0
        for chunk in np.array_split(rng.permutation(len(centre)), max(1, len(centre) // 2048)):
            x, y = centre[chunk], context[chunk]
            n = np.searchsorted(noise, rng.random((len(x), 3)) * noise[-1])
            v = vectors[x]
            near, far = (v * contexts[y]).sum(1), np.einsum("bd,bkd->bk", v, contexts[n])
            pull, push = step / (1 + np.exp(near)), -step / (1 + np.exp(-far))
            loss += float(np.log1p(np.exp(-near)).sum() + np.log1p(np.exp(far)).sum())
            change = pull[:, None] * contexts[y] + np.einsum("bk,bkd->bd", push, contexts[n])
            np.add.at(contexts, y, pull[:, None] * v)
            np.add.at(contexts, n.ravel(), (push[:, :, None] * v[:, None, :]).reshape(-1, WIDTH))
            np.add.at(vectors, x, change)
        loss /= len(centre)
        if losses is not None:
            losses.append(loss)
        if before - loss < SETTLED * loss:
            break
        before = loss
    vectors = unit(vectors)
    seen = np.unique(tokens)
    return unit(_without_common(vectors, seen, frequency[seen]))


def _without_common(vectors: np.ndarray, seen: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """`vectors` with their mean and the most common directions taken out of those that were trained."""
    trained = vectors[seen] - np.average(vectors[seen], axis=0, weights=weight)
    scaled = trained * np.sqrt(weight)[:, None]
    _, directions = np.linalg.eigh(scaled.T @ scaled)
    common = directions[:, -min(COMMON_DIRECTIONS, len(seen) // 4, WIDTH // 2) :] if len(seen) >= 4 else directions[:, :0]
    out = vectors.copy()
    out[seen] = trained - (trained @ common) @ common.T
    return out


@lru_cache(maxsize=200_000)
def _trigram(t: str) -> int:
    """Slot and, in the last 16 bits, the number from which its bit is taken, of a trigram."""
    return slot("3:" + t) << 16 | xxhash.xxh3_64_intdigest(t) & 0xFFFF


def _trigram_bits(trigrams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The trigrams of each token as bits of signed numbers; mistyped, torn and joined words keep most of theirs."""
    bit = trigrams & (size - 1)
    alone = np.zeros((len(bit), size // 64), np.int64)
    alone[np.arange(len(bit)), bit >> 6] = np.int64(1) << (bit & 63)
    return np.bitwise_or.reduceat(alone, starts, axis=0)


def index_bits(n: int) -> int:
    """Hyperplanes of a table: about 120 of `n` rows in a bucket."""
    return min(36, max(5, math.ceil(math.log2(max(2, n))) - 7))


def looked_into(part: np.ndarray) -> np.ndarray:
    """Bucket numbers in one table that each row looks into, its own first, from its distances to the table's hyperplanes."""
    weights = np.int64(1) << np.arange(part.shape[1], dtype=np.int64)
    base = (part > 0) @ weights
    ones = weights[np.argsort(np.abs(part), axis=1)[:, :CROSS_ONE]]
    two = [base ^ ones[:, i] ^ ones[:, j] for i in range(CROSS_TWO) for j in range(i)]
    return np.concatenate([base[:, None], base[:, None] ^ ones, np.stack(two, axis=1)], axis=1)


def tables_for(bits: int) -> int:
    """How many tables of so many hyperplanes `MEET` needs, by simulation of pairs that differ by `MEET_AT`."""
    rng = np.random.default_rng(SEED + 2)
    x, other = rng.standard_normal((2, 40_000, bits))
    turn = math.pi * MEET_AT / SKETCH
    y = math.cos(turn) * x + math.sin(turn) * other
    met = (looked_into(x) == looked_into(y)[:, :1]).any(axis=1).mean()
    return max(LEAST_TABLES, math.ceil(math.log(1 - MEET) / math.log(1 - min(0.9, max(1e-4, met)))))


def hyperplanes(tables: int, bits: int) -> np.ndarray:
    """The normals of all tables' hyperplanes, at right angles within a table, and of the sketch's."""
    rng = np.random.default_rng(SEED + 1)
    normals = [np.linalg.qr(rng.standard_normal((WIDTH, bits)))[0] for _ in range(tables)]
    return np.concatenate([*normals, rng.standard_normal((WIDTH, SKETCH))], axis=1).astype(np.float32)


class RecordVectors:
    """Vectors of records and their hyperplane hashes."""

    def __init__(self, vectors: np.ndarray, frequency: dict[str, int], records: int, bits: int, common: dict[int, int] | None = None, tables: int | None = None, middle: np.ndarray | None = None):
        self.vectors, self.frequency, self.bits = vectors.astype(np.float32), frequency, bits
        self.common = common or {}
        self.records = max(1, records)
        self.tables = tables or tables_for(bits)
        self.planes = hyperplanes(self.tables, bits)
        self.middle = np.zeros(self.planes.shape[1], np.float32) if middle is None else middle
        self._forget()

    def _forget(self) -> None:
        """Start with the row of no token."""
        self.at: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.named: dict[str, tuple[int, ...]] = {}
        self.known = np.zeros((4096, WIDTH), np.float32)
        self.bits_of = np.zeros((4096, max(TITLE_BITS, AUTHOR_BITS) // 64), np.int64)
        self.filled = 1

    def learn(self, tokens: Iterable[str], author: bool) -> None:
        """Give rows to tokens that have none, with their weighted vectors and trigram bits, all at once."""
        tokens = list(tokens)
        if not tokens:
            return
        end = self.filled + len(tokens)
        while end > len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.bits_of = np.concatenate([self.bits_of, np.zeros_like(self.bits_of)])
        parts = [trigrams(t) for t in tokens]
        found = np.array([_trigram(x) for p in parts for x in p], np.int64)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        rest = np.add.reduceat(self.vectors[found >> 16], starts, axis=0)
        own = self.vectors[[slot("a:" + t if author else t) for t in tokens]]
        rare = np.array([math.log(1 + self.records / self.frequency.get(t, 1)) ** RARITY for t in tokens], np.float32)
        self.known[self.filled : end] = (0.6 * own + 0.8 * rest / np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-6)) * rare[:, None]
        size = AUTHOR_BITS if author else TITLE_BITS
        self.bits_of[self.filled : end, : size // 64] = _trigram_bits(found, starts, size)
        self.at[author].update(zip(tokens, range(self.filled, end), strict=True))
        self.filled = end

    def vectors_of(self, rows: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The rows' vectors, and what their titles and authors are made of as bits, with the numbers of bits and, up to `SHORT`, of words in one."""
        if self.filled > 400_000:
            self._forget()
        rows = list(rows)
        titles = [{w for w in matchrules.words_of_title(row[0]) if len(w) > 1 or w.isdigit()} for row in rows]
        self.learn(set().union(*titles).difference(self.at[0]), False)
        names = {a: record_tokens(None, [a])[1] for a in {a for row in rows for a in row[1] or () if a}.difference(self.named)}
        self.learn({t for n in names.values() for t in n}.difference(self.at[1]), True)
        known, named = self.at
        self.named |= {a: tuple([named[t] for t in n]) for a, n in names.items()}
        title, people, title_at, people_at, words = [], [], [], [], []
        for row, t in zip(rows, titles, strict=True):
            title_at.append(len(title))
            people_at.append(len(people))
            words.append(len(t))
            title += [known[x] for x in t] or [0]
            people += {p for a in row[1] or () if a for p in self.named[a]} or [0]
        if not title_at:
            return np.zeros((0, WIDTH), np.float32), np.zeros((0, len(_MASKS)), np.int64)
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)
        sums = [unit(np.add.reduceat(self.known[rows_], at, axis=0)) for rows_, at in ((title, title_at), (people, people_at))]
        masks = [np.bitwise_or.reduceat(self.bits_of[rows_], at, axis=0) for rows_, at in ((title, title_at), (people, people_at))]
        counts = [np.bitwise_count(m.view(np.uint64)).sum(axis=1, dtype=np.int64) for m in masks]
        return unit(sums[0] + AUTHORS * sums[1]), np.concatenate([masks[0][:, : TITLE_BITS // 64], masks[1][:, : AUTHOR_BITS // 64], (counts[0] + (counts[1] << 16) + (np.minimum(words, SHORT) << 32))[:, None]], axis=1)

    def project(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The rows' distances to all hyperplanes, and their bits; few at a time, which stay in the processor's cache."""
        parts = [self.vectors_of(rows[i : i + 512]) for i in range(0, len(rows), 512)] or [self.vectors_of([])]
        return np.concatenate([v @ self.planes - self.middle for v, _ in parts]), np.concatenate([m for _, m in parts])

    def hopeless(self, title: str | None, authors: list[str] | None) -> bool:
        """Whether so many rows share a title that without authors no other field can make a match."""
        return not any(authors or []) and matchrules.common_title(self.common.get(title_key(title), 1)) > matchrules.WITHOUT_AUTHORS

    def buckets(self, far: np.ndarray, probe: bool) -> np.ndarray:
        """Bucket numbers of each row, one a table, or all that are looked into."""
        bits = self.bits
        found = []
        for t in range(self.tables):
            part = far[:, t * bits : (t + 1) * bits]
            into = looked_into(part) if probe else ((part > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64)))[:, None]
            found.append(into + (np.int64(t) << np.int64(bits)))
        return np.concatenate(found, axis=1)

    def sketch(self, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.packbits(far[:, -SKETCH:] > 0, axis=1).view(np.int64)
        return bits[:, 0].copy(), bits[:, 1].copy()


_FIELDS = ("title", "authors", "pub_year", "venue")
_TITLE_MASKS, _AUTHOR_MASKS = tuple(f"t{i}" for i in range(TITLE_BITS // 64)), tuple(f"p{i}" for i in range(AUTHOR_BITS // 64))
_MASKS = (*_TITLE_MASKS, *_AUTHOR_MASKS, "sizes")
# none of them is ever null, which spares the join a check of each
_HASHED = StructType([StructField("rec_no", LongType(), False), StructField("buckets", ArrayType(LongType(), False), False), *(StructField(m, LongType(), False) for m in ("s0", "s1", *_MASKS))])


def title_key(title: str | None) -> int:
    """As Spark's xxhash64 of the title in lower case."""
    n = xxhash.xxh64_intdigest((title or "").lower().encode("utf-8", "replace"), seed=42)
    return n - (1 << 64) if n >> 63 else n


def _hashed(rows: DataFrame, shared, probe: bool) -> DataFrame:
    """(rec_no, buckets, s0, s1, masks) of each record with a title that can be matched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = held("records", shared.value, lambda v: RecordVectors(*v))
        for batch in batches:
            authors = (a.split(matchrules.BETWEEN) if a else [] for a in batch.column(2).to_pylist())
            pairs = list(zip(batch.column(1).to_pylist(), authors, strict=True))
            fine = [i for i, p in enumerate(pairs) if not vectors.hopeless(*p)]
            if not fine:
                continue
            far, masks = vectors.project([pairs[i] for i in fine])
            found = vectors.buckets(far, probe)
            s0, s1 = vectors.sketch(far)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fine, pa.int64())), lists, pa.array(s0), pa.array(s1), *(pa.array(masks[:, k]) for k in range(len(_MASKS)))], names=["rec_no", "buckets", "s0", "s1", *_MASKS])

    usable = rows.where(F.col("rec_no").isNotNull() & (F.length(F.trim(F.coalesce("title", F.lit("")))) > 2))
    # authors as one string, which Python reads faster than a list
    return usable.select("rec_no", "title", F.array_join("authors", matchrules.BETWEEN)).mapInArrow(run, _HASHED)


#: What stands between the tokens of a text.
_APART = "\t\n\x0b\x0c\r" + string.punctuation + "“”‘’«»„‚‹›…¿¡–—"


def token_frequency(rows: DataFrame) -> dict[str, int]:
    """In how many records the most frequent title words and name parts stand, over all rows."""
    both = F.lower(F.concat_ws(" ", "title", F.array_join(F.filter("authors", lambda a: a.isNotNull()), " ")))
    # split at a single character, as Spark compiles any other pattern again for each row
    words = F.split(F.translate(both, _APART, " " * len(_APART)), " ")
    tokens = rows.select(F.explode(F.array_distinct(words)).alias("t")).where("t <> ''")
    # one partition, so that an executor merges what the partitions hold and not the driver
    counted = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "t").limit(COMMON_TOKENS).coalesce(1)
    found: dict[str, int] = {}
    for r in counted.collect():
        found[fold(r.t)] = found.get(fold(r.t), 0) + r.n
    return found


def title_frequency(rows: DataFrame) -> dict[int, int]:
    """How many rows have each of the titles that many rows share, over all rows."""
    titles = rows.where("title is not null").groupBy(F.xxhash64(F.lower("title")).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    return {r.title: r.n for r in titles.where(F.col("n") > matchrules.COMMON).orderBy(F.desc("n"), "title").limit(COMMON_TITLES).coalesce(1).collect()}


def _sample(rows: DataFrame, n: int, total: int) -> list[tuple]:
    share = min(1_000_000, round(1_000_000 * n / max(1, total)))
    taken = rows.where(F.pmod(F.xxhash64("rec_no"), F.lit(1_000_000)) < share).select("rec_no", *_FIELDS).limit(2 * n).collect()
    return [tuple(r)[1:] for r in sorted(taken, key=lambda r: (r.rec_no is None, r.rec_no or 0))]


def _compared(pairs: DataFrame, shared) -> DataFrame:
    """(rec_no, repo_rec_no, confidence) of the candidates that describe one work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, (by_cosine, by_score, offset) = shared.value
        for batch in batches:
            seen: dict[int, matchrules.Described] = {}
            mine: dict[int, matchrules.Described] = {}
            at, sure = [], []
            columns = [batch.column(i).to_pylist() for i in range(3)]
            left, right = (list(zip(*(batch.column(i).to_pylist() for i in part), strict=True)) for part in (range(3, 7), range(7, 11)))
            for i, (rec, repo, cosine) in enumerate(zip(*columns, strict=True)):
                if rec not in seen:
                    seen[rec] = matchrules.Described(*left[i])
                if repo not in mine:
                    mine[repo] = matchrules.Described(*right[i])
                agreed = matchrules.compare(mine[repo], seen[rec])
                if agreed is not None:
                    score = matchrules.confidence(agreed, common.get(title_key(seen[rec].title), 1))
                    if score > 0:
                        at.append(i)
                        sure.append(1 / (1 + math.exp(-max(-30.0, min(30.0, by_cosine * cosine + by_score * score + offset)))))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(2)), pa.array(sure, pa.float64())], names=["rec_no", "repo_rec_no", "confidence"])

    return pairs.mapInArrow(run, "rec_no bigint, repo_rec_no bigint, confidence double")


def _evidence(differ: Column) -> Column:
    """Whether titles and authors have enough trigrams in common to be worth comparing.

    Kept short: what is compiled of a join's condition must stay small.
    """
    both = lambda masks: reduce(Column.__add__, [F.bit_count(F.col(m).bitwiseAND(F.col(f"r_{m}"))) for m in masks])
    title, people = both(_TITLE_MASKS), both(_AUTHOR_MASKS)
    size = lambda at: F.least(*(F.shiftright(c, at).bitwiseAND(0xFFFF) for c in ("sizes", "r_sizes")))
    titles, peoples, short = F.greatest(size(0), F.lit(1)), size(16), size(32) < SHORT
    # without authors nothing speaks against them
    rest = F.when(peoples == 0, 0.5).otherwise(0.5 * people / F.greatest(peoples, F.lit(1)))
    # about the cosine, by a straight line
    far = SHARED_NEAR - 1.12 + 1.12 * differ / (SKETCH / 2) - rest
    return (people >= SHARED_AUTHORS * peoples) & (title >= F.when(short, SHARED_SHORT).otherwise(F.greatest(F.lit(SHARED_TITLE), SHARED - rest, far)) * titles)


def fit(left: DataFrame, right: DataFrame) -> tuple[tuple, tuple[float, float, float]]:
    """(the model of `RecordVectors`, the weights of cosine, agreement and offset in the log odds of a match)."""
    n_left, n_right = left.count(), right.count()
    both = left.select("rec_no", *_FIELDS).unionByName(right.select("rec_no", *_FIELDS))
    sample = _sample(left, SAMPLED * 3 // 4, n_left) + _sample(right, SAMPLED // 4, n_right)
    vectors = train_vectors([graph_tokens(*r) for r in sample]).astype(np.float16)
    bits = index_bits(n_left)
    model = (vectors, token_frequency(both), n_left + n_right, bits, title_frequency(left), tables_for(bits))
    filing = RecordVectors(*model)
    weights = calibrate(filing, sample)
    # each table's hyperplanes go through the middle of the sample, so that buckets are of like size; the sketch's through the origin, for the cosine
    middle = np.zeros(filing.planes.shape[1], np.float32)
    if len(sample) >= BALANCED_FROM:
        some = np.random.default_rng(SEED + 4).permutation(len(sample))[:MIDDLE_OF]
        middle[:-SKETCH] = np.median(filing.project([sample[i][:2] for i in some])[0], axis=0)[:-SKETCH]
    return (*model, middle), weights


def _merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join by sorting both sides.

    Spark guesses the size of one side from its files' and broadcasts it through
    the driver if that is small, but here an exploded row stands for more than a
    hundred.
    """
    return left.join(right.hint("merge"), key)


def candidates(left: DataFrame, right: DataFrame, model: tuple | None = None) -> DataFrame:
    """(rec_no, repo_rec_no, cosine): what meets in a bucket and agrees in the sketch."""
    shared = left.sparkSession.sparkContext.broadcast(model or fit(left, right)[0])
    filed = _hashed(left, shared, False).select("rec_no", F.explode("buckets").alias("bucket"), "s0", "s1", *_MASKS)
    looked = _hashed(right, shared, True).select(F.col("rec_no").alias("repo_rec_no"), F.explode("buckets").alias("bucket"), F.col("s0").alias("r0"), F.col("s1").alias("r1"), *(F.col(m).alias(f"r_{m}") for m in _MASKS))
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("r0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("r1")))
    met = _merged(filed, looked, "bucket").withColumn("differ", differ).where((F.col("differ") <= DIFFER) & _evidence(F.col("differ")))
    return met.groupBy("rec_no", "repo_rec_no").agg(F.min("differ").alias("differ")).select("rec_no", "repo_rec_no", F.cos(F.col("differ") * (math.pi / SKETCH)).alias("cosine"))


#: Sampled records that are perturbed to calibrate the confidence.
CALIBRATED_ON = 1_000


def perturbed(record: tuple, rng: np.random.Generator) -> tuple:
    """A record as another source may hold it: mistyped, cut, with other forms of its authors, a year off, a venue missing."""
    title, authors, year, venue = record
    words = (title or "").split(" ")
    for _ in range(int(rng.integers(0, 4))):
        k = int(rng.integers(0, len(words)))
        w = words[k]
        if len(w) > 3:
            i = int(rng.integers(1, len(w) - 1))
            words[k] = (w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :])[int(rng.integers(0, 3))]
    title = " ".join(words)
    if rng.random() < 0.1 and len(title) > 40:
        title = title[: int(rng.integers(30, len(title)))] + "..."
    people = [a for a in authors or [] if a]
    if people and rng.random() < 0.5:
        people = [a if " " not in a or "," in a else f"{a[0]}. {a.rsplit(' ', 1)[1]}" for a in people]
    if len(people) > 1 and rng.random() < 0.3:
        people = people[: int(rng.integers(1, len(people)))]
    if rng.random() < 0.1:
        people = []
    year = year + int(rng.integers(-1, 2)) if year and rng.random() < 0.3 else year
    return title, people, year, None if rng.random() < 0.3 else venue


def calibrate(vectors: RecordVectors, sample: list[tuple]) -> tuple[float, float, float]:
    """Weights of cosine, agreement and offset in the log odds of a match.

    Cases are sampled records against perturbed copies of them; the others are
    the nearest records with other titles, so no rule decides what is a match.
    """
    rng = np.random.default_rng(SEED + 3)
    records = [r for r in sample if r[0] and len(r[0].strip()) > 2]
    records = [records[i] for i in rng.permutation(len(records))[:CALIBRATED_ON]]
    if len(records) < 20:
        return 4.0, 1.0, -4.0
    copies = [perturbed(r, rng) for r in records]
    x, y = vectors.vectors_of(copies)[0], vectors.vectors_of(records)[0]
    cosines = x @ y.T
    cases: list[tuple[float, float, int]] = []
    described = [matchrules.Described(*r) for r in records]
    keys = [title_key(r[0]) for r in records]
    for i, row in enumerate(cosines):
        mine = matchrules.Described(*copies[i])
        nearest = [int(j) for j in np.argsort(-row)[:6] if keys[j] != keys[i]][:3]
        for j in [i, *nearest]:
            agreed = matchrules.compare(mine, described[j])
            if agreed is not None:
                cases.append((float(row[j]), matchrules.confidence(agreed, vectors.common.get(keys[j], 1)), int(j == i)))
    data = np.array(cases)
    if len(data) < 20 or data[:, 2].min() == data[:, 2].max():
        return 4.0, 1.0, -4.0
    design = np.concatenate([data[:, :2], np.ones((len(data), 1))], axis=1)
    w = np.array([4.0, 1.0, -4.0])
    for _ in range(25):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (data[:, 2] - p) - 0.1 * w
        hessian = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 0.1 * np.eye(3)
        w = w + np.linalg.solve(hessian, gradient)
    return float(w[0]), float(w[1]), float(w[2])


def doi_key(doi: Column) -> Column:
    """A DOI without resolver, label, padding and case; null if none is left."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://[^/]*doi[^/]*/|doi:\s*)", "")
    return F.when(bare.rlike(r"^10\.\S+/\S+"), F.trim(bare))


def find_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(rec_no, repo_rec_no, confidence) of the rows that describe the same work.

    `left` may hold a work in many rows: rows with the same DOI or id as a
    matched one match as well, whatever their titles. Records without a title
    are matched in no other way, those without a number not at all. An empty table gives an empty table; null
    fields neither speak for nor against a match. Titles that many rows share
    match by their authors only.
    """
    model, weights = fit(left, right)
    pairs = candidates(left, right, model)
    shared = left.sparkSession.sparkContext.broadcast((model[4], weights))
    fields = [F.array_join("authors", matchrules.BETWEEN).alias(f) if f == "authors" else F.col(f) for f in _FIELDS]
    mine = right.select(F.col("rec_no").alias("repo_rec_no"), *(c.alias(f"r_{f}") for c, f in zip(fields, _FIELDS, strict=True)))
    described = _merged(_merged(pairs, mine, "repo_rec_no"), left.select("rec_no", *fields), "rec_no").select("rec_no", "repo_rec_no", "cosine", *_FIELDS, *(f"r_{f}" for f in _FIELDS))
    kept = staged(_compared(described, shared))
    # rows with the same DOI or id as a matched one
    keys = left.select("rec_no", F.explode(F.array(F.concat(F.lit("d"), doi_key(F.col("doi"))), F.concat(F.lit("i"), "id"))).alias("key")).where("key is not null")
    by_key = _merged(kept, keys, "rec_no").groupBy("repo_rec_no", "key").agg(F.max("confidence").alias("confidence"))
    by_key = _merged(by_key, keys, "key")
    every = kept.unionByName(by_key.select("rec_no", "repo_rec_no", "confidence"))
    return every.groupBy("rec_no", "repo_rec_no").agg(F.max("confidence").alias("confidence"))
