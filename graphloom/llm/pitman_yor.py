"""Hierarchical Pitman-Yor language model over words, seated by Gibbs sampling.

Every token (a word or the end of a text) is a customer in the restaurant of its context, the hash
class of the token before it; the tables of all context restaurants are the customers of one parent
restaurant, whose base is uniform over the vocabulary and one unknown word:

    P(w | u) = (c_uw - d t_uw + (k + d T_u) P(w)) / (k + C_u),   P(w) likewise from the tables t_.w

The state is the number of tables t of every dish in every restaurant. A Gibbs step lets all
customers of one dish leave a restaurant and seats them one by one again, which is accepted by the
ratio of the products of the seating weights (an independence proposal). Runs of customers that
open no table are skipped, so a dish costs about as many steps as it has tables.

Documents are dealt to blocks and words to shards. A block asks each shard for its distinct (word,
context) pairs with their training counts; a shard holds all of its words' dishes and merges the
counts of all blocks. Its seating is a stored row, which each Gibbs round reads and writes anew.
Before a round the totals of the parent and of every context restaurant, CONTEXTS sums, are added up
over all shards, so that a dish is seated among all dishes. After the last round the shards answer
with averages over the kept rounds. Nothing of the size of the corpus reaches the driver or is
broadcast, and a word or pair in every text is one entry a block.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BASES, BYTE_CODE, mix, release, runs, stored, words_of
from graphloom.session import shuffles_dropped

CONTEXTS = 4096  # restaurants
DISCOUNT, STRENGTH = 0.9, 1.0  # of the context restaurants
PARENT_DISCOUNT, PARENT_STRENGTH = 0.8, 1.0
ROUNDS, KEPT = 6, 3  # Gibbs rounds, and how many of the last are averaged
BLOCK_BYTES = 16_000_000
END, START = np.uint64(0x2545F4914F6CDD1D), CONTEXTS - 1


class Tokens:
    """Token hashes, context classes and document numbers of a block of texts."""

    def __init__(self, texts: list[str | None]):
        tok, ctx, doc = [], [], []
        at = 0
        while at < len(texts):
            group, size, first = [], 0, at
            while at < len(texts) and (not group or size < 1 << 20):
                group.append(texts[at].encode().lower() if isinstance(texts[at], str) else b"")
                size += len(group[-1]) + 1
                at += 1
            t, c, d = self._group(group)
            tok.append(t)
            ctx.append(c)
            doc.append(d + first)
        self.tok = np.concatenate(tok) if tok else np.zeros(0, np.uint64)
        self.ctx = np.concatenate(ctx) if ctx else np.zeros(0, np.int64)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)

    @staticmethod
    def _group(group: list[bytes]):
        data = b"\n".join(group)
        begins = np.cumsum([0, *(len(g) + 1 for g in group[:-1])])
        starts, ends = words_of(data)
        words = runs(BYTE_CODE[np.frombuffer(data, np.uint8)], starts, ends, BASES[0]) if len(starts) else np.zeros(0, np.uint64)
        of = np.searchsorted(begins, starts, "right") - 1
        count = np.bincount(of, minlength=len(group))
        tok = np.full(len(words) + len(group), END, np.uint64)
        tok[np.arange(len(words)) + of] = words
        doc = np.repeat(np.arange(len(group)), count + 1)
        ctx = np.empty(len(tok), np.int64)
        ctx[1:] = (mix(tok[:-1]) % np.uint64(CONTEXTS - 1)).astype(np.int64)
        ctx[np.concatenate([[0], np.cumsum(count + 1)[:-1]])] = START
        return tok, ctx, doc


class Pairs:
    """The distinct (word, context) pairs of a block, by shard, word and context."""

    def __init__(self, tokens: Tokens, n_shards: int):
        self.words, word = np.unique(tokens.tok, return_inverse=True)
        shard = (mix(self.words ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n_shards)).astype(np.int64)
        order = np.lexsort((self.words, shard))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.shard, word = self.words[order], shard[order], rank[word]
        key, self.pair = np.unique(word * CONTEXTS + tokens.ctx, return_inverse=True)
        self.word, self.ctx, self.of = key // CONTEXTS, key % CONTEXTS, word

    def requests(self, block: int, trained: np.ndarray) -> pd.DataFrame:
        """One row for each shard met; `trained` tells the tokens that are learnt from."""
        n = np.bincount(self.pair, trained, len(self.ctx)).astype(np.int32)
        held = np.bincount(self.word, minlength=len(self.words)).astype(np.int32)
        shards, first = np.unique(self.shard, return_index=True)
        last = np.append(first[1:], len(self.shard))
        start = np.concatenate([[0], np.cumsum(held)])
        rows = []
        for s, a, b in zip(shards.tolist(), first.tolist(), last.tolist(), strict=True):
            i, j = start[a], start[b]
            rows.append((s, block, self.words[a:b].tobytes(), zlib.compress(held[a:b].tobytes(), 1), zlib.compress(self.ctx[i:j].astype(np.uint16).tobytes(), 1), zlib.compress(n[i:j].tobytes(), 1)))
        return pd.DataFrame(rows, columns=["shard", "block", "words", "held", "ctx", "n"])


FAR = 16.0  # from here on the asymptotic ratios of gamma functions are exact to about one in ten thousand


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of numbers of at least FAR by Stirling's series."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x)


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, k: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish after its customers sit down one by one, and the log product of the seating weights.

    `base` is the parent's probability of the dish, `others` the tables of other dishes there. While
    the weight of the tables in use is below FAR one customer sits down at a time; beyond, the chance
    that customers i to b open no table, a ratio of gamma functions, is inverted for the next that does.
    """
    tables, weight = np.minimum(customers, 1).astype(np.int64), np.zeros(len(customers))
    live = np.flatnonzero(customers > 1)
    seated = np.ones(len(live), np.int64)
    while len(live):
        c, t = customers[live], tables[live]
        taken = seated - d * t  # weight of the tables in use
        new = (k + d * (others[live] + t)) * base[live]  # of a new one
        draw = rng.random(len(live))
        until, opens = seated + 1, draw < new / (taken + new)
        add = np.log(taken + new)
        far = np.flatnonzero(taken >= FAR)
        if len(far):
            x, y = taken[far], new[far]
            half = (y - 1) / 2
            first = np.ceil((x + half) * np.exp(np.minimum(-np.log(np.maximum(draw[far], 1e-300)) / y, 600)) - half + d * t[far] - 1)
            opens[far] = first < c[far]
            until[far] = np.where(opens[far], np.maximum(first, seated[far]) + 1, c[far]).astype(np.int64)
            add[far] = _lgamma(until[far] - d * t[far] + y) - _lgamma(x + y)
        weight[live] += add
        tables[live] += opens
        more = until < c
        live, seated = live[more], until[more]
    return tables, weight


class Seats:
    """The dishes of a shard and their tables between two Gibbs rounds; `word` and `ctx` tell a pair's."""

    def __init__(self, word: np.ndarray, ctx: np.ndarray, count: np.ndarray, n_words: int, rng: np.random.Generator):
        self.word, self.ctx, self.count, self.n_words, self.rng = word, ctx, count, n_words, rng
        self.tables = np.minimum(count, 1).astype(np.int64)
        self.many = np.flatnonzero(count > 1)  # the others have no choice
        self.weight = np.full(len(self.many), -np.inf)
        self.upper = np.bincount(word, self.tables, n_words).astype(np.int64)  # customers of the parent
        self.upper_tables, self.upper_weight = np.minimum(self.upper, 1), np.full(n_words, -np.inf)
        self.kept, self.kept_upper_tables = np.zeros(len(self.many), np.int64), np.zeros(n_words, np.int64)

    def totals(self) -> np.ndarray:
        """Tokens, words, customers and tables of the parent, then tokens and tables of every context; they add up over shards."""
        tokens = np.bincount(self.word, self.count, self.n_words)
        return _totals(tokens, self.upper, self.upper_tables, self.ctx, self.count, self.tables)

    def step(self, totals: np.ndarray, keep: bool) -> None:
        """One round among the dishes of all shards, whose totals are given; kept ones count for the averages."""
        vocabulary, total, total_tables = max(1.0, totals[1]), totals[2], totals[3]
        here, many, tables = totals[4 + CONTEXTS :], self.many, self.tables
        uniform = 1 / (vocabulary + 1)
        parent = (self.upper - PARENT_DISCOUNT * self.upper_tables + (PARENT_STRENGTH + PARENT_DISCOUNT * total_tables) * uniform) / (PARENT_STRENGTH + total)
        others = np.maximum(here[self.ctx[many]] - tables[many], 0)
        t, w = seat(self.count[many], parent[self.word[many]], others, DISCOUNT, STRENGTH, self.rng)
        take = np.log(self.rng.random(len(many))) < w - self.weight
        tables[many[take]], self.weight[take] = t[take], w[take]
        self.upper = np.bincount(self.word, tables, self.n_words).astype(np.int64)
        t, w = seat(self.upper, np.full(self.n_words, uniform), np.maximum(total_tables - self.upper_tables, 0), PARENT_DISCOUNT, PARENT_STRENGTH, self.rng)
        take = (np.log(self.rng.random(self.n_words)) < w - self.upper_weight) | (self.upper_tables > self.upper) | ((self.upper_tables == 0) & (self.upper > 0))
        self.upper_tables, self.upper_weight = np.where(take, t, self.upper_tables), np.where(take, w, self.upper_weight)
        if keep:
            self.kept += tables[many]
            self.kept_upper_tables += self.upper_tables

    def means(self, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Averages over the kept rounds: tables of every pair, and customers and tables of every word in the parent."""
        tables = self.tables.astype(float)
        tables[self.many] = self.kept / kept
        return tables, np.bincount(self.word, tables, self.n_words), self.kept_upper_tables / kept


def _totals(tokens, upper, upper_tables, ctx, count, tables) -> np.ndarray:
    return np.concatenate([[tokens.sum(), (tokens > 0).sum(), upper.sum(), upper_tables.sum()], np.bincount(ctx, count, CONTEXTS), np.bincount(ctx, tables, CONTEXTS)])


def sample(word: np.ndarray, ctx: np.ndarray, count: np.ndarray, n_words: int, share: float, rng: np.random.Generator, rounds: int = ROUNDS, kept: int = KEPT):
    """All rounds of one shard that holds every word; see `Seats.means` for what it returns.

    `share` is the part of the vocabulary that is here and has to be 1: a shard of some words needs
    the totals of all of them before each round, as `score` adds them up.
    """
    if share != 1:
        raise ValueError(f"totals cannot be told from {share:g} of the vocabulary")
    seats = Seats(word, ctx, count, n_words, rng)
    for r in range(rounds):
        seats.step(seats.totals(), r >= rounds - kept)
    return seats.means(kept)


def _zip(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unzip(x, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


#: A shard's row. Tables, weights and kept tables are of the pairs met more than once; an average of the kept rounds stands in `totals` after the last.
SEATS = ("shard int, words binary, held binary, ctx binary, count binary, rng string, tables binary, weight binary, kept binary, "
         "upper_tables binary, upper_weight binary, kept_upper_tables binary, totals binary")  # fmt: skip
SEATS_NAMES = [x.split()[0] for x in SEATS.split(", ")]
_COUNTS = ["shard", "words", "held", "ctx", "count"]


def _row(counts: tuple, seats: Seats, totals: np.ndarray) -> tuple:
    rng = json.dumps(seats.rng.bit_generator.state)
    return (*counts, rng, _zip(seats.tables[seats.many]), seats.weight.tobytes(), _zip(seats.kept), _zip(seats.upper_tables), seats.upper_weight.tobytes(), _zip(seats.kept_upper_tables), totals.tobytes())


def _seats(row) -> Seats:
    """The seating that a row tells."""
    word = np.repeat(np.arange(len(row.words) // 8), _unzip(row.held, np.int64))
    seats = Seats(word, _unzip(row.ctx, np.uint16).astype(np.int64), _unzip(row.count, np.int64), len(row.words) // 8, np.random.default_rng())
    seats.rng.bit_generator.state = json.loads(row.rng)
    seats.tables[seats.many], seats.weight, seats.kept = _unzip(row.tables, np.int64), np.frombuffer(row.weight).copy(), _unzip(row.kept, np.int64).copy()
    seats.upper = np.bincount(word, seats.tables, seats.n_words).astype(np.int64)
    seats.upper_tables, seats.upper_weight = _unzip(row.upper_tables, np.int64), np.frombuffer(row.upper_weight)
    seats.kept_upper_tables = _unzip(row.kept_upper_tables, np.int64).copy()
    return seats


def _asked(asked: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Words of the requests, pairs of each of those words, and the context of each pair."""
    words = [np.frombuffer(x, np.uint64) for x in asked["words"]]
    held = [_unzip(x, np.int32) for x in asked["held"]]
    return words, held, np.concatenate([_unzip(x, np.uint16) for x in asked["ctx"]]).astype(np.int64)


def _merged(key, asked):
    """The requests of all blocks to a shard, added up, with every dish at one table."""
    asked = asked.sort_values("block", kind="stable")
    words, held, ctx = _asked(asked)
    n = np.concatenate([_unzip(x, np.int32) for x in asked["n"]])
    own, at = np.unique(np.concatenate(words), return_inverse=True)
    pair_key, pair = np.unique(np.repeat(at, np.concatenate(held)) * CONTEXTS + ctx, return_inverse=True)
    count = np.bincount(pair, n, len(pair_key)).astype(np.int64)
    word, where = pair_key // CONTEXTS, pair_key % CONTEXTS
    seats = Seats(word, where, count, len(own), np.random.default_rng([17, int(key[0])]))
    counts = (int(key[0]), own.tobytes(), _zip(np.bincount(word, minlength=len(own))), _zip(where.astype(np.uint16)), _zip(count))
    return pd.DataFrame([_row(counts, seats, seats.totals())], columns=SEATS_NAMES)


def _round(totals: np.ndarray, r: int):
    """Round `r` of every shard, given the totals of all."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                seats = _seats(row)
                seats.step(totals, r >= ROUNDS - KEPT)
                now = seats.totals()
                if r == ROUNDS - 1:
                    tables, upper, upper_tables = seats.means(KEPT)
                    now = _totals(np.bincount(seats.word, seats.count, seats.n_words), upper, upper_tables, seats.ctx, seats.count, tables)
                yield pd.DataFrame([_row(tuple(getattr(row, c) for c in _COUNTS), seats, now)], columns=SEATS_NAMES)

    return run


def _answers(key, asked, held_seats):
    """What a shard tells each block that asked it, pair by pair and word by word."""
    seats = _seats(next(held_seats.itertuples(index=False)))
    tables, upper, upper_tables = seats.means(KEPT)
    tokens = np.bincount(seats.word, seats.count, seats.n_words).astype(np.int64)
    a = (seats.count - DISCOUNT * tables).astype(np.float32)
    b = (upper - PARENT_DISCOUNT * upper_tables).astype(np.float32)
    words, held, ctx = _asked(asked)
    at = np.searchsorted(np.frombuffer(held_seats["words"].iloc[0], np.uint64), np.concatenate(words))
    pair = np.searchsorted(seats.word * CONTEXTS + seats.ctx, np.repeat(at, np.concatenate(held)) * CONTEXTS + ctx)
    rows, i, j = [], 0, 0
    for block, w, h in zip(asked["block"], words, held, strict=True):
        mine, size = at[i : i + len(w)], int(h.sum())
        rows.append((int(block), int(key[0]), _zip(a[pair[j : j + size]]), _zip(b[mine]), _zip(tokens[mine])))
        i, j = i + len(w), j + size
    return pd.DataFrame(rows, columns=["block", "shard", "a", "b", "tokens"])


def _added(batches):
    total = np.zeros(4 + 2 * CONTEXTS)
    for pdf in batches:
        for x in pdf["totals"]:
            total += np.frombuffer(x, np.float64)
    yield pd.DataFrame({"at": np.arange(len(total)), "x": total})


def _added_up(seats: DataFrame) -> np.ndarray:
    """The totals of all shards."""
    totals = np.zeros(4 + 2 * CONTEXTS)
    for at, x in seats.select("totals").mapInPandas(_added, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        totals[at] = x
    return totals


def _scored(n_shards: int, totals: np.ndarray):
    n_tokens, vocabulary, customers, tables = totals[:4]
    in_context, tables_in = totals[4 : 4 + CONTEXTS], totals[4 + CONTEXTS :]

    def run(key, docs, answers):
        tokens = Tokens(docs["text"].tolist())
        pairs = Pairs(tokens, n_shards)
        answers = answers.sort_values("shard")
        a = np.concatenate([_unzip(x, np.float32) for x in answers["a"]]).astype(np.float64)
        b = np.concatenate([_unzip(x, np.float32) for x in answers["b"]]).astype(np.float64)
        seen = np.concatenate([_unzip(x, np.int64) for x in answers["tokens"]])
        parent = (b + (PARENT_STRENGTH + PARENT_DISCOUNT * tables) / (vocabulary + 1)) / (PARENT_STRENGTH + customers)
        p = (a + (STRENGTH + DISCOUNT * tables_in[pairs.ctx]) * parent[pairs.word]) / (STRENGTH + in_context[pairs.ctx])
        size = len(docs)
        add = lambda x: np.bincount(tokens.doc, x, size)
        base = np.log10((seen + 1) / (n_tokens + vocabulary + 1))
        return pd.DataFrame({
            "doc_id": docs["row"], "held_out": docs["held_out"], "n_tokens": np.bincount(tokens.doc, minlength=size), "n_known": add((seen > 0)[pairs.of]).astype(np.int64),
            "train_tokens": np.full(size, int(n_tokens)), "base_score": add(base[pairs.of]), "score": add(np.log10(p)[pairs.pair]),
        })

    return run


def score(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row.

    The model learns from the rows where the column expression `held_out` is false and scores all.
    base_score is the sum of log10((c + 1) / (N + V + 1)) over the tokens, score the model's log10
    probability of the text. A null text is empty and has one token, its end. Rows that repeat an
    id are documents of their own; other columns are not carried.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    own = docs.select(F.col("doc_id").alias("row"), "text", held_out.alias("held_out"), F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"))

    def ask(key, part):
        tokens = Tokens(part["text"].tolist())
        return Pairs(tokens, n).requests(int(key[0]), ~part["held_out"].to_numpy(bool)[tokens.doc])

    with shuffles_dropped(spark):
        asked = stored(own.groupBy("block").applyInPandas(ask, "shard int, block int, words binary, held binary, ctx binary, n binary"), "requests")
        seats = stored(asked.groupBy("shard").applyInPandas(_merged, SEATS), "seats")
        totals = _added_up(seats)
        for r in range(ROUNDS):
            before, seats = seats, stored(seats.mapInPandas(_round(totals, r), SEATS), "seats")
            release(spark, before)
            totals = _added_up(seats)
        answers = stored(asked.groupBy("shard").cogroup(seats.groupBy("shard")).applyInPandas(_answers, "block int, shard int, a binary, b binary, tokens binary"), "answers")
        release(spark, asked, seats)
    told = answers.groupBy("block")
    return own.groupBy("block").cogroup(told).applyInPandas(_scored(n, totals), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
