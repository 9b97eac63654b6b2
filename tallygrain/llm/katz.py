"""Language-model scoring by Katz backoff.

P(w | h) = d_c * c(h, w) / c(h) for an n-gram seen in training, with the Good-Turing discount d_c for counts up to
``cutoff`` and 1 above; else alpha(h) * P(w | h'), h' being h without its first word. alpha(h) shares out exactly what the
discounts leave: (1 - sum of P(w | h) over seen w) / (1 - sum of P(w | h') over the same w). A context never seen has
alpha 1. At the lowest level a word never seen in training is the class <unk>, which gets what the unigram discounts
leave; so each level sums to one over the known words and <unk>. A document starts without context.

Tokens travel as columns of numbers, not as rows. A task turns its documents into chunks: the chunk's distinct words as
sorted 64-bit hashes and its tokens as their ranks by frequency. Level by level, each chunk asks for its distinct n-grams, each
ask goes to the partition of its context, which adds up training counts over all chunks, works out what each context has left,
and answers every chunk: the counts of its n-grams, and once a context its occurrences and its backoff weight, from which the
chunk works out the probabilities. An ask carries whole numbers too: the training count of the n-gram without its first word
and the occurrences of that one's context, which give its probability, because what was seen was seen without its first
word as well. Chunks stay where the task that made them, their home, has written them; only asks and answers move. So a
frequent n-gram is asked once a chunk however often it occurs, and a context so frequent that it would fill a partition is
spread over all of them by its next word, its sums being added up apart. The tables of counts are written by partition to
the shared folder. A home is held as a whole when it is answered: the tokens of one task's input.

Defined cases: a null or empty text is the end token alone; a null doc_id counts as the empty text when folds are told
apart and stays null; repeated rows count and are scored once each; an empty table gives no rows; with nothing to learn from,
every token is <unk> with probability one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import SEED, Scratch, pack, pack_sorted, partitions_for, release, text_bytes, unpack, unpack_sorted

#: Tokens of a chunk, and distinct n-grams of a partition of asks, about.
CHUNK_TOKENS, PART_ASKS = 1_200_000, 1_300_000
#: Documents whose words are told apart at a time.
READ = 2048
#: A document's end. Words are hashed with another seed, so that none is it.
END = np.uint64(xxhash.xxh64_intdigest(b"", SEED + 1))
#: A context with more training occurrences than this share of all is spread over the partitions; so at most this many are.
SPREAD, SPREAD_LEAST = 4000, 1000
NONE = np.int64(-1)

#: An n-gram's id is its place in its partition (a word's, by falling count) times this, plus the partition; 0 is <unk>.
PARTS_MOST = 1 << 20

CHUNK = "chunk long, home int, docs binary, nulls binary, sizes binary, learn binary, words binary, uses binary, tokens binary, n_words long, n_tokens long"
ASK = "part int, chunk long, home int, keys binary, next binary, counts binary, low binary, lowwhole binary"
MERGED = "part int, keys binary, sizes binary, counts binary, low binary, lowwhole binary, chunks array<long>, homes array<int>, places array<binary>"
ANSWER = "chunk long, home int, level int, part int, counts binary, whole binary, alpha binary, ids binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed_columns(**arrays) -> pa.RecordBatch:
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v) for v in arrays.values()], list(arrays))


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def pack_doubles(x: np.ndarray) -> bytes:
    """Doubles of which many are equal: the distinct ones, and each one's place among them."""
    levels, place = np.unique(x, return_inverse=True)
    head = pack(levels)
    return len(head).to_bytes(8, "little") + head + pack(place.astype(np.uint32))


def unpack_doubles(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return unpack(blob[8 : 8 + n], np.float64)[unpack(blob[8 + n :], np.uint32)]


def log10(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log10(x)


# ---- chunks -------------------------------------------------------------------------------------------------------


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of all words, each document's closed by the end; how many each document has). Only A-Z are lowered, and only
    \\x20 and \\x09-\\x0D part words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = pc.list_flatten(lists).dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    digest = xxhash.xxh64_intdigest
    # around white space at either end lie empty words
    own = flat.dictionary.cast(pa.binary()).to_pylist()
    known = np.array([digest(w, SEED) if w else 0 for w in own], np.uint64)
    filled = np.array([bool(w) for w in own], bool)
    at = flat.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    real = filled[at] if len(at) else np.empty(0, bool)
    at, doc = at[real], doc[real]
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    out = np.full(int(sizes.sum()), END, np.uint64)
    out[np.arange(len(at)) + doc] = known[at] if len(at) else 0  # every document before has put its end in
    return out, sizes


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to chunks; a document is never split."""
    base, seq = TaskContext.get().partitionId() << 32, 0
    ids, learn, sizes, hashes, held = [], [], [], [], 0

    def close():
        nonlocal ids, learn, sizes, hashes, held, seq
        words, tokens, uses = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        rank = np.empty(len(words), np.uint32)  # small numbers for frequent words
        rank[np.argsort(-uses, kind="stable")] = np.arange(len(words))
        out = packed_columns(
            chunk=[base + seq],
            home=pa.array([base >> 32], pa.int32()),
            docs=blobs([pack(np.array([i or 0 for i in ids], np.int64))]),
            nulls=blobs([pack(np.array([i is None for i in ids], np.uint8))]),
            sizes=blobs([pack(np.concatenate(sizes).astype(np.int64))]),
            learn=blobs([pack(np.array(learn, np.uint8))]),
            words=blobs([pack_sorted(words)]),
            uses=blobs([pack(uses.astype(np.uint32))]),
            tokens=blobs([pack(rank[tokens], 3)]),
            n_words=pa.array([len(words)], pa.int64()),
            n_tokens=pa.array([len(tokens)], pa.int64()),
        )
        ids, learn, sizes, hashes, held, seq = [], [], [], [], 0, seq + 1
        return out

    for batch in batches:
        docs, folds, a = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
        while a < len(docs):
            b = min(a + READ, len(docs))
            h, n = hashed_words(batch.column(2).slice(a, b - a))
            at = 0
            while at < len(n):  # chunks close where they are full
                upto = np.cumsum(n[at:])
                k = min(int(np.searchsorted(upto, CHUNK_TOKENS - held)) + 1, len(n) - at)
                ids += docs[a + at : a + at + k]
                learn += folds[a + at : a + at + k]
                sizes.append(n[at : at + k])
                hashes.append(h[: upto[k - 1]])
                h, held, at = h[upto[k - 1] :], held + int(upto[k - 1]), at + k
                if held >= CHUNK_TOKENS:
                    yield close()
            a = b
    if ids:
        yield close()


def starts_of(keys: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts, as flags."""
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = keys[1:] != keys[:-1]
        for x in others:
            new[1:] |= x[1:] != x[:-1]
    return new


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, ascending; the place among them of each)."""
    order = np.argsort(x)
    new = starts_of(x[order])
    code = np.empty(len(x), np.uint64)
    code[order] = (np.cumsum(new) - 1).astype(np.uint64)
    return x[order][new], code


#: Two codes as one number.
HALF = np.uint64(32)


def by_part(part: np.ndarray) -> np.ndarray:
    """The order by partition; equal ones stay in theirs."""
    small = len(part) and part.max() < 1 << 16
    return np.argsort(part.astype(np.uint16) if small else part, kind="stable")


class Model:
    """What is known of the levels so far: partitions, spread contexts, discounts by count, and the unigrams."""

    def __init__(self, cutoff: int):
        self.cutoff, self.parts, self.spread, self.d, self.unigram = cutoff, [], [], [], None

    def mass(self, level: int, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.d[level - 1][np.minimum(counts, self.cutoff + 1)] * counts


class Chunk:
    """A chunk, and what its tokens have been told so far of the n-gram each ends: its id and count, its context's
    occurrences, and, where it is to be scored, the log-probability."""

    def __init__(self, row: dict, answers: list[dict], model: Model):
        self.row, self.model = row, model
        self.sizes = unpack(row["sizes"], np.int64)
        self.learn = unpack(row["learn"], np.uint8).astype(bool)
        self.words = unpack_sorted(row["words"], np.uint64) if "words" in row else None  # needed to ask for them only
        by_rank = np.argsort(-unpack(row["uses"], np.uint32).astype(np.int64), kind="stable")
        self.tokens = by_rank[unpack(row["tokens"], np.uint32)]
        starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.place = (np.arange(len(self.tokens)) - np.repeat(starts, self.sizes)).astype(np.int32)  # of a token in its document
        self.trains = np.repeat(self.learn, self.sizes)
        self.level, self.whole = 0, None
        for level in range(1, len(model.parts) + 1):
            self.hear(level, sorted((a for a in answers if a["level"] == level), key=lambda a: a["part"]))

    def asks(self, level: int):
        """(keys, next, which ask each token has or -1): the level's distinct n-grams, sorted by key and next."""
        if level == 1:
            return self.words, None, self.tokens
        context = np.concatenate(([-1], self.which[:-1]))  # the ask of the token before, which is the context
        at = np.flatnonzero((self.place >= level - 1) & (context >= 0))
        at = at[self.ask_ids[context[at]] >= 0]
        ids, code = coded(self.ask_ids)
        both = code[context[at]] << HALF | self.word_codes[at]
        del code, context
        order = np.argsort(both)
        both = both[order]
        new = starts_of(both)
        which = np.full(len(self.tokens), -1)
        which[at[order]] = np.cumsum(new) - 1
        both = both[new]
        del at, order, new
        return ids[both >> HALF], self.code_ids[both & np.uint64((1 << 32) - 1)], which

    def parts_of(self, level: int, keys: np.ndarray, nxt: np.ndarray | None, parts: int) -> np.ndarray:
        """Where asks go: by their context, or, if that is spread, by context and next word. A context of several words goes where
        it was counted itself, so that the ids of a message lie close to each other however many partitions there are."""
        if level == 1:  # ranges of hashes, so that answers come in the words' order
            return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        if level > 2 and parts == self.model.parts[level - 2]:
            own = keys % PARTS_MOST
            wide = np.isin(keys, self.model.spread[level - 2])
            if wide.any():
                h = (keys[wide].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + nxt[wide].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                own[wide] = ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            return own
        h = keys.astype(np.uint64)
        wide = np.isin(keys, self.model.spread[level - 2])
        h = np.where(wide, h * np.uint64(0x9E3779B97F4A7C15) + nxt.astype(np.uint64), h)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)

    def hear(self, level: int, answers: list[dict]) -> None:
        keys, nxt, which = self.asks(level)
        if level == 1:
            counts = np.concatenate([unpack(a["counts"], np.int64) for a in answers])
            ids = np.concatenate([unpack(a["ids"], np.int64) for a in answers])
            own = np.where(counts > 0, ids, 0)  # 0 is <unk>
            by_id, codes = coded(own)
            self.word_codes, self.code_ids = codes[which], by_id  # codes ascend with ids, so asks lie as partitions sort them
            self.ask_ids = np.where(counts > 0, ids, NONE)
            self.word_counts = self.count = counts[which]
            self.log = self.model.unigram(counts)[which]
        elif len(keys):
            part = self.parts_of(level, keys, nxt, self.model.parts[level - 1])
            order = by_part(part)
            context = np.cumsum(starts_of(keys[order], part[order])) - 1
            place = np.empty(len(keys), np.int64)  # of an ask among the answers
            place[order] = np.arange(len(keys))
            counts = np.concatenate([unpack(a["counts"], np.int64) for a in answers])
            whole = np.concatenate([unpack(a["whole"], np.int64) for a in answers])
            got = np.flatnonzero(which >= 0)
            mine = place[which[got]]
            own, inside = counts[mine], whole[context[mine]]
            seen = own > 0
            if all(a["alpha"] for a in answers):  # of the contexts after which something was not seen
                alpha = np.zeros(len(whole))
                alpha[np.unique(context[counts == 0])] = np.concatenate([unpack_doubles(a["alpha"]) for a in answers])
                self.log[got] = np.where(seen, log10(self.model.mass(level, own) / np.maximum(inside, 1)), alpha[context[mine]] + self.log[got])
            self.ask_ids = np.full(len(keys), NONE)
            if any(a["ids"] for a in answers):
                ids = np.full(len(counts), NONE)
                ids[counts > 0] = np.concatenate([unpack_sorted(a["ids"], np.int64) for a in answers])
                self.ask_ids = ids[place]
            self.count, self.whole = np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
            self.count[got], self.whole[got] = own, inside
        else:
            self.ask_ids = np.empty(0, np.int64)
        self.level, self.which = level, which

    def messages(self, parts: int) -> Iterator[pa.RecordBatch]:
        """The next level's asks, one row for each partition that gets any."""
        level = self.level + 1
        keys, nxt, which = self.asks(level)
        if not len(keys):
            return
        got = np.flatnonzero(which >= 0)
        ask = which[got]
        counts = np.bincount(ask[self.trains[got]], minlength=len(keys))
        part = self.parts_of(level, keys, nxt, parts)
        order = by_part(part)
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        low = whole = None
        if level > 1:
            low = np.zeros(len(keys), np.int64)
            low[ask] = self.count[got]
            low[counts == 0] = 0  # only what is seen in training is added up
        if level > 2:
            # the occurrences of the context without its first word: the one that the next word's shorter n-gram has
            whole = np.zeros(len(keys), np.int64)
            whole[ask] = self.whole[got]
        for p in np.unique(part):
            at = order[edges[p] : edges[p + 1]]
            yield packed_columns(
                part=pa.array([p], pa.int32()),
                chunk=[self.row["chunk"]],
                home=pa.array([self.row["home"]], pa.int32()),
                keys=blobs([pack_sorted(keys[at])]),
                next=blobs([pack(nxt[at]) if level > 1 else b""]),
                counts=blobs([pack(counts[at])]),
                low=blobs([pack(low[at]) if level > 1 else b""]),
                lowwhole=blobs([pack(whole[at][starts_of(keys[at])]) if level > 2 else b""]),
            )


# ---- partitions of n-grams ----------------------------------------------------------------------------------------


def merge_part(level: int):
    """A partition's asks to one row: distinct n-grams by context and next word with summed counts, and for each chunk the
    places of its asks. Next words have done their part then; of contexts, the distinct ones and their sizes stay."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.select(["chunk", "home", "keys", "next", "counts", "low", "lowwhole"]).to_pylist()]
        rows.sort(key=lambda r: r["chunk"])
        all_keys = [unpack_sorted(r["keys"], np.uint64 if level == 1 else np.int64) for r in rows]
        k = np.concatenate(all_keys)
        nxt = np.concatenate([unpack(r["next"], np.int64) for r in rows]) if level > 1 else None
        heads, place = coded(k)
        if level > 1:
            both, place = coded(place << HALF | coded(nxt)[1])
            context = both >> HALF
            del both, nxt
        else:
            context = np.arange(len(heads), dtype=np.uint64)
        place = place.astype(np.int64)
        first = starts_of(context)
        total = np.bincount(place, np.concatenate([unpack(r["counts"], np.int64) for r in rows])).astype(np.int64)
        low = whole = np.empty(0, np.int64)
        if level > 1:
            low, told = np.zeros(len(total), np.int64), np.concatenate([unpack(r["low"], np.int64) for r in rows])
            low[place[told > 0]] = told[told > 0]
        if level > 2:
            told = np.concatenate([unpack(r["lowwhole"], np.int64)[np.cumsum(starts_of(x)) - 1] for r, x in zip(rows, all_keys)])
            whole = np.zeros(len(total), np.int64)
            whole[place] = told
            whole = whole[first]
        places = np.split(place, np.cumsum([len(x) for x in all_keys])[:-1])
        yield packed_columns(
            part=pa.array([key[0].as_py()], pa.int32()),
            keys=blobs([pack_sorted(heads) if level > 1 else b""]),
            sizes=blobs([pack(np.diff(np.append(np.flatnonzero(first), len(context)))) if level > 1 else b""]),
            counts=blobs([pack(total)]),
            low=blobs([pack(low)]),
            lowwhole=blobs([pack(whole)]),
            chunks=pa.array([[r["chunk"] for r in rows]], pa.list_(pa.int64())),
            homes=pa.array([[r["home"] for r in rows]], pa.list_(pa.int32())),
            places=pa.array([[pack_sorted(p.astype(np.uint32)) for p in places]], pa.list_(pa.binary())),
        )

    return run


def lower_of(row: dict, level: int, model: Model, group: np.ndarray) -> np.ndarray:
    """The probability of each n-gram without its first word, where it is seen in training, else 0."""
    low = unpack(row["low"], np.int64)
    if level == 2:
        return model.unigram.p(low)
    return model.mass(level - 1, low) / np.maximum(unpack(row["lowwhole"], np.int64), 1)[group]


def figures(level: int, model: Model, spread: np.ndarray):
    """Of each partition: how many n-grams have each count up to cutoff + 1, all counts, distinct seen ones; and, for each
    spread context, its training occurrences by count class and the lower probabilities of its seen continuations."""
    cutoff = model.cutoff

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total = unpack(row["counts"], np.int64)
                hist = np.bincount(np.minimum(total, cutoff + 2), minlength=cutoff + 3)
                out = [("count", c, float(hist[c])) for c in range(1, cutoff + 2)]
                out += [("tokens", 0, float(total.sum())), ("distinct", 0, float((total > 0).sum()))]
                if level > 1 and len(spread):
                    heads, sizes = unpack_sorted(row["keys"], np.int64), unpack(row["sizes"], np.int64)
                    group = np.repeat(np.arange(len(heads)), sizes)
                    at = np.flatnonzero(np.isin(heads, spread)[group] & (total > 0))
                    which = np.searchsorted(spread, heads[group[at]])
                    sums = np.bincount(which, lower_of(row, level, model, group)[at], len(spread))
                    for c in range(1, cutoff + 2):
                        mass = np.bincount(which, np.where(np.minimum(total[at], cutoff + 1) == c, total[at], 0), len(spread))
                        out += [(f"spread{c}", int(spread[i]), float(mass[i])) for i in np.flatnonzero(mass)]
                    out += [("lower", int(spread[i]), float(sums[i])) for i in np.flatnonzero(sums)]
                kind, k, n = zip(*out)
                yield packed_columns(kind=list(kind), key=pa.array(k, pa.int64()), n=list(n))

    return run


def frequent(level: int, least: float):
    """Ids of the n-grams that occur more than ``least`` times in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                total = unpack(row["counts"], np.int64)
                at = np.flatnonzero(total > least)
                yield packed_columns(id=ids_of(ranks(total)[at] if level == 1 else at, row["part"]))

    return run


def ranks(total: np.ndarray) -> np.ndarray:
    """Places by falling count: small numbers for frequent words."""
    out = np.empty(len(total), np.int64)
    out[np.argsort(-total, kind="stable")] = np.arange(len(total))
    return out


def ids_of(places: np.ndarray, part: int) -> np.ndarray:
    return (places.astype(np.int64) + 1) * PARTS_MOST + part


def discounts(counts: dict[int, float], cutoff: int) -> np.ndarray:
    """Good-Turing discount factors for counts 0 .. cutoff + 1 (1 above the cutoff), by Katz's formula.

    Where the counts of counts do not allow them - a factor outside (0, 1] or a zero count - the count keeps the factor of
    absolute discounting, so that something is always left for what was not seen.
    """
    n = [0.0] + [counts.get(c, 0.0) for c in range(1, cutoff + 2)]
    d = np.ones(cutoff + 2)
    plain = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    tail = (cutoff + 1) * n[cutoff + 1] / n[1] if n[1] else 0.0
    for c in range(1, cutoff + 1):
        good = 0.0
        if n[c] and n[c + 1] and tail < 1:
            good = ((c + 1) * n[c + 1] / (c * n[c]) - tail) / (1 - tail)
        d[c] = good if 0 < good < 1 else 1 - plain / c
    return d


def shares(total: np.ndarray, group: np.ndarray, mass: np.ndarray, occurs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each n-gram given its context, what each context has left).

    A context all of whose counts are above the cutoff has nothing discounted; it gives what one more occurrence would.
    """
    full = found >= occurs * (1 - 1e-12)
    whole = occurs + full
    return np.where(total > 0, mass / np.maximum(whole, 1)[group], 0.0), np.where(full, 1.0 / np.maximum(whole, 1), 1 - found / np.maximum(occurs, 1))


class Unigram:
    """P of words by their training count, and log10 of it with <unk> for 0."""

    def __init__(self, cutoff: int, d: np.ndarray, tokens: float, found: float):
        self.cutoff, self.d = cutoff, d
        full = found >= tokens * (1 - 1e-12)
        self.whole = max(tokens + full, 1)
        self.unknown = (1.0 / self.whole if full else 1 - found / tokens) if tokens else 1.0

    def p(self, total: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(total, self.cutoff + 1)] * total / self.whole

    def __call__(self, total: np.ndarray) -> np.ndarray:
        return np.where(total > 0, log10(self.p(total)), np.log10(self.unknown))


def answers(level: int, more: bool, scoring: bool, model: Model, spread: dict[int, tuple[float, float, float]]):
    """Each chunk's asks answered: training counts; of their contexts the occurrences (one more where nothing is discounted)
    and, for scoring and where something was not seen after them, the logarithm of the backoff weight; for more levels, the ids
    of n-grams that were seen.

    spread: context -> (occurrences, discounted mass, lower mass of its seen continuations), added up over all partitions.
    """

    def contexts(row, total):
        heads, sizes = unpack_sorted(row["keys"], np.int64), unpack(row["sizes"], np.int64)
        group = np.repeat(np.arange(len(heads)), sizes)
        mass = model.mass(level, total)
        occurs, found = np.bincount(group, total, len(heads)), np.bincount(group, mass, len(heads))
        below = np.bincount(group, np.where(total > 0, lower_of(row, level, model, group), 0.0), len(heads))
        for i in np.flatnonzero(np.isin(heads, list(spread))) if spread else ():
            occurs[i], found[i], below[i] = spread[int(heads[i])]
        # all of whose counts are above the cutoff have nothing discounted; they give what one more occurrence would
        full = found >= occurs * (1 - 1e-12)
        whole = occurs + full
        left = np.where(full, 1.0 / np.maximum(whole, 1), 1 - found / np.maximum(occurs, 1))
        alpha = np.where(occurs > 0, left / np.maximum(1 - below, 1e-300), 1.0)
        return group, whole.astype(np.int64), log10(alpha)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                total = unpack(row["counts"], np.int64)
                group, whole, alpha = contexts(row, total) if level > 1 else (None, None, None)
                rank = ranks(total) if level == 1 else None
                for chunk, home, places in zip(row["chunks"], row["homes"], row["places"]):
                    at = unpack_sorted(places, np.uint32)
                    unseen = total[at] == 0
                    asked = group[at][starts_of(group[at])] if level > 1 else None
                    open_ = group[at][unseen] if level > 1 and scoring else None
                    ids = ids_of(rank[at], row["part"]) if level == 1 else ids_of(at[~unseen], row["part"])
                    yield packed_columns(
                        chunk=[chunk],
                        home=pa.array([home], pa.int32()),
                        level=pa.array([level], pa.int32()),
                        part=pa.array([row["part"]], pa.int32()),
                        counts=blobs([pack(total[at])]),
                        whole=blobs([pack(whole[asked]) if level > 1 else b""]),
                        alpha=blobs([pack_doubles(alpha[open_][starts_of(open_)]) if open_ is not None else b""]),
                        ids=blobs([pack(ids) if level == 1 else pack_sorted(ids) if more else b""]),
                    )

    return run


# ---- the whole ----------------------------------------------------------------------------------------------------


def score_katz(docs: DataFrame, held_out, order: int = 3, cutoff: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score of every document.

    held_out: given the name of the id column, the condition for documents that are scored but not learnt from.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "katz", frees=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", (~F.col("held_out")).cast("int").alias("learn"), "text")
    chunks = scratch.save(rows.mapInArrow(chunked, CHUNK), "chunks")
    size = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    model = Model(cutoff)
    merged: list[DataFrame] = []
    sums: list[dict[int, tuple[float, float, float]]] = []
    tokens = distinct = 0.0

    def told(run, schema, scoring: bool):
        """run(chunk) for every chunk with all it has been answered so far."""
        if not merged:
            def alone(batches):
                for batch in batches:
                    for i in range(batch.num_rows):
                        yield from run(Chunk(batch.slice(i, 1).to_pylist()[0], [], model))

            return chunks.mapInArrow(alone, schema)

        def both(key, left, right):
            said: dict[int, list[dict]] = {}
            for a in right.to_pylist():
                said.setdefault(a["chunk"], []).append(a)
            out = [b for i in range(left.num_rows) for row in left.slice(i, 1).to_pylist() for b in run(Chunk(row, said.pop(row["chunk"], []), model))]
            return pa.Table.from_batches(out, out[0].schema if out else empty)

        empty = pa.schema([])
        said = None
        for i, m in enumerate(merged):
            more = i + 1 < order
            one = m.mapInArrow(answers(i + 1, more, scoring, model, sums[i]), ANSWER)
            said = one if said is None else said.unionByName(one)
        return chunks.groupBy("home").cogroup(said.groupBy("home")).applyInArrow(both, schema)

    for level in range(1, order + 1):
        n = min(partitions_for(size[0] if level == 1 else size[1], PART_ASKS), PARTS_MOST)
        asks = told(lambda c, n=n: c.messages(n), ASK, False)
        asks = asks.groupBy("part").applyInArrow(merge_part(level), MERGED)
        table = scratch.save(asks, f"merged{level}")
        del asks
        release(spark)
        wide = model.spread[-1] if level > 1 else np.empty(0, np.int64)
        got = table.drop("chunks", "homes", "places").mapInArrow(figures(level, model, wide), "kind string, key long, n double")
        stats = {(r.kind, r.key): r.n for r in got.groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()}  # a bounded table
        counts = {c: stats.get(("count", c), 0.0) for c in range(1, cutoff + 2)}
        d = discounts(counts, cutoff)
        if level == 1:
            tokens, distinct = stats.get(("tokens", 0), 0.0), stats.get(("distinct", 0), 0.0)
            model.unigram = Unigram(cutoff, d, tokens, tokens - sum((1 - d[c]) * c * counts[c] for c in range(1, cutoff + 1)))
            chunks = scratch.save_homes(chunks.drop("words"), "tokens", "home")  # the words have asked
            scratch.drop("chunks")
        own = {}
        for k in wide:
            by = [0.0, *(stats.get((f"spread{c}", int(k)), 0.0) for c in range(1, cutoff + 2))]
            own[int(k)] = (sum(by), float(sum(d[c] * by[c] for c in range(1, cutoff + 2))), stats.get(("lower", int(k)), 0.0))
        sums.append(own)
        merged.append(table)
        model.d.append(d)
        model.parts.append(n)
        if level < order:
            often = table.select("part", "counts").mapInArrow(frequent(level, max(tokens / SPREAD, SPREAD_LEAST)), "id long").collect()  # SPREAD at most
            model.spread.append(np.sort(np.array([r.id for r in often], np.int64)))

    def score(c: Chunk) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.cumsum(c.sizes)[:-1]))
        base = np.log10((c.word_counts + 0.1) / (tokens + 0.1 * (distinct + 1)))
        nulls = unpack(c.row["nulls"], np.uint8).astype(bool)
        yield packed_columns(
            doc_id=pa.array(unpack(c.row["docs"], np.int64), mask=nulls),
            held_out=~c.learn,
            n_tokens=c.sizes,
            n_known=np.add.reduceat((c.word_counts > 0).astype(np.int64), starts),
            train_tokens=np.full(len(starts), int(tokens), np.int64),
            base_score=np.add.reduceat(base, starts),
            score=np.add.reduceat(c.log, starts),
        )

    return told(score, SCORED, True)
