"""Removal of repeated passages by merged Burrows-Wheeler transforms.

A byte goes when it lies in a ``width``-byte string that also starts in a document with a smaller doc_id.

1. Every window of ``width`` bytes has a key: the smallest hash of the k-byte strings inside it, so equal windows have equal
   keys. Tasks ask, each key once a chunk of documents, which keys occur in more than one document.
2. Such a key has a home, the first chunk that has it. Stretches of consecutive windows with one home travel to it, each
   distinct stretch of a chunk once, so that equal windows meet. There, shards of stretches get a suffix array and
   Burrows-Wheeler transform each, and the transforms are merged by refining the interleave of the shards round by round:
   after round h it is sorted by the first h bytes, and the places where blocks of equal h-byte prefixes part give the
   common prefixes. Blocks that still hold together after ``width`` rounds are the repeated intervals; no suffix is sorted
   again. The smallest doc_id of a window's block goes back to every asker.
3. Chunks mark what a smaller document has, and tell the rest.

A key with many occurrences is its own destination, one with very many sends each window by a hash of all its bytes, and
what still comes to much in one place is merged there in lots, by key. A task holds the asks of its own partition: each distinct
stretch once, and a number for each time that a chunk asks for it.

Defined cases: a null text is empty; a document shorter than ``width`` bytes loses nothing; a row with a null doc_id counts
as larger than every document and takes nothing from others; rows that share a doc_id take nothing from each other; an
empty table gives no rows; other columns are ignored, whatever their names. A document is never split between chunks, so a
task needs memory for the longest one.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrain.llm.common import Scratch, pack, pack_sorted, partitions_for, text_bytes, unpack, unpack_sorted

#: Bytes of a chunk; keys and stretch bytes of a partition, about.
CHUNK_BYTES, PART_KEYS, PART_BYTES = 2 << 20, 1_000_000, 6 << 20
#: Occurrences above which a key is its own destination, and above which its windows are.
OWN_PLACE, SPREAD = 100, 20_000
#: Shards of transforms that are merged at a time, and the bytes they hold.
SHARDS, MERGE_BYTES = 16, 2 << 20
#: Bytes whose hashes give a window its key.
KEY_BYTES = 24
LAST = np.int64((1 << 63) - 1)

CHUNK = "chunk long, docs binary, nulls binary, sizes binary, body binary, n_bytes long"


def record(**arrays) -> pa.RecordBatch:
    return pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v) for v in arrays.values()], list(arrays))


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, seq = TaskContext.get().partitionId() << 32, 0
    docs, nulls, bodies, held = [], [], [], 0

    def close():
        return record(
            chunk=[base + seq],
            docs=blobs([pack(np.array(docs, np.int64))]),
            nulls=blobs([pack(np.array(nulls, np.uint8))]),
            sizes=blobs([pack(np.array([len(b) for b in bodies], np.int64))]),
            body=blobs([squeeze(b"".join(bodies))]),
            n_bytes=pa.array([held], pa.int64()),
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = text_bytes(text.as_py())
            if held and held + len(body) > CHUNK_BYTES:
                yield close()
                docs, nulls, bodies, held, seq = [], [], [], 0, seq + 1
            docs.append(LAST if doc is None else doc)
            nulls.append(doc is None)
            bodies.append(body)
            held += len(body)
    if docs:
        yield close()


def strings_hash(data: np.ndarray, length: int) -> np.ndarray:
    """A polynomial hash of every string of ``length`` bytes, from those of 1, 2, 4, .. bytes."""
    base = 0x9E3779B97F4A7C15
    n = len(data) - length + 1
    part = data.astype(np.uint64)
    part += np.uint64(1)
    out, done, size = None, 0, 1
    while True:
        if length & size:  # the shorter parts stand behind
            if out is None:
                out = part[length - size : length - size + n].copy()
            else:
                out += part[length - done - size : length - done - size + n] * np.uint64(pow(base, done, 1 << 64))
            done += size
        if done == length:
            return out
        longer = part[:-size] * np.uint64(pow(base, size, 1 << 64))
        longer += part[size:]
        part, size = longer, 2 * size


def window_keys(data: np.ndarray, width: int) -> np.ndarray:
    """For every window, the smallest hash of the KEY_BYTES-byte strings in it."""
    least = mixed(strings_hash(data, KEY_BYTES))
    span, have, n = width - KEY_BYTES + 1, 1, len(data) - width + 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    return np.minimum(least[:n], least[span - have : span - have + n])


class Chunk:
    def __init__(self, row: dict, width: int):
        self.row, self.width = row, width
        self.docs, self.sizes = unpack(row["docs"], np.int64), unpack(row["sizes"], np.int64)
        self.body = expand(row["body"])
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(self.body, np.uint8)

    def windows(self) -> None:
        """Where windows inside one document start, their keys, and whose they are."""
        n = len(self.data) - self.width + 1
        if n <= 0:
            self.at, self.owner, self.key = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64)
            return
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.at = np.flatnonzero(owner[:n] == owner[self.width - 1 :])
        self.key, self.owner = window_keys(self.data, self.width)[self.at], owner[self.at]

    def runs(self, key: np.ndarray) -> np.ndarray:
        """Where stretches of consecutive windows with one key begin, in ``at``."""
        if not len(key):
            return np.empty(0, np.int64)
        return np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (self.at[1:] != self.at[:-1] + 1))))

    def keys(self):
        """Distinct keys, ascending, in how many stretches each occurs, and whether in more than one document."""
        self.windows()
        begin = self.runs(self.key)
        key, owner = self.key[begin], self.owner[begin]
        order = np.lexsort((owner, key))
        k, o = key[order], owner[order]
        new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(k)))
        several = o[first] != o[first + counts - 1] if len(k) else np.empty(0, bool)
        return k[first], counts, several

    def key_asks(self, parts: int) -> Iterator[pa.RecordBatch]:
        k, counts, several = self.keys()
        part = (k % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.unique(part):
            at = order[edges[p] : edges[p + 1]]
            yield record(part=pa.array([p], pa.int32()), chunk=[self.row["chunk"]], keys=blobs([pack_sorted(k[at])]), counts=blobs([pack(counts[at].astype(np.uint32))]), several=blobs([np.packbits(several[at]).tobytes()]))

    def stretches(self, answers: list[dict], parts: int):
        """The distinct stretches of windows whose key occurs in several documents, their destinations and smallest
        doc_ids; and for each stretch, in order, its first window, its windows, its document, and which one it is."""
        k, _, _ = self.keys()
        order = np.argsort((k % np.uint64(parts)).astype(np.int64), kind="stable")
        told = np.zeros(len(k), np.int64)
        if len(k):
            told[order] = np.concatenate([unpack(a["told"], np.int64) for a in sorted(answers, key=lambda a: a["part"])])
        begin = self.runs(self.key)
        times = np.diff(np.append(begin, len(self.key)))
        to = np.repeat(told[np.searchsorted(k, self.key[begin])], times) if len(k) else told
        hit = np.flatnonzero(to)
        at, owner, to = self.at[hit], self.owner[hit], to[hit]
        place = np.where(to > 0, to.astype(np.uint64), self.key[hit])
        spread = np.flatnonzero(to == -2)
        if len(spread):
            place[spread] = mixed(strings_hash(self.data, self.width)[at[spread]])
        begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))) if len(at) else np.empty(0, np.int64)
        count = np.diff(np.append(begin, len(at)))
        first, who = at[begin], owner[begin]
        number: dict[bytes, int] = {}
        body, which = self.body, np.empty(len(begin), np.int64)
        for i, (a, n) in enumerate(zip(first.tolist(), (count + self.width - 1).tolist())):
            which[i] = number.setdefault(body[a : a + n], len(number))
        least = np.full(len(number), LAST)
        np.minimum.at(least, which, self.docs[who])
        places = np.zeros(len(number), np.uint64)
        places[which] = place[begin]
        return list(number), places, least, first, count, who, which

    def stretch_asks(self, answers: list[dict], parts: int, spread_parts: int) -> Iterator[pa.RecordBatch]:
        """Asks by destination; and, as part -1, what the chunk has to remember until they are answered."""
        found, places, least, first, count, who, which = self.stretches(answers, parts)
        part = stretch_part(places, spread_parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(spread_parts + 1))
        lengths = np.array([len(f) for f in found], np.int64)
        own = dict(first=pack(first), count=pack(count), who=pack(who.astype(np.int32)), which=pack(which), lengths=pack(lengths), part=pack(part))
        yield record(part=pa.array([-1], pa.int32()), chunk=[self.row["chunk"]], lengths=blobs([own["lengths"]]), body=blobs([own["first"]]), places=blobs([own["part"]]), least=blobs([own["count"]]), who=blobs([own["who"]]), which=blobs([own["which"]]))
        for p in np.unique(part):
            at = order[edges[p] : edges[p + 1]]
            yield record(part=pa.array([p], pa.int32()), chunk=[self.row["chunk"]], lengths=blobs([pack(lengths[at])]), body=blobs([squeeze(b"".join(found[i] for i in at))]), places=blobs([pack(places[at])]), least=blobs([pack(least[at])]), who=blobs([b""]), which=blobs([b""]))

    def cleaned(self, own: dict, answers: list[dict]) -> Iterator[pa.RecordBatch]:
        """One row for each document: what is removed, and the hash of the rest."""
        first, times, who, which = unpack(own["body"], np.int64), unpack(own["least"], np.int64), unpack(own["who"], np.int32), unpack(own["which"], np.int64)
        counts = unpack(own["lengths"], np.int64) - self.width + 1  # windows of the distinct stretches
        order = np.argsort(unpack(own["places"], np.int64), kind="stable")
        offsets = np.cumsum(counts) - counts
        least = np.full(int(counts.sum()), LAST)
        if answers:
            flat = np.concatenate([unpack(a["told"], np.int64) for a in sorted(answers, key=lambda a: a["part"])])
            sent = counts[order]
            least[np.repeat(offsets[order] - (np.cumsum(sent) - sent), sent) + np.arange(len(flat))] = flat
        step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        gone = least[np.repeat(offsets[which], times) + step] < np.repeat(self.docs[who], times)
        at = (np.repeat(first, times) + step)[gone]
        edge = np.bincount(at, minlength=len(self.body) + 1) - np.bincount(at + self.width, minlength=len(self.body) + 1)
        removed = np.cumsum(edge)[:-1] > 0
        out = []
        for a, b in zip(self.starts.tolist(), self.ends.tolist()):
            r = removed[a:b]
            n = int(r.sum())
            kept = self.data[a:b][~r].tobytes() if n else self.body[a:b]
            spans = int(r[0]) + int((r[1:] & ~r[:-1]).sum()) if n else 0
            out.append((b - a, n, spans, hashlib.sha256(kept).hexdigest()))
        n_bytes, n_removed, n_spans, sha = zip(*out)
        nulls = unpack(self.row["nulls"], np.uint8).astype(bool)
        yield record(doc_id=pa.array(self.docs, mask=nulls), n_bytes=list(n_bytes), n_removed=list(n_removed), n_spans=list(n_spans), kept_sha256=list(sha))


def stretch_part(places: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(places) % np.uint64(parts)).astype(np.int64)


def tell_keys(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key of each asker: 0 in one document only; else its home (a number above 0), or -1 if the key is its own
    destination, or -2 if each of its windows is."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["chunk"])
    keys = [unpack_sorted(r["keys"], np.uint64) for r in rows]
    asker = np.repeat(np.array([r["chunk"] for r in rows], np.int64), [len(k) for k in keys])
    _, first, place, askers = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
    counts = np.bincount(place, np.concatenate([unpack(r["counts"], np.uint32) for r in rows]))
    several = np.bincount(place, np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8))[: len(k)] for r, k in zip(rows, keys)])) > 0
    to = np.where(counts > SPREAD, -2, np.where(counts > OWN_PLACE, -1, asker[first] + 1))
    told = np.where((askers > 1) | several, to, 0)[place]
    for r, t in zip(rows, np.split(told, np.cumsum([len(k) for k in keys])[:-1])):
        yield record(chunk=[r["chunk"]], part=pa.array([key[0].as_py()], pa.int32()), told=blobs([pack(t)]))


# ---- transforms ---------------------------------------------------------------------------------------------------


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of small codes; bytes by counting."""
    if x.dtype == np.uint8:
        return pc.array_sort_indices(pa.array(x)).to_numpy().view(np.int64)
    return np.argsort(x, kind="stable")


def transform(stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of stretches, each ended by a terminator of its own: symbol 0, smaller than
    the bytes (which count as byte + 1), in order of the stretches."""
    lengths = np.array([len(s) + 1 for s in stretches])
    ends = np.cumsum(lengths) - 1
    text = np.frombuffer(b"\0".join(stretches) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    text[ends] = 0
    n, size = len(text), 7
    end = np.repeat(ends, lengths)
    left = end - np.arange(n)  # symbols before the terminator
    padded = np.concatenate((text, np.zeros(size, np.uint16))).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(size):
        key *= 257
        key += padded[j : j + n] * (left >= j)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is where it begins
    slots = np.arange(n)
    while True:  # prefix doubling, among suffixes that are not alone yet
        alone = new & np.append(new[1:], True)
        slots, new = slots[~alone], new[~alone]
        if not len(slots):
            break
        at = order[slots]
        # what reaches the terminator is told apart by it
        after = np.where(left[at] < size, end[at] - n, rank[np.minimum(at + size, n - 1)])
        own = rank[at]
        by = np.lexsort((after, own)) if len(at) < 64 else np.argsort(own * (2 * n + 1) + after + n, kind="stable")
        at, own, after = at[by], own[by], after[by]
        order[slots] = at
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])))
        rank[at] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        size *= 2
    starts = np.zeros(n, bool)
    starts[ends - lengths + 1] = True
    return order, np.where(starts[order], np.uint16(0), text[order - 1])


def merged_blocks(transforms: list[np.ndarray], width: int) -> list[np.ndarray]:
    """For each shard's rows, the block of the merged order they lie in: equal for suffixes with ``width`` equal symbols.

    Round by round the interleave z (which shard the next row comes from) is refined: taking the rows in the order so far,
    their symbols before, stably sorted, give the order by one symbol more. Terminators stay first, each a block.
    """
    sizes = [len(t) for t in transforms]
    symbols = np.concatenate(transforms)
    used = np.flatnonzero(np.bincount(symbols, minlength=258))
    code = np.zeros(258, np.uint8 if len(used) <= 256 else np.uint16)
    code[used] = np.arange(len(used))
    symbols = code[symbols]
    shard = np.arange(len(transforms)).astype(np.uint8 if len(transforms) <= 256 else np.uint32)
    ends = np.repeat(shard, [int((t == 0).sum()) for t in transforms])
    z = np.repeat(shard, sizes)
    m, n = len(ends), len(symbols)
    block, before = np.zeros(n, np.int32), 0
    sym = np.empty_like(symbols)
    new = np.ones(n, bool)
    for _ in range(width):
        sym[stable_order(z)] = symbols
        order = stable_order(sym)[m:]
        s, b = sym[order], block[order]
        np.not_equal(s[1:], s[:-1], out=new[m + 1 :])
        new[m + 1 :] |= b[1:] != b[:-1]
        z = np.concatenate((ends, z[order]))
        block = np.cumsum(new, dtype=np.int32)
        count = int(block[-1])
        if count == before:
            break
        before = count
    rows = np.empty(n, np.int32)
    rows[:] = block[stable_order(z)]
    return np.split(rows, np.cumsum(sizes)[:-1])


def window_owners(stretches: list[bytes], least: np.ndarray, width: int) -> list[np.ndarray]:
    """For each stretch, the smallest doc_id that has each of its windows, by merging the shards' transforms.

    Stretches are dealt out to the shards in turn, so that copies, which come together, part.
    """
    shards = [list(range(i, len(stretches), SHARDS)) for i in range(min(SHARDS, len(stretches)))]
    built = [transform([stretches[i] for i in shard]) for shard in shards]
    blocks = merged_blocks([t for _, t in built], width)
    groups: list[np.ndarray] = [np.empty(0, np.int32)] * len(stretches)
    for shard, (order, _), rows in zip(shards, built, blocks):
        by_text = np.empty(len(order), np.int32)
        by_text[order] = rows
        at = 0
        for i in shard:
            n = len(stretches[i])
            groups[i] = by_text[at : at + n - width + 1]
            at += n + 1
    windows = np.array([len(g) for g in groups])
    group = np.concatenate(groups)
    owner = np.full(int(group.max()) + 1, LAST)
    np.minimum.at(owner, group, np.repeat(least, windows))
    return np.split(owner[group], np.cumsum(windows)[:-1])


def owners_in_lots(stretches: list[bytes], least: np.ndarray, width: int) -> list[np.ndarray]:
    """``window_owners`` of what is too much for one merge: cut again by key, and merged lot by lot."""
    lots = partitions_for(4 * sum(map(len, stretches)), MERGE_BYTES)
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in range(lots)]
    out = []
    for i, s in enumerate(stretches):
        key = mixed(window_keys(np.frombuffer(s, np.uint8), width)) % np.uint64(lots)
        out.append(np.empty(len(key), np.int64))
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for a, b, lot in zip(begin.tolist(), np.append(begin[1:], len(key)).tolist(), key[begin].tolist()):
            pieces[lot].append((i, a, b))
    for lot in pieces:
        number: dict[bytes, int] = {}
        which = [number.setdefault(stretches[i][a : b + width - 1], len(number)) for i, a, b in lot]
        if not lot:
            continue
        small = np.full(len(number), LAST)
        np.minimum.at(small, which, least[[i for i, _, _ in lot]])
        owners = window_owners(list(number), small, width)
        for (i, a, b), w in zip(lot, which):
            out[i][a:b] = owners[w]
    return out


def tell_windows(width: int):
    """For each stretch of each asker, the smallest doc_id that has each window."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}
        least: list[int] = []
        place: list[int] = []
        askers = []
        for row in sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["chunk"]):
            body, mine, a = expand(row["body"]), [], 0
            for n, to, d in zip(unpack(row["lengths"], np.int64).tolist(), unpack(row["places"], np.uint64).tolist(), unpack(row["least"], np.int64).tolist()):
                i = number.setdefault(body[a : a + n], len(number))
                if i == len(least):
                    least.append(d)
                    place.append(to)
                elif d < least[i]:
                    least[i] = d
                mine.append(i)
                a += n
            askers.append((row["chunk"], mine))
        # destinations are merged apart, small ones together
        stretches = list(number)
        owners: list[np.ndarray] = [np.empty(0, np.int64)] * len(stretches)

        def settle(lot: list[int], size: int) -> None:
            some, low = [stretches[i] for i in lot], np.array([least[i] for i in lot], np.int64)
            for i, o in zip(lot, (owners_in_lots if size > 2 * MERGE_BYTES else window_owners)(some, low, width)):
                owners[i] = o

        lot, size, last = [], 0, None
        for i in sorted(range(len(stretches)), key=place.__getitem__):
            if lot and size > MERGE_BYTES and place[i] != last:
                settle(lot, size)
                lot, size = [], 0
            lot.append(i)
            size += len(stretches[i])
            last = place[i]
        settle(lot, size)
        for chunk, mine in askers:
            yield record(chunk=[chunk], part=pa.array([key[0].as_py()], pa.int32()), told=blobs([pack(np.concatenate([owners[i] for i in mine]))]))

    return run


ANSWER = "chunk long, part int, told binary"
ASK = "part int, chunk long, lengths binary, body binary, places binary, least binary, who binary, which binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    scratch = Scratch(docs.sparkSession, "repeats", frees=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = scratch.save(rows.mapInArrow(chunked, CHUNK), "chunks")
    total = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = partitions_for(total * 0.08, PART_KEYS)
    spread_parts = partitions_for(total * 0.3, PART_BYTES)

    def key_asks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from Chunk(batch.slice(i, 1).to_pylist()[0], width).key_asks(parts)

    def schema(**kinds):
        return pa.schema(list(kinds.items()))

    i32, i64, raw = pa.int32(), pa.int64(), pa.binary()
    ask = schema(part=i32, chunk=i64, lengths=raw, body=raw, places=raw, least=raw, who=raw, which=raw)
    result = schema(doc_id=i64, n_bytes=i64, n_removed=i64, n_spans=i64, kept_sha256=pa.string())

    def second_asks(key, left, right):
        told = right.to_pylist()
        return pa.Table.from_batches([b for row in left.to_pylist() for b in Chunk(row, width).stretch_asks(told, parts, spread_parts)], ask)

    def results(key, left, right):
        own, told = None, []
        for r in right.to_pylist():
            if r["part"] == -1:
                own = {k: v for k, v in zip(("lengths", "body", "places", "least", "who", "which"), pickle.loads(r["told"]))}
            else:
                told.append(r)
        return pa.Table.from_batches([b for row in left.to_pylist() for b in Chunk(row, width).cleaned(own, told)], result)

    asks = chunks.mapInArrow(key_asks, "part int, chunk long, keys binary, counts binary, several binary")
    first = asks.groupBy("part").applyInArrow(tell_keys, ANSWER)
    asks = scratch.save(chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(second_asks, ASK), "stretches")
    second = asks.where("part >= 0").groupBy("part").applyInArrow(tell_windows(width), ANSWER)
    kept = asks.where("part = -1").mapInArrow(remembered, ANSWER)
    return chunks.groupBy("chunk").cogroup(kept.unionByName(second).groupBy("chunk")).applyInArrow(results, RESULT)


def remembered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What chunks noted for themselves, in the columns of answers."""
    for batch in batches:
        for r in batch.to_pylist():
            yield record(chunk=[r["chunk"]], part=pa.array([-1], pa.int32()), told=blobs([pickle.dumps([r[k] for k in ("lengths", "body", "places", "least", "who", "which")])]))
