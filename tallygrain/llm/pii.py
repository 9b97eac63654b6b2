"""Personal data by a skip-chain conditional random field over a document's candidate spans.

Four patterns give base spans (e-mail, IP address, card and phone number). A document's nodes are its base spans and every
other span that could be one: something with an @, or a run of digits and the signs that phone numbers, cards and addresses
use. Each node has a label, none or one of the kinds. Neighbouring nodes share a chain potential; nodes that repeat a
token, or end in the same seven digits, or share an e-mail's local part, share a skip potential that rewards equal labels
however far apart they stand - each occurrence is tied to the one before and, if it is no base span, to the first base span
of each kind that it shares a key with, so evidence is one tie away and n occurrences take less than 5 n ties. Sum-product
messages pass over chain and skip edges until they settle; a document whose messages do not within four rounds a node (200 at
least) goes on under heavier damping for as many, and then its beliefs are taken as they are. Base spans are observed; a candidate whose likeliest label is a
kind becomes one more span. So a number that one passage writes as a phone number is found where another writes it bare.

Weights are trained by pseudo-likelihood on a bounded sample of documents that have nodes (``sample`` of them, smallest hash
first): base spans with their kinds, candidates tied to none of them as no personal data; candidates tied to a base span,
over any number of ties, are hidden. Everything else covers all documents and whole texts.

Defined cases: a null text is empty and has no spans; a null doc_id stays null; repeated rows give repeated result rows; an
empty table gives no rows; other columns are ignored, whatever their names. Overlapping base spans of two kinds all stay;
added spans never overlap a base span.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# What the four base patterns are made of. They are matched in parts, because as one pattern each the first two
# would look again and again at a long text without a break: an e-mail is sought from its @, an address by runs of numbers.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Other spans that could be personal data: something around an @ or a written-out at, or seven digits and more.
RUN = re.compile(r"[^\s<>\"',;:()\[\]]+")
AT = re.compile(r"\(at\)|\[at\]")
DIGIT_RUN = re.compile(r"(?:\+|\b)[0-9(](?:[\x20().-]{0,2}[0-9]){6,24}")
DIGITS = re.compile(r"[0-9]")
HAS_DIGITS = re.compile(r"[0-9][\x20().-]{0,2}[0-9]")
FEATURES = 32


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the characters of a local part up to an @, if a domain follows; none before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1  # an @ is in no local part
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers joined by points, and four again, of every run of such numbers; parts at most 255."""
    for run in NUMBERS.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by start, then kind: each pattern's leftmost matches, failing ones dropped."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in emails(text)]
    if DIGITS.search(text):
        if "." in text:
            out += [(a, b, 1) for a, b in addresses(text)]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Other spans that could be personal data, by start, none over a base span or over another."""
    found = []
    if HAS_DIGITS.search(text):
        found += [m.span() for m in DIGIT_RUN.finditer(text)]
    if "@" in text:
        found += [m.span() for m in RUN.finditer(text) if "@" in m[0][1:-1]]
    if "(at)" in text or "[at]" in text:
        marks = [m.span() for m in AT.finditer(text)]
        ends, starts = {a for a, _ in marks}, {b for _, b in marks}
        left, right = {}, {}
        for m in RUN.finditer(text):
            if m.end() in ends:
                left[m.end()] = m.start()
            if m.start() in starts:
                right[m.start()] = m.end()
        found += [(left[a], right[b]) for a, b in marks if a in left and b in right]
    out, k, done = [], 0, 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        while k < len(base) and base[k][1] <= a:
            k += 1
        if a >= done and not (k < len(base) and base[k][0] < b):
            out.append((a, b))
            done = b
    return out


def shape(text: str, start: int, end: int) -> np.ndarray:
    """A span's features: what it looks like and what stands before it, never whether a base pattern took it."""
    s = text[start:end]
    digits = sum(c.isdigit() for c in s)
    f = np.zeros(FEATURES)
    f[0] = 1
    f[1] = "@" in s
    f[2] = s.startswith("+")
    f[3] = "(" in s
    f[4] = "-" in s
    f[5] = " " in s
    f[6] = min(s.count("."), 4) == 3 and digits + 3 == len(s)
    f[7] = "." in s
    f[8] = digits == len(s)
    f[9 + min(digits, 20) // 2] = 1  # 9..19
    f[20] = digits >= 14 and luhn("".join(c for c in s if c.isdigit() and c.isascii()) or "1")
    f[21] = any(c.isalpha() for c in s)
    before = text[max(0, start - 24) : start].lower()
    for i, words in enumerate((("tel", "phone", "call", "fax", "mobile"), ("mail", "contact"), ("card", "visa", "credit"), ("ip", "host", "server"), ("=", "#", '"'))):
        f[22 + i] = any(w in before for w in words)
    f[27] = start == 0 or text[start - 1].isspace()
    f[28] = end == len(text) or text[end].isspace()
    return f


def ties(text: str, spans: list[tuple[int, int]], labels: list[int]) -> list[tuple[int, int]]:
    """Skip edges: each node to the last one before it with an equal token, equal last seven digits, or equal local part, and
    each that has no label to the first such one of each label."""
    last: dict[str, int] = {}
    known: dict[str, dict[int, int]] = {}
    bare: list[tuple[int, str]] = []
    out = set()
    for i, (a, b) in enumerate(spans):
        s = text[a:b].casefold()
        keys = {"=" + s}
        digits = "".join(c for c in s if c.isdigit())
        if "@" in s:
            keys.add("@" + s.split("@")[0])
        elif "(at)" in s or "[at]" in s:
            keys.add("@" + re.split(r"\(at\)|\[at\]", s)[0])
        elif len(digits) >= 7:
            keys.add("#" + digits[-7:])
        for k in keys:
            if k in last:
                out.add((last[k], i))
            last[k] = i
            if labels[i] > 0:
                known.setdefault(k, {}).setdefault(labels[i], i)
            else:
                bare.append((i, k))
    out.update((min(i, j), max(i, j)) for i, k in bare for j in known.get(k, {}).values())
    return sorted(out)


def reached(n: int, edges: list[tuple[int, int]], start: list[int]) -> set[int]:
    """The nodes that edges lead to from ``start``, over any number of them."""
    beside: list[list[int]] = [[] for _ in range(n)]
    for i, j in edges:
        beside[i].append(j)
        beside[j].append(i)
    found, todo = set(start), list(start)
    while todo:
        new = [j for j in beside[todo.pop()] if j not in found]
        found.update(new)
        todo += new
    return found


class Field:
    """Potentials: unary weights (labels x features), chain weights (labels x labels), and the skip reward."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip

    def dump(self) -> str:
        return json.dumps([self.unary.tolist(), self.chain.tolist(), self.skip])

    @staticmethod
    def load(text: str) -> Field:
        u, c, s = json.loads(text)
        return Field(np.array(u), np.array(c), s)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(feats: np.ndarray, gold: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 250) -> Field:
    """Pseudo-likelihood: each node given its neighbours' labels. gold -1: hidden, left out with its edges."""
    k = len(LABELS)
    u, c, s = np.zeros((k, feats.shape[1])), np.zeros((k, k)), 1.0
    ok = gold >= 0
    chain = chain[ok[chain].all(axis=1)] if len(chain) else chain
    skip = skip[ok[skip].all(axis=1)] if len(skip) else skip
    y = np.eye(k)[np.maximum(gold, 0)]
    m = [np.zeros_like(u), np.zeros_like(c), 0.0]
    v = [np.zeros_like(u), np.zeros_like(c), 0.0]
    for t in range(1, steps + 1):
        z = feats @ u.T
        if len(chain):
            np.add.at(z, chain[:, 0], c[:, gold[chain[:, 1]]].T)
            np.add.at(z, chain[:, 1], c[gold[chain[:, 0]]])
        if len(skip):
            np.add.at(z, skip[:, 0], s * y[skip[:, 1]])
            np.add.at(z, skip[:, 1], s * y[skip[:, 0]])
        e = np.where(ok[:, None], softmax(z) - y, 0) / max(1, ok.sum())
        gu = e.T @ feats + 1e-4 * u
        gc = 1e-4 * c
        gs = 1e-4 * (s - 4.0)  # drawn to a firm tie where the sample has none to learn from
        if len(chain):
            gc = gc + e[chain[:, 0]].T @ y[chain[:, 1]] + y[chain[:, 0]].T @ e[chain[:, 1]]
        if len(skip):
            gs += (e[skip[:, 0]] * y[skip[:, 1]]).sum() + (e[skip[:, 1]] * y[skip[:, 0]]).sum()
        new = []
        for i, (p, g) in enumerate(((u, gu), (c, gc), (s, gs))):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            new.append(p - 0.05 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9))
        u, c, s = new
        s = max(float(s), 0.0)
    return Field(u, c, s)


def infer(field: Field, feats: np.ndarray, seen: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Beliefs (nodes x labels) by loopy sum-product over all edges; seen: observed labels, -1 if none.

    rounds: of each of the two dampings, at most; null: four a node of a document's chain, and 200 at least. A document's
    messages stop as they settle or are out of rounds, whatever other documents' messages do.
    """
    k = len(LABELS)
    own = np.zeros((len(feats), k))
    for f in range(FEATURES):  # not by a product of matrices, whose rounding depends on how many rows there are
        own += feats[:, f, None] * field.unary[None, :, f]
    own = np.where(seen[:, None] >= 0, np.where(np.arange(k) == seen[:, None], 0.0, -1e9), own)  # beyond what any number of ties adds up to
    chain, skip = chain.reshape(-1, 2).astype(int), skip.reshape(-1, 2).astype(int)
    edges = np.concatenate((chain, skip))
    if not len(edges):
        return softmax(own)
    first = np.ones(len(own), int)
    first[chain[:, 1]] = 0
    doc = np.cumsum(first) - 1  # a document's nodes are one chain; chains that a skip edge joins count as one
    a, b = doc[edges[:, 0]], doc[edges[:, 1]]
    while (a != b).any():
        least = np.arange(doc.max() + 1)
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        doc = least[doc]
        a, b = doc[edges[:, 0]], doc[edges[:, 1]]
    limit = np.maximum(200, 4 * np.bincount(doc)) if rounds is None else np.full(doc.max() + 1, rounds)
    table = np.concatenate((np.repeat(field.chain[None], len(chain), 0), np.repeat((field.skip * np.eye(k))[None], len(skip), 0)))
    src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    table = np.concatenate((table, table.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    msg = np.zeros((len(src), k))
    total = own.copy()
    at = doc[src]
    settled = np.zeros(doc.max() + 1, bool)
    for damp in (0.5, 0.9):
        for r in range(int(limit.max())):
            live = np.flatnonzero(~settled[at] & (r < limit[at]))  # the messages of documents that have not settled
            if not len(live):
                break
            x = (total[src[live]] - msg[back[live]])[:, :, None] + table[live]
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            step = (1 - damp) * (new - msg[live])
            msg[live] += step
            total[dst[live]] = own[dst[live]]
            np.add.at(total, dst[live], msg[live])
            moving = np.zeros(len(settled), bool)
            moving[at[live[np.abs(step).max(axis=1) >= 2e-4 * (1 - damp)]]] = True
            settled[at[live]] = ~moving[at[live]]
    total = own.copy()
    np.add.at(total, dst, msg)
    return softmax(total)


class Graph:
    """The nodes and edges of several documents side by side."""

    def __init__(self):
        self.feats, self.seen, self.gold, self.chain, self.skip, self.where = [], [], [], [], [], []

    def add(self, number: int, text: str, base: list, more: list) -> None:
        spans = sorted([(a, b, k + 1) for a, b, k in base] + [(a, b, -1) for a, b in more])
        first = len(self.seen)
        tied = ties(text, [(a, b) for a, b, _ in spans], [label for _, _, label in spans])
        near = reached(len(spans), tied, [i for i, s in enumerate(spans) if s[2] > 0])
        for i, (a, b, label) in enumerate(spans):
            self.feats.append(shape(text, a, b))
            self.seen.append(label)
            self.gold.append(label if label > 0 else -1 if i in near else 0)
            self.where.append((number, a, b))
        self.chain += [(first + i, first + i + 1) for i in range(len(spans) - 1)]
        self.skip += [(first + i, first + j) for i, j in tied]

    def arrays(self):
        pairs = lambda x: np.array(x, int).reshape(-1, 2)
        return np.array(self.feats).reshape(-1, FEATURES), np.array(self.seen, int), np.array(self.gold, int), pairs(self.chain), pairs(self.skip)


def train(rows: DataFrame, sample: int) -> str:
    """The field, fitted in one task on at most ``sample`` documents that may have nodes."""
    may = rows.where(F.col("text").rlike("@|[0-9]{4}|[0-9][ ().-]{1,2}[0-9]")).withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = may.select("h").orderBy("h").limit(sample).distinct()  # hashes only; texts travel once they are chosen
    some = may.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])

    def run(batches):
        graph = Graph()
        texts = sorted(t.as_py() for batch in batches for t in batch.column(0))
        for i, text in enumerate(texts):
            base = base_spans(text)
            graph.add(i, text, base, candidates(text, base))
        feats, _, gold, chain, skip = graph.arrays()
        yield pa.record_batch([pa.array([fit(feats, gold, chain, skip).dump()])], ["model"])

    got = some.select("text").repartition(1).mapInArrow(run, "model string").collect()
    return got[0][0] if got else Field(np.zeros((len(LABELS), FEATURES)), np.zeros((len(LABELS),) * 2), 4.0).dump()


def annotate(texts: list[str], field: Field, group: int) -> list[list[tuple[int, int, int, bool]]]:
    """(start, end, kind number, base) spans of each text by start, then kind; ``group`` texts' messages pass at once."""
    found: list[list[tuple[int, int, int, bool]]] = []

    def settle(graph: Graph) -> None:
        feats, seen, _, chain, skip = graph.arrays()
        best = infer(field, feats, seen, chain, skip).argmax(axis=1)
        for (doc, a, b), s, label in zip(graph.where, seen, best):
            if s < 0 and label > 0:
                found[doc].append((a, b, int(label) - 1, False))

    graph, held = Graph(), 0
    for i, text in enumerate(texts):
        base = base_spans(text)
        found.append([(a, b, k, True) for a, b, k in base])
        more = candidates(text, base)
        if more:
            graph.add(i, text, base, more)
            held += 1
        if held >= group:
            settle(graph)
            graph, held = Graph(), 0
    if held:
        settle(graph)
    return [sorted(x, key=lambda s: (s[0], s[2], s[1])) for x in found]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, group: int = 256) -> DataFrame:
    """doc_id and spans (array of start, end, kind, base; code points, end exclusive, by start, then kind) of every document.

    sample: documents the weights are trained on, at most; group: documents whose messages pass at once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = train(rows, sample)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]):
        field = Field.load(model)
        for batch in batches:
            found = annotate(batch.column(1).to_pylist(), field, group)
            spans = [[{"start": a, "end": b, "kind": KINDS[k], "base": own} for a, b, k, own in x] for x in found]
            yield pa.record_batch([batch.column(0), pa.array(spans, arrow)], ["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string,base:boolean>>")


def blank_out(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans one replacement, named by the first."""
    out, at = [], 0
    for a, b, k, _ in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", sample: int = 2000, group: int = 256) -> DataFrame:
    """The documents' columns, personal data in the text replaced by its kind; a length column, where there is one, follows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model = train(rows, sample)
    at = docs.columns.index(text_col)
    n_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]):
        field = Field.load(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = annotate([t or "" for t in texts], field, group)
            new = [t if not x else blank_out(t, x) for t, x in zip(texts, found)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if n_at is not None:
                old = columns[n_at].to_pylist()
                columns[n_at] = pa.array([n if not x else len(t) for n, t, x in zip(old, new, found)], columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
