"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case. The automaton is built over the word
sequences of the items, one state for each set of places where a sequence ends. A text's words are streamed through it: the
state and the length of the longest match that ends at each word. A match of ``window`` words or more holds a window of an
item; so does one that ends in a whole item of fewer words. The words of all windows found are hit, maximal stretches of hit words
are the spans, and the items of a window are those that the state of its sequence lists.

Before the automaton sees a text, words are read from its bytes with numpy: a text's stretch of words is only walked where all
words, and all neighbouring pairs, may be an item's (tables of bits over the first eight bytes and the length of a word). That
never loses a match; whether there is one is decided on the words themselves.

Items are dealt into blocks of about ``BLOCK_WORDS`` words, an item being in one block whole, so an automaton has a bounded size
however many items there are. Texts pass through the blocks one after the other and carry what was found so far; nothing is
shuffled. A block is broadcast as its items' texts, and each worker builds the automaton once.

Defined cases: null texts and items have no words; an item without words has no window; of items with equal words each is listed;
repeated documents each have a row; a very long text is one row and takes some ten bytes of memory for each of its own;
spans that touch are one; no items or an empty table give no hits or no rows; columns with clashing names are replaced if the operator makes them and kept otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HELD, released, written

WINDOW = 10
#: Words of items in one automaton; with states of about 0.4 KB that is some 80 MB in a Python worker.
BLOCK_WORDS = 100_000
_BITS = 22
_ROWS = 512

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IN_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Words:
    """The words of some bytes: where they begin and end, and a key of each (of equal words equal)."""

    def __init__(self, data: bytes) -> None:
        self.data = data.translate(_LOWER)
        padded = np.frombuffer(self.data + b"\\0" * 9, np.uint8)
        inside = _IN_WORD[padded]
        inside[len(data) :] = False
        turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            turns = np.concatenate(([0], turns))
        self.start, self.end = turns[::2], turns[1::2]
        eight = np.ndarray(shape=(len(padded) - 8,), dtype="<u8", buffer=padded.data, strides=(1,))
        long = self.end - self.start
        with np.errstate(over="ignore"):
            self.key = (eight[self.start] & _MASKS[np.minimum(long, 8)]) * _MIX[0] + long.astype(np.uint64) * _MIX[1]

    def __len__(self) -> int:
        return len(self.start)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]]

    def slice(self, a: int, b: int) -> list[bytes]:
        data = self.data
        return [data[x:y] for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def _slots(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys ^ (keys >> np.uint64(29))) * _MIX[1]) >> np.uint64(64 - _BITS)


def _pairs(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return keys[:-1] * _MIX[1] + keys[1:]


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: Iterable[tuple[object, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.names: dict[bytes, int] = {}
        #: Of each state: transitions, suffix link, longest length; items whose whole sequence of under ``window`` words it is.
        self.next: list[dict[int, int]] = [{}]
        self.link, self.long = [-1], [0]
        self.whole: dict[int, list[int]] = {}
        self.items: list[object] = []
        self.one, self.two = np.zeros(1 << _BITS, bool), np.zeros(1 << _BITS, bool)
        sequences = []
        self.shortest = window
        for name, text in items:
            words = Words(text)
            if not len(words):
                continue
            sequence = [self.names.setdefault(w, len(self.names)) for w in words.slice(0, len(words))]
            self.one[_slots(words.key)] = True
            self.two[_slots(_pairs(words.key))] = True
            self.shortest = min(self.shortest, len(sequence))
            self.items.append(name)
            sequences.append(sequence)
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        self._name_windows(sequences)

    def _extend(self, last: int, w: int) -> int:
        nexts, link, long = self.next, self.link, self.long
        at = nexts[last].get(w)
        if at is not None and long[at] == long[last] + 1:
            return at  # an earlier item has this sequence
        if at is not None:
            return self._split(last, at, w)
        new = self._state({}, 0, long[last] + 1)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][w]
            link[new] = q if long[q] == long[p] + 1 else self._split(p, q, w)
        return new

    def _state(self, nexts: dict[int, int], link: int, long: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.long.append(long)
        return len(self.long) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The sequences of ``q`` that ``p`` leads to get a state of their own."""
        copy = self._state(dict(self.next[q]), self.link[q], self.long[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _name_windows(self, sequences: list[list[int]]) -> None:
        """Items of each window, by the state that holds it, and of each state the nearest one on its suffix path that is a short item."""
        window, link, long = self.window, self.link, self.long
        self.holders: dict[int, list[int]] = {}
        for item, sequence in enumerate(sequences):
            if len(sequence) < window:
                state = 0
                for w in sequence:
                    state = self.next[state][w]
                self.whole.setdefault(state, []).append(item)
                continue
            for state in {s for s, e in self.walk(sequence) if e >= window}:
                self.holders.setdefault(self._trimmed(state), []).append(item)
        self.ends: list[int] = [-1] * len(long)
        for s in sorted(range(1, len(long)), key=long.__getitem__):
            self.ends[s] = s if s in self.whole else self.ends[link[s]]
        self.has_short = bool(self.whole)

    def _trimmed(self, state: int) -> int:
        """The state of the last ``window`` words of a match that ends in ``state``."""
        while self.long[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def walk(self, sequence: Iterable[int]) -> Iterator[tuple[int, int]]:
        """State and length of the longest match that ends at each word."""
        nexts, link, long = self.next, self.link, self.long
        state = length = 0
        for w in sequence:
            while state and w not in nexts[state]:
                state = link[state]
                length = long[state]
            to = nexts[state].get(w)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def match(self, words: Words) -> tuple[list[tuple[int, int]], set[int], int]:
        """Spans of hit words (from, to), numbers of the items found, longest match."""
        if not self.items or len(words) < self.shortest:
            return [], set(), 0
        may = self.one[_slots(words.key)]
        # a stretch: words that may be an item's, each pair of neighbours as well
        tied = may[1:] & may[:-1]
        tied[tied] = self.two[_slots(_pairs(words.key)[tied])]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], tied, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        candidates = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + 1 - a >= self.shortest]
        if self.shortest == 1:  # words alone as well
            alone = may.copy()
            alone[1:] &= ~tied
            alone[:-1] &= ~tied
            candidates = sorted(candidates + [(k, k + 1) for k in np.flatnonzero(alone).tolist()])
        for a, b in candidates:
            names = self.names
            for k, (state, length) in enumerate(self.walk(names.get(w, -1) for w in words.slice(a, b)), a):
                if length > longest:
                    longest = length
                size = 0
                if length >= self.window:
                    size = self.window
                    found.update(self.holders[self._trimmed(state)])
                if self.has_short and length:
                    s = self.ends[state]
                    if s == state and length < self.long[s]:
                        s = self.ends[self.link[s]]
                    while s > 0:
                        found.update(self.whole[s])
                        size = max(size, self.long[s])
                        s = self.ends[self.link[s]]
                if size:
                    begin = k + 1 - size
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, k + 1))
        return spans, found, longest


_BUILT: dict[str, Automaton] = HELD.setdefault("automata", {})


def _worker_automaton(name: str, items: list[tuple[object, bytes]], window: int) -> Automaton:
    """This worker's automaton of a block, kept from task to task."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(items, window)
    return _BUILT[name]


def _joined(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Spans (from, to, from_byte, to_byte) of several blocks, those that touch made one."""
    out: list[tuple[int, ...]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())])
_SPAN_SQL = "array<struct<first: bigint, end: bigint, first_byte: bigint, end_byte: bigint>>"


def _stream(docs: DataFrame, name: str, block, window: int, kind: str) -> DataFrame:
    """``docs`` (``__text`` and the columns of :func:`scan`) after one more block."""
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items", "longest")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _worker_automaton(name, block.value, window)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                counts, spans, items, longest = [], [], [], []
                for text, before, ids, most in zip(*[batch.column(c) for c in ("__text", "spans", "items", "longest")], strict=True):
                    words = Words(text.as_py() or b"")
                    hit, numbers, length = automaton.match(words)
                    counts.append(len(words))
                    old = before.as_py()
                    if hit:
                        new = [(a, b, int(words.start[a]), int(words.end[b - 1])) for a, b in hit]
                        old = _joined([tuple(s.values()) for s in old] + new)
                    spans.append(old)
                    items.append(ids.as_py() + [automaton.items[k] for k in sorted(numbers)] if numbers else ids.as_py())
                    longest.append(max(most.as_py(), length))
                made = [pa.array(counts, pa.int64()), pa.array([[s if isinstance(s, dict) else dict(zip(("first", "end", "first_byte", "end_byte"), s, strict=True)) for s in x] for x in spans], pa.list_(_SPAN)), pa.array(items, batch.column("items").type), pa.array(longest, pa.int64())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *made], [*kept, "n_words", "spans", "items", "longest"])

    return docs.mapInArrow(released(run, keep="automata"), f"{schema}, n_words long, spans {_SPAN_SQL}, items array<{kind}>, longest long")


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` of hit words (by number and by byte, ends excluded), ``items`` found (ids, in no order) and the ``longest`` match.

    Of several blocks one is in the driver and in the workers at a time; every fourth pass is written, to keep few workers a task.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    kind = items.schema[item_id].dataType.simpleString()
    named = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item_text}`").cast("binary").alias("text")).filter("text IS NOT NULL")
    most = named.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0  # words at most
    blocks = max(1, -(-int(most) // block_words))
    if blocks > 1:
        named = written(spark, named.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "items")
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items", "longest")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("__text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPAN_SQL).alias("spans"), F.array().cast(f"array<{kind}>").alias("items"), F.lit(0).cast("long").alias("longest"))
    for k in range(blocks):
        part = named.filter(F.col("block") == k) if blocks > 1 else named
        block = spark.sparkContext.broadcast([(r["id"], bytes(r["text"])) for r in part.select("id", "text").collect()])  # block_words words, or one longer item
        out = _stream(out, uuid.uuid4().hex, block, window, kind)
        if blocks > 1 and k % 4 == 3:
            out = written(spark, out, "scanned")
    return out.drop("__text")


def remove(scanned: DataFrame, *, text: str = "text", least_words: int = WINDOW, most_coverage: float = 0.5) -> DataFrame:
    """Texts of :func:`scan` without their spans of ``least_words`` words or more; documents with over ``most_coverage`` of their words hit go.

    What stood before and after a span is joined by a blank.
    """
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    kept = scanned.filter(F.coalesce(hit <= most_coverage * F.col("n_words"), F.lit(True)))
    # byte ranges that stay, from the ends of the spans that go
    gone = F.filter("spans", lambda s: s["end"] - s["first"] >= least_words)
    data = F.col(f"`{text}`").cast("binary")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda s: s["end_byte"]))
    ends = F.concat(F.transform(gone, lambda s: s["first_byte"]), F.array(F.octet_length(data).cast("long")))
    bounds = kept.withColumn("__parts", F.when(F.size(gone) > 0, F.arrays_zip(begins.alias("a"), ends.alias("b")))).withColumn("__data", data)
    rest = F.array_join(F.filter(F.transform("__parts", lambda p: F.btrim(F.decode(F.substring(F.col("__data"), p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int")), "UTF-8"))), lambda t: t != ""), " ")
    return bounds.withColumn(text, F.when(F.col("__parts").isNull(), F.col(f"`{text}`")).otherwise(rest)).drop("__parts", "__data")


def digests(scanned: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of :func:`scan` with ``n_words, n_hit, n_items, items_sha256, contaminated``; items of one id count once."""
    ids = F.array_distinct("items")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    listed = F.array_join(F.array_sort(F.transform(ids, lambda i: i.cast("string"))), ",")
    return scanned.select(*keep, "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_NEXT = f"list(word) OVER (PARTITION BY key ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)"
OP11_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS key, doc_id, coalesce({_WORDS_SQL}, []) AS ws FROM documents),
held AS MATERIALIZED (SELECT * FROM docs),
items AS (SELECT row_number() OVER () AS key, item_id, {_WORDS_SQL} AS ws FROM benchmark),
iw AS (SELECT key, item_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM items WHERE len(ws) > 0),
inext AS (SELECT item_id, n, k, {_NEXT} AS nx FROM iw),
windows AS (SELECT DISTINCT item_id, len(nx) AS size, array_to_string(nx, ' ') AS s FROM inext WHERE len(nx) = least(n, {WINDOW})),
dw AS (SELECT key, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM held),
dnext AS (SELECT key, k, {_NEXT} AS nx FROM dw),
met AS (SELECT d.key, d.k, w.size, w.item_id FROM (SELECT d.key, d.k, z.size, array_to_string(d.nx[1:z.size], ' ') AS s FROM dnext d JOIN (SELECT DISTINCT size FROM windows) z ON len(d.nx) >= z.size) d JOIN windows w ON d.size = w.size AND d.s = w.s),
hits AS (SELECT key, count(*) AS n_hit FROM (SELECT DISTINCT key, unnest(range(k, k + size)) AS at FROM met) GROUP BY key),
found AS (SELECT key, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT key, item_id::VARCHAR AS i FROM met) GROUP BY key)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM held LEFT JOIN hits USING (key) LEFT JOIN found USING (key)
"""
