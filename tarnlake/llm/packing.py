"""Packing by power-of-two decomposition.

Each document's token ids (with an end-of-text id) are cut into pieces whose lengths are powers of two: as many of
the longest length as fit, then the binary digits of the remainder, longest first. Pieces of equal length are gathered
in a bucket, and a training batch is drawn from one bucket, so no sequence crosses documents and none holds padding.

A bucket is spread over cells by a hash of (document, start, checksum), about ``cell_rows`` pieces each: one shuffle
brings a cell's pieces together, where they stand in the order of that hash. The sequence id counts them there and
names bucket and cell, so it does not depend on how the table was partitioned.

Tokenising dominates the cost. The vocabulary drops white space and joins nothing across it, so the ids of a text are
the ids of its white-space separated chunks, one after the other. Each worker keeps a memo from chunk to ids, bounded
by bytes, from task to task; chunks it has not seen go to the tokenizer in batches.

Defined cases: a null or empty text gives the end id alone (one piece of length 1); repeated rows are packed each for
itself, and those equal in id and text meet in one cell; a null ``doc_id`` stays null; an empty table gives no rows;
other columns of the input are ignored. A hot source or a group of copies under ids of their own is spread like any other rows.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import HELD, give_back

LONGEST = 2048
END_ID = 1
#: Bytes that a worker's memo of chunks and word pieces takes, about, before it starts afresh.
MEMO_BYTES = 450 << 20
#: What an entry takes besides its characters and ids: two objects and a place in the table.
ENTRY_BYTES = 180
#: A chunk of more bytes than this is not remembered: it will hardly come again.
LONGEST_CHUNK = 64
#: Pieces of a bucket that are gathered in one cell, about: layouts alone, and with their ids.
CELL_ROWS = 20_000
CELL_ROWS_WITH_IDS = 1_000
#: Texts cut at a time.
BLOCK_ROWS = 128
#: The tokenizer's own word pattern, for lower-case text of Latin-1 (fixed values: its letters and numbers).
_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
_VISIBLE = re.compile("[\x21-\x7e\xa1-\xff]+\\Z")


class ChunkTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        # one vocabulary serves both ways of reading: whole text, and word pieces already normalised and cut
        self.model = Tokenizer.from_file(path)
        self.ways = {"whole": (self.model.normalizer, self.model.pre_tokenizer), "pieces": (None, WhitespaceSplit())}
        self.limit, self.held = memo_bytes, 0
        shown = {b: b for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
        self.shown = shown | {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in shown)} | {0x20: 0x20}
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode(self, way: str, lines: list[str]) -> Iterator:
        """Encodings of ``lines``, a few at a time: each holds far more than its ids."""
        self.model.normalizer, self.model.pre_tokenizer = self.ways[way]
        for at in range(0, len(lines), 8):
            yield from self.model.encode_batch(lines[at : at + 8], add_special_tokens=False)

    def _encode_words(self, words: list[str]) -> None:
        """Remember the ids of lower-case word pieces; bytes stand for themselves as the vocabulary's own characters."""
        step = 256
        lines = [" ".join(words[i : i + step]).encode("utf-8").decode("latin-1").translate(self.shown) for i in range(0, len(words), step)]
        for k, enc in enumerate(self._encode("pieces", lines)):
            held = words[k * step : (k + 1) * step]
            ids = np.array(enc.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(enc.word_ids, minlength=len(held)))).tolist()
            at = 0
            for w, end in zip(held, ends, strict=True):
                self.words[w] = ids[at:end]
                self.held += ENTRY_BYTES + len(w) + end - at
                at = end

    def _learn(self, missing: set[bytes]) -> None:
        plain: list[tuple[bytes, list[str]]] = []
        other: list[bytes] = []
        wanted: set[str] = set()
        for chunk in missing:
            if chunk.isalpha():  # letters a to z in either case: one piece
                word = chunk.lower().decode("ascii")
                plain.append((chunk, [word]))
                wanted.add(word)
                continue
            text = chunk.decode("utf-8")
            if _VISIBLE.match(text) and "<|" not in text:
                parts = _PLAIN.findall(text.lower())
                plain.append((chunk, parts))
                wanted.update(parts)
            else:
                other.append(chunk)
        wanted = wanted.difference(self.words)  # looks its members up; difference_update would walk the memo
        if wanted:
            self._encode_words(list(wanted))
        words, chunks = self.words, self.chunks
        for chunk, parts in plain:
            chunks[chunk] = words[parts[0]] if len(parts) == 1 else b"".join([words[w] for w in parts])
        if other:
            self._learn_other(other)

    def _learn_other(self, chunks: list[bytes]) -> None:
        """Chunks beyond visible ASCII: the tokenizer normalises and cuts many at once, joined by line ends."""
        texts = [c.decode("utf-8") for c in chunks]
        simple = [t.isalpha() or not any(x.isspace() or "<" == x for x in t) for t in texts]
        odd = [(c, t) for c, t, ok in zip(chunks, texts, simple, strict=True) if not ok]
        for (chunk, _), enc in zip(odd, self._encode("whole", [t for _, t in odd]), strict=True):
            self.chunks[chunk] = b"".join(i.to_bytes(4, "little") for i in enc.ids)
        rest = [(c, t) for c, t, ok in zip(chunks, texts, simple, strict=True) if ok]
        step = 256
        groups = [rest[i : i + step] for i in range(0, len(rest), step)]
        joined = ["\n".join(t for _, t in g) for g in groups]
        for group, enc, line in zip(groups, self._encode("whole", joined), joined, strict=True):
            starts, at = [], 0
            for _, t in group:
                starts.append(at)
                at += len(t) + 1
            held: list[list[int]] = [[] for _ in group]
            k = 0
            for (a, _), i in zip(enc.offsets, enc.ids, strict=True):
                while k + 1 < len(starts) and a >= starts[k + 1]:
                    k += 1
                held[k].append(i)
            for (chunk, _), ids in zip(group, held, strict=True):
                self.chunks[chunk] = b"".join(i.to_bytes(4, "little") for i in ids)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """For each text its ids; a null text has none. Give it blocks of texts: unknown chunks are learnt once a block."""
        split = [t.encode("utf-8").split() if t else [] for t in texts]
        memo = self.chunks
        if self.held > self.limit:
            memo.clear()
            self.words.clear()
            self.held = 0
        missing = set().union(*split).difference(memo)
        if missing:
            held = gc.isenabled()
            gc.disable()  # no cycles arise here, and many small objects would set the collector off again and again
            try:
                self._learn(missing)
            finally:
                if held:
                    gc.enable()
        out = [b"".join(map(memo.__getitem__, parts)) for parts in split]
        for chunk in missing:
            if len(chunk) > LONGEST_CHUNK:
                del memo[chunk]
            else:
                self.held += ENTRY_BYTES + len(chunk) + len(memo[chunk])
        return out


_TOKENIZERS: dict[str, ChunkTokenizer] = HELD.setdefault("tokenizers", {})


def worker_tokenizer(path: str, memo_bytes: int) -> ChunkTokenizer:
    """This worker's tokenizer for a vocabulary, kept from task to task."""
    found = _TOKENIZERS.get(path)
    if found is None:
        _TOKENIZERS.clear()
        found = _TOKENIZERS[path] = ChunkTokenizer(path, memo_bytes)
    found.limit = memo_bytes
    return found


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two that add up to ``n``: as many of ``longest`` as fit, then the remainder's binary digits."""
    out = [longest] * (n // longest)
    rest = n % longest
    while rest:
        top = 1 << (rest.bit_length() - 1)
        out.append(top)
        rest -= top
    return out


def pieces(docs: DataFrame, tokenizer_path: str, *, longest: int = LONGEST, end_id: int = END_ID, emit_ids: bool = True, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """One row per piece, where its document lies: ``doc_id, start, length, ids_crc32, doc_tokens, bucket[, ids]``."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids array<int>" * emit_ids
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(tokenizer_path, memo_bytes)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                row, start, length, crc, total = [], [], [], [], []
                held = []
                for k, ids in enumerate(tok.encode(part.column(1).to_pylist())):
                    view = memoryview(ids + end)
                    n, begin = len(view) // 4, 0
                    held.append(view)
                    for size in piece_lengths(n, longest):
                        row.append(k)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(view[4 * begin : 4 * (begin + size)]))
                        total.append(n)
                        begin += size
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array([x.bit_length() - 1 for x in length], pa.int32())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if emit_ids:
                    flat = pa.Array.from_buffers(pa.int32(), sum(length), [None, pa.py_buffer(b"".join(held))])
                    ends = [0]
                    for x in length:
                        ends.append(ends[-1] + x)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def gather(cut: DataFrame, cells: int, *, seed: int = 13) -> DataFrame:
    """Pieces brought together by bucket, in ``cells`` cells each, with ``sequence_id`` and ``offset`` (0)."""
    key = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32")
    placed = cut.withColumn("__key", key).withColumn("__cell", F.pmod("__key", F.lit(cells)))
    place = F.row_number().over(Window.partitionBy("bucket", "__cell").orderBy("__key", "doc_id", "start")).cast("long") - 1
    sequence = (place * cells + F.col("__cell")) * 64 + F.col("bucket")
    return placed.withColumn("sequence_id", sequence).withColumn("offset", F.lit(0).cast("long")).drop("__key", "__cell")


def pack(docs: DataFrame, tokenizer_path: str, *, longest: int = LONGEST, end_id: int = END_ID, emit_ids: bool = True, memo_bytes: int = MEMO_BYTES, cell_rows: int | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, bucket[, ids], sequence_id, offset``, gathered by bucket.

    ``bucket`` is the base-two logarithm of the length; each piece is a sequence of its own. ``longest`` must be a
    power of two. ``emit_ids=False`` leaves the id arrays out for callers that want the layout and checksums alone.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    cells = max(1, -(-docs.count() // (cell_rows or (CELL_ROWS_WITH_IDS if emit_ids else CELL_ROWS))))
    return gather(pieces(docs, tokenizer_path, longest=longest, end_id=end_id, emit_ids=emit_ids, memo_bytes=memo_bytes), cells)


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder per bucket: all files of a folder hold sequences of one length."""
    packed.write.partitionBy("bucket").parquet(path)
