"""Documents to chunks (TX-01 to TX-15): one Arrow pass per table, text travels once and nothing is shuffled."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.config import ChunkingConfig, SemanticConfig
from tarnlake.functions import html, split
from tarnlake.functions.models import hash_embedding
from tarnlake.functions.text import SPACE
from tarnlake.schemas import CHUNK

_FIELDS = [f.strip().split(" ") for f in CHUNK.split(",")]
_ARROW = {"string": pa.string(), "int": pa.int32()}


def config_hash(config: ChunkingConfig, strategy: str) -> str:
    """TX-19: hash of the settings as canonical JSON."""
    return hashlib.sha256(json.dumps({"strategy": strategy, "levels": {str(k): list(v) for k, v in config.levels().items()}}, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def config_hash_of(size: Column, overlap: Column, strategy: Column) -> Column:
    """TX-19 for settings in columns (whole numbers): the hash that :func:`config_hash` gives."""
    levels = ((1, 2000, 3, 400), (2, 1000, 2, 200), (3, 600, 1, 100))
    parts = [F.concat(F.lit(f'"{n}":['), F.greatest(F.lit(least), size * k).cast("string"), F.lit(","), F.greatest(F.lit(low), overlap * k).cast("string"), F.lit("]")) for n, least, k, low in levels]
    return F.sha2(F.concat(F.lit('{"levels":{'), F.concat_ws(",", *parts), F.lit('},"strategy":"'), strategy, F.lit('"}')), 256)


#: Texts that are worked on at a time.
TEXTS = 100


def _sanitized(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            part = b.slice(i, TEXTS)
            yield part.set_column(at, b.schema.field(at), pa.array([split.sanitize(t) for t in part.column(at).to_pylist()], b.schema.field(at).type))


def sanitize_column(df: DataFrame, text: str = "text") -> DataFrame:
    """TX-01: only rows that may change go through Python, some at a time."""
    plain = F.col(text).isNull() | F.col(text).rlike(r"\A[\x20-\x7e\t\n\r]*\z")
    done = df.filter(F.coalesce(plain, F.lit(True)))
    at = df.columns.index(text)
    rest = df.filter(~F.coalesce(plain, F.lit(True))).mapInArrow(lambda batches: _sanitized(batches, at), df.schema)
    return done.unionByName(rest)


def three_levels(text: str, filename: str, page: int, config: ChunkingConfig, first: int = 0) -> list[dict]:
    """TX-03: level 2 from a level 1 chunk's text, level 3 from a level 2 chunk's; numbers count per level."""
    sizes, out, count = config.levels(), [], {1: 0, 2: 0, 3: 0}

    def put(level: int, body: str, parent: str, root: str) -> str:
        name = f"{filename}::p{page}::l{level}::{count[level]}"
        count[level] += 1
        out.append({"filename": filename, "page_number": page, "text": body, "chunk_id": name, "parent_chunk_id": parent, "root_chunk_id": root or name, "chunk_level": level, "chunk_idx": first + len(out)})
        return name

    for a, b in split.split_recursive(text, *sizes[1]):
        one = text[a:b]
        root = put(1, one, "", "")
        for c, d in split.split_recursive(one, *sizes[2]):
            two = one[c:d]
            parent = put(2, two, root, root)
            for e, f in split.split_recursive(two, *sizes[3]):
                put(3, two[e:f], parent, root)
    return out


def structured_levels(text: str, filename: str, page: int, config: ChunkingConfig, first: int = 0, strategy: str = "structured", embed: Callable | None = None, semantic: SemanticConfig = SemanticConfig()) -> list[dict]:
    """TX-08, TX-12: sections to atoms, atoms packed by level; texts name their section, offsets point into the source."""
    sizes, out, count = config.levels(), [], {1: 0, 2: 0, 3: 0}
    digest = config_hash(config, strategy)

    def cutter(size: int):
        if embed is None:
            return None

        def cut(part: dict) -> list[split.Span]:
            plan = split.plan_boundaries(text[part["start"] : part["end"]], embed, semantic)
            if plan["offsets"]:
                return split.planned_parts(text, part, plan["offsets"], size)
            return split.split_recursive(text, size, 0, split.LATIN_SEPARATORS, (part["start"], part["end"]))

        return cut

    def put(level: int, group: list[dict], section: dict, parent: str, root: str) -> str:
        name = f"{filename}::p{page}::l{level}::{count[level]}"
        count[level] += 1
        a, b = group[0]["start"], group[-1]["end"]
        body = "\n\n".join(text[p["start"] : p["end"]] for p in group)
        kinds = {p["kind"] for p in group}
        head = f"Section: {section['heading_path']}\n\n" if section["heading_path"] else ""
        out.append({"filename": filename, "page_number": page, "text": head + body, "chunk_id": name, "parent_chunk_id": parent, "root_chunk_id": root or name, "chunk_level": level, "chunk_idx": first + len(out), "heading_path": section["heading_path"], "heading_level": section["heading_level"], "source_start_index": a, "source_end_index": b, "content_kind": kinds.pop() if len(kinds) == 1 else "mixed", "chunking_strategy": strategy, "chunking_config_hash": digest})
        return name

    pack = lambda parts, level: split.pack_atoms(text, parts, sizes[level][0], cutter(sizes[level][0]))
    for section in split.sections(text):
        for one in pack(split.atoms(text, (section["start"], section["end"])), 1):
            root = put(1, one, section, "", "")
            for two in pack(one, 2):
                parent = put(2, two, section, root, root)
                for three in pack(two, 3):
                    put(3, three, section, parent, root)
    return out


def chunk(pages: DataFrame, config: ChunkingConfig = ChunkingConfig(), strategy: str = "default") -> DataFrame:
    """TX-03, TX-08, TX-12 over ``filename, page_number, text`` rows; ``chunk_idx`` counts within a page until :func:`assemble`.

    Strategies: ``default``, ``structured``, ``semantic``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows: list[dict] = []
                for name, page, text in zip(*(c.to_pylist() for c in batch.slice(at, 100).columns), strict=True):
                    clean = split.sanitize(text) or ""
                    if strategy == "default":
                        rows += three_levels(clean, name, page, config)
                    else:
                        rows += structured_levels(clean, name, page, config, 0, strategy, hash_embedding if strategy == "semantic" else None)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], _ARROW[k]) for f, k in _FIELDS], [f for f, _ in _FIELDS])

    page = F.coalesce(F.col("page_number").cast("int"), F.lit(0))
    return pages.select(F.coalesce("filename", F.lit("")).alias("filename"), page.alias("page_number"), "text").mapInArrow(run, CHUNK)


def assemble(chunks: DataFrame) -> DataFrame:
    """TX-04, WN-03: running number over the pages of a document. Page sizes are summed up first, so no document is gathered."""
    sizes = chunks.groupBy("filename", "page_number").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("filename").orderBy("page_number")) - F.col("n")
    return chunks.join(sizes.select("filename", "page_number", before.alias("__before")), ["filename", "page_number"]).withColumn("chunk_idx", (F.col("chunk_idx") + F.col("__before")).cast("int")).drop("__before")


def linked(chunks: DataFrame) -> DataFrame:
    """TX-09: neighbours of the same section and level; empty at the ends."""
    by = Window.partitionBy("filename", "heading_path", "chunk_level").orderBy("chunk_idx")
    return chunks.withColumn("previous_chunk_id", F.coalesce(F.lag("chunk_id").over(by), F.lit(""))).withColumn("next_chunk_id", F.coalesce(F.lead("chunk_id").over(by), F.lit("")))


def linearised(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """TX-14: ``key, text, title`` of an ``html`` column."""
    kind = pages.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [html.linearise(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.string())], [key, "text", "title"])

    return pages.select(key, "html").mapInArrow(run, T.StructType([T.StructField(key, kind), T.StructField("text", T.StringType()), T.StructField("title", T.StringType())]))


def html_sections(linear: DataFrame) -> DataFrame:
    """TX-15: ``text, title`` cut before every second-level heading; ``section, section_title, page_number`` added.

    A page of one piece is headed by its title. Of several each is headed by its own heading, the first also by a first-level one.
    A page without text has no section.
    """
    bare = lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    parts = F.filter(F.transform(F.split(bare(F.coalesce("text", F.lit(""))), r"(?m)^(?=## .+$)"), bare), lambda x: x != "")
    one = linear.withColumn("__n", F.size(parts)).select("*", F.posexplode(parts).alias("__i", "__part"))
    line = bare(F.substring_index("__part", "\n", 1))
    own = F.when(line.startswith("## "), bare(F.substr(line, F.lit(4)))).when((F.col("__i") == 0) & line.startswith("# "), bare(F.substr(line, F.lit(3)))).otherwise("")
    title = F.coalesce("title", F.lit(""))
    named = one.withColumn("section_title", F.when(F.col("__n") == 1, title).otherwise(own))
    head = F.when(F.col("section_title") == "", "").when(F.col("__n") == 1, F.concat(F.lit("["), "section_title", F.lit("]\n\n"))).otherwise(F.concat(F.lit("[章节: "), "section_title", F.lit("]\n\n")))
    return named.withColumn("section", F.concat(head, F.col("__part"))).withColumn("page_number", F.col("__i") + 1).drop("__n", "__i", "__part")
