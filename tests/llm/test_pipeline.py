"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnlake.llm import langid
from tarnlake.llm.shared import written

from .test_llm import plain_components, plain_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = source = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [{r.doc_id: r for r in docs.collect()}]
    rows = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = written(spark, out, name.replace(" ", "-"))
        rows.append(docs.collect())
        tables.append({r.doc_id: r for r in rows[-1]})
    # language: texts without a letter go, and long ones under half of what held-out texts reach
    names, prototypes = langid.fit(source.filter(~langid.held_out()))
    judged = {r.doc_id: r for r in langid.classify(source, names, prototypes).withColumn("held", langid.held_out()).collect()}
    reached = sorted(r.score for r in judged.values() if r.held and len(r.text or "") >= 100)
    least = 0.5 * reached[max(0, math.ceil(0.01 * len(reached)) - 1)]
    assert set(tables[1]) == {i for i, r in judged.items() if re.search(r"[^\W\d_]", r.text or "") and (r.score >= least or len(r.text) < 100)}
    # lines
    pages, having = Counter(r.source for r in rows[1]), defaultdict(int)
    for r in rows[1]:
        for line in {x.strip(" \t\r") for x in r.text.split("\n")} - {""}:
            having[r.source, line] += 1
    gone = {k for k, n in having.items() if n > 0.005 * (pages[k[0]] + 1800) and n > 1}
    for i, r in tables[1].items():
        kept = [x for x in r.text.split("\n") if (r.source, x.strip(" \t\r")) not in gone]
        if any(x.strip(" \t\r") for x in kept) or r.text == "\n".join(kept):
            assert tables[2][i].text == "\n".join(kept)
        else:
            assert i not in tables[2]
    # near copies
    label = plain_components({i: r.text for i, r in tables[2].items()})
    assert set(tables[3]) == {i for i, (_, c) in label.items() if i == c}
    # mixing
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows[3]:
        sizes[r.source] += words(r.text)
    for r in rows[4]:
        taken[r.source] += words(r.text)
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= 1
    # packing
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows[4]:
        want[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows[5]:
        assert len(r.ids) == r.length and r.length & (r.length - 1) == 0
        got[r.doc_id] += r.length
    assert got == want and len(np.unique([r.sequence_id for r in rows[5]])) == len(rows[5])


def test_run(spark):
    """The run's rows are those of the stages one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(spark, stage(spark, docs, SF), name.replace(" ", "-"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert Counter(docs.select(*columns).collect()) == Counter(corpus_pipeline.run(spark, SF).select(*columns).collect())


def test_language_rejects_noise(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    noise = "".join(chr(0x4E00 + (i * i) % 5000) for i in range(300))
    more = spark.createDataFrame([(10_000, noise, None, "s", 300), (10_001, "scum!! " * 60, None, "s", 420)], source.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, source.unionByName(more), SF).select("doc_id").collect()}
    assert 10_000 not in kept and len(kept) > 180


def test_lines_of_a_large_source(spark):
    rows = [(i, f"own {i}" + "\nfooter" * (i < 15), "en", "s", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    assert len(out) == 1000 and all(r.text == f"own {i}" for i, r in out.items())


def test_language_stage(spark):
    rng = np.random.default_rng(3)
    make = lambda pool: "".join(rng.choice(list(pool), 400))
    rows = [(i, make("abcde  "), "x", "s", 1) for i in range(50)] + [(100 + i, make("qzжщю  "), None, "s", 1) for i in range(20)] + [(200, "qz", None, "s", 1), (201, "12 ☃", "x", "s", 1), (202, None, "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert kept >= {*range(50), 200} and not kept & {201, 202} and len(kept & set(range(100, 120))) <= 4
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, none, SF).collect()} == {i for i, *_ in rows} - {201, 202}


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with the stages' own names."""
    own = " ".join(f"word{i % 97} and more" for i in range(40))
    rows = [
        (1, own, "en", "s", 9), (1, own, "en", "s", 9), (2, own, None, None, None), (None, own + " x", "en", "s", 1), (None, None, None, None, None), (3, "", "en", "t", 0), (4, None, "en", "t", None),
        (5, "long text " * 60_000, "en", "t", 600_000), (6, "12 ☃ 34", None, "t", 8), (7, "menu\nown seven\n\n", "en", "s", 5), (8, "menu\nown seven\n\n", "en", "s", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("lines", "dropped", "size", "position", "pass", "words", "rep", "band", "family", "row", "site", "gone", "lang_pred", "score", "kept", "mark", "part", "bucket", "target", "taken"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    out = {r.doc_id: r for r in stages["language id"](spark, docs, SF).collect()}
    assert set(out) == {1, 2, 5, 7, 8, None}  # null, empty and letterless texts go
    held = stages["language id"](spark, docs, SF)
    assert held.count() == 7 and held.columns == [c for c in docs.columns]
    lines = stages["line dedup"](spark, held, SF)
    assert lines.count() == 7 and {r.doc_id: r.text for r in lines.collect() if r.doc_id == 7} == {7: "menu\nown seven\n\n"}
    one = stages["minhash near-dedup"](spark, lines, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect()) == [(False, 1), (False, 1), (False, 5), (False, 7), (True, 0)]  # rows of one id stay together, one without an id is a document of its own
    mixed = stages["mixing"](spark, one, SF)
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert set(mixed.columns) >= {"doc_id", "text", "lang", "source", "n_chars"} and 1.3 * words(one) < words(mixed) <= 1.6 * words(one)
    packed = stages["packing"](spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} <= {1, 5, 7, None} and all(len(r.ids) == r.length for r in packed)


def test_stages_on_empty_tables(spark):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = written(spark, out, "empty")


def test_run_leaves_no_tables_of_its_own(spark):
    from tarnlake import storage

    before = set(storage.WRITTEN)
    corpus_pipeline.run(spark, SF)
    left = [p.rsplit("/", 1)[-1] for p in storage.WRITTEN if p not in before]
    assert len(left) == 1 and left[0].startswith("mixing-")
