"""Invariants of text splitting (TX-02, TX-05 to TX-13, TX-25 to TX-28)."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnlake.config import ChunkingConfig, SemanticConfig
from tarnlake.functions import html, models, split
from tarnlake.operators.chunking import structured_levels, three_levels

DOC = "lead\n\n# One\n\ntext a.\n\n- x\n- y\n  z\n\n## Two\n\n|a|b|\n|--|--|\n|1|2|\n\n~~~\n# no heading\n~~~\n\n# Three\n\nend"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ,.\n。，！é漢", max_size=600), st.integers(20, 80), st.integers(0, 15))
def test_recursive_split(text, size, overlap):
    spans = split.split_recursive(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    assert all(c >= b - overlap for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    if len(text) <= size:
        assert [text[a:b] for a, b in spans] == ([text.strip()] if text.strip() else [])


def test_sections_and_atoms():
    found = split.sections(DOC)
    assert [(s["heading_path"], s["heading_level"]) for s in found] == [("", 0), ("One", 1), ("One > Two", 2), ("Three", 1)]
    kinds = [[a["kind"] for a in split.atoms(DOC, (s["start"], s["end"]))] for s in found]
    assert kinds == [["paragraph"], ["paragraph", "paragraph", "list"], ["paragraph", "table", "code"], ["paragraph", "paragraph"]]


def test_packing_never_cuts_but_paragraphs():
    text = "```\n" + "x\n" * 400 + "```\n\n" + "word " * 300
    groups = split.pack_atoms(text, split.atoms(text, (0, len(text))), 200)
    assert groups[0][0]["kind"] == "code" and groups[0][0]["end"] - groups[0][0]["start"] > 200
    assert all(g[-1]["end"] - g[0]["start"] <= 200 for g in groups[1:])


def test_sentences_keep_closing_marks():
    text = 'He said "no!" Then left... And (well.) done'
    assert [text[a:b] for a, b in split.sentences(text)] == ['He said "no!"', "Then left...", "And (well.)", "done"]


def test_semantic_plan():
    text = " ".join(f"Sentence number {i} about {'cats' if i < 30 else 'ships'}." for i in range(60))
    plan = split.plan_boundaries(text, lambda ts: [[float("cats" in t), float("ships" in t)] for t in ts])
    edges = [0, *plan["offsets"], len(text)]
    assert plan["decision"] == "planned" and all(b - a <= 800 for a, b in zip(edges, edges[1:], strict=False))
    assert split.plan_boundaries("short.", None)["decision"] == "short_paragraph"
    assert split.plan_boundaries("x" * 900, None)["decision"] == "few_sentences"
    assert split.plan_boundaries("A. B. C. D. " + "y" * 900 + ".", None, SemanticConfig())["decision"] == "long_sentence"
    assert split.interpolated([1, 3, 4, 9], 20) == 2.2


def test_three_levels():
    rows = three_levels("para one. " * 500, "f.md", 2, ChunkingConfig())
    ids = {r["chunk_id"]: r for r in rows}
    assert [r["chunk_idx"] for r in rows] == list(range(len(rows)))
    for r in rows:
        if r["chunk_level"] == 1:
            assert r["parent_chunk_id"] == "" and r["root_chunk_id"] == r["chunk_id"]
        else:
            parent = ids[r["parent_chunk_id"]]
            assert parent["chunk_level"] == r["chunk_level"] - 1 and r["text"] in parent["text"] and ids[r["root_chunk_id"]]["chunk_level"] == 1
    assert three_levels(" \n ", "f.md", 0, ChunkingConfig()) == []


def test_structured_levels_point_into_the_source():
    for r in structured_levels(DOC, "f.md", 0, ChunkingConfig()):
        body = r["text"].removeprefix(f"Section: {r['heading_path']}\n\n")
        source = DOC[r["source_start_index"] : r["source_end_index"]]
        assert source.split() == body.split() and len(r["chunking_config_hash"]) == 64


def test_masks_and_segments():
    text = "Wait 20 ms at https://a.b/c or `x = 1`.\n" + "long " * 200
    masked, held = split.mask(text)
    assert "20 ms" not in masked and split.unmask(masked, held) == (text, [])
    assert split.unmask("gone", held)[1] == list(held)
    parts = split.translation_segments(text, 100)
    assert "".join(parts) == text and max(map(len, parts)) <= 100


def test_first_json_object():
    assert split.first_json_object('noise ```json\n{"a": {"b": 1}} trailing }') == {"a": {"b": 1}}
    assert split.first_json_object("{broken") == {} and split.first_json_object("") == {}


def test_sanitize():
    assert split.sanitize("é​\x07a\tb\n￿x".replace("￿", "")) == "éa\tb\nx"
    assert split.sanitize(None) is None


def test_html():
    page = "<html><head><title> A  title </title><style>no</style></head><body><nav><p>menu</p></nav><main><h2>Top</h2><p>One<br>two &amp; three " + "word " * 40 + "</p><ul><li>item</ul><script>bad()</script></main></body></html>"
    text, title = html.linearise(page)
    assert title == "A  title" and text.startswith("## Top\n\nOne two & three") and text.endswith("item") and "menu" not in text and "bad" not in text
    assert html.linearise("<p>tiny</p>")[0] == "tiny" and html.linearise(None) == ("", "")
    assert html.decode("<meta charset=gbk>页".encode("gbk")) == "<meta charset=gbk>页" and html.decode(b"\xef\xbb\xbfx") == "x" and html.decode("é".encode()) == "é" and html.decode("中文".encode("gb18030")) == "中文"


def test_windows_of_sentences_are_read_once(monkeypatch):
    """A plan by windows of counts is the plan by texts, to the last bit, and no sentence is cut into words twice."""
    rng = random.Random(5)
    words = ["alpha", "ΟΔΟΣ", "İx", "beta,", "Straße", "γ_1", "e\u0301", "x"]
    for n in (5, 30, 200):
        text = " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) + rng.choice(".!?") for _ in range(n))
        parts = [text[a:b] for a, b in split.sentences(text)]
        for size in (1, 3, 7):
            marks = range(1, len(parts))
            vectors = models.hash_embedding([" ".join(parts[max(0, i - size) : i]) for i in marks] + [" ".join(parts[i : i + size]) for i in marks])
            want = [sum(x * y for x, y in zip(a, b, strict=True)) for a, b in zip(vectors[: len(marks)], vectors[len(marks) :], strict=True)]
            assert models.hash_embedding.likeness(parts, size) == want
        assert split.plan_boundaries(text, models.hash_embedding) == split.plan_boundaries(text, lambda texts: models.hash_embedding(texts))  # noqa: PLW0108  a model without likeness
    read = []
    counts = models._counts
    monkeypatch.setattr(models, "_counts", lambda texts: read.extend(texts) or counts(texts))
    models._PARTS.clear()
    split.plan_boundaries(text, models.hash_embedding)
    split.plan_boundaries(text, models.hash_embedding)
    assert sorted(read) == sorted(set(parts))
