"""Operators 11 to 13 against plain versions, their twins and their defined cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnlake.llm import decontaminate, merkle, periodic
from tarnlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)
    for c in ("spans", "items", "tree", "pos", "n", "start", "period", "leaf", "index", "path"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def odd_rows():
    return [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, None, None), (None, "x y", "s"), (None, None, None), (3, "", "t"), (4, "word " * 60_000, "t"), (5, "a b c d e f", "t"), (6, "12 ☃ 漢字", None)]


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_periodic_runs", "op13_merkle_manifest"])
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert Counter(want.fetchall()) == Counter(tuple(r[c] for c in names) for r in got.collect())


# 12. runs


def plain_runs(w, least, exponent):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, exponent * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.integers(1, 9), st.lists(st.sampled_from("ab"), max_size=30), st.integers(2, 4))
def test_runs(head, times, tail, exponent):
    for w in (head * times + tail, tail + head * times, (tail[:3] * 4 + head) * 3):
        assert periodic.runs(w, 2, exponent) == plain_runs(w, 2, exponent)


class Word:
    """Counts comparisons, and has no hash."""

    seen = 0
    __hash__ = None

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Word.seen += 1
        return self.v == other.v

    def __lt__(self, other):
        Word.seen += 1
        return self.v < other.v


@pytest.mark.parametrize("make", [lambda n: "a" * n, lambda n: ("ab" * 30 + "a") * n, lambda n: "".join("01"[bin(i).count("1") & 1] for i in range(n)), lambda n: "abcde" * 17 + "x" * n])
def test_runs_compare_in_linear_time(make):
    counts = []
    for n in (2000, 8000):
        Word.seen = 0
        periodic.runs([Word(c) for c in make(n)[:n]], 24, 3)
        counts.append(Word.seen / n)
    assert max(counts) < 14 and counts[1] < 1.2 * counts[0] + 1


def test_collapse(spark):
    rows = odd_rows() + [(7, "x " + "a b c " * 10 + "y", "t"), (8, "k " * 23, "t"), (9, "k " * 24, "t")]
    out = {r.doc_id: r for r in periodic.collapse(documents(spark, rows)).collect()}
    assert out[7].collapsed == "x a b c y" and (out[7].n_runs, out[7].start, out[7].length, out[7].period, out[7].exponent_milli) == (1, 1, 30, 3, 10_000)
    assert out[8].n_runs == 0 and out[8].start is None and out[9].collapsed == "k"
    assert out[4].length == 60_000 and out[4].collapsed == "word" and out[4].pos == "clash"
    assert out[2].n_runs == 0 and out[2].collapsed == "" and out[2].text is None and out[2].runs_sha256 == sha("")
    assert periodic.collapse(documents(spark, odd_rows())).count() == 9
    assert periodic.collapse(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.collapse(documents(spark, []), exponent=1)


def test_planted_tail():
    words = [b"%d" % i for i in range(50)]
    changed = [d for d in range(300) if periodic.planted(d, words) != words]
    assert 10 < len(changed) < 60
    for d in changed:
        assert len(periodic.planted(d, words)) == 50
    assert periodic.planted(None, words) == words and periodic.planted(changed[0], []) == []


# 11. decontamination


def plain_words(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_hits(docs, items, window):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + window]), set()).add(name)
    out = []
    for text in docs:
        w = plain_words(text)
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    found |= names
                    hit |= set(range(k, k + size))
        out.append((len(w), sorted(hit), sorted(found)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "longerword1", "longerword2", "É"]), max_size=9), max_size=5), st.lists(st.sampled_from(["a", "bb", "longerword1", "longerword2", "É", "zz"]), max_size=40), st.integers(1, 4))
def test_automaton(items, doc, window):
    named = [(k, " ".join(w).encode()) for k, w in enumerate(items)]
    automaton = decontaminate.Automaton(named, window)
    words = decontaminate.Words(", ".join(doc).upper().replace("É", "É").encode())
    spans, found, longest = automaton.match(words)
    want = plain_hits([", ".join(doc)], [(k, w.decode()) for k, w in named], window)[0]
    assert (len(words), [x for a, b in spans for x in range(a, b)], sorted(automaton.items[k] for k in found)) == want
    sequences = [" ".join(w) + " " for w in items]
    best = max((n for n in range(len(doc) + 1) if any(" " + " ".join(doc[k : k + n]) + " " in " " + s for s in sequences for k in range(len(doc) - n + 1))), default=0)
    assert longest == best or longest < automaton.shortest  # stretches too short for any window aren't walked


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 12])
def test_scan_in_blocks(spark, block_words):
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["one two three four five six seven eight nine ten eleven", "ONE two three", None, "", "...", "alone", "one two three", "five six seven eight nine ten eleven twelve thirteen fourteen"])], "item_id long, text string")
    rows = odd_rows() + [(7, "x One, two three four five six seven eight nine ten eleven twelve thirteen fourteen y", "t"), (8, "a two three", "t"), (9, "z one two three", "t"), (10, "Alone! alone", "t")]
    out = decontaminate.scan(spark, documents(spark, rows), items, block_words=block_words).collect()
    want = plain_hits([t for _, t, _ in rows], [(r.item_id, r.text) for r in items.collect()], 10)
    got = Counter((r.doc_id, r.n_words, tuple(x for s in r.spans for x in range(s["first"], s["end"])), tuple(sorted(r["items"]))) for r in out)
    assert got == Counter((d, n, tuple(h), tuple(f)) for (d, _, _), (n, h, f) in zip(rows, want, strict=True))
    assert decontaminate.scan(spark, documents(spark, []), items, block_words=block_words).count() == 0
    none = decontaminate.digests(decontaminate.scan(spark, documents(spark, rows), items.filter("false")), "doc_id").filter("contaminated OR n_items > 0")
    assert none.count() == 0


def test_remove(spark):
    ten = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, ten), (2, "alone here")], "item_id long, text string")
    rest = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"É {rest} - {ten}; {rest}", "s"), (2, ten, "s"), (3, f"{rest} alone here", "s"), (4, None, "s"), (5, "", "s")]
    out = {r.doc_id: r.text for r in decontaminate.remove(decontaminate.scan(spark, documents(spark, rows), items)).collect()}
    assert out == {1: f"É {rest} - ; {rest}".replace("-  ;", "-"), 3: f"{rest} alone here", 4: None, 5: ""}


# 13. Merkle manifest


def plain_tree(nodes):
    paths = [[] for _ in nodes]
    level, members = list(nodes), [[k] for k in range(len(nodes))]
    while len(level) > 1:
        up, ups = [], []
        for k in range(0, len(level), 16):
            run = level[k : k + 16]
            for j in range(len(run)):
                for i in members[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            ups.append(sum(members[k : k + 16], []))
        level, members = up, ups
    return level[0], paths


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {None: 3, "": 256, "é": 257, "z": 1}, {f"s{k:03}": 1 + k % 3 for k in range(40)}])
def test_manifest(spark, sizes):
    rows = [(k, f"Text {s} {k}", s) for s, n in sizes.items() for k in range(n)]
    df = documents(spark, rows).repartition(7)
    made = merkle.build(spark, df)
    got = {(r.source, r.doc_id): r for r in merkle.proofs(made).collect()}
    assert len(got) == len(rows)
    order = sorted(sizes, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf((k, s, "en", len(f"Text {s} {k}"), f"Text {s} {k}")) for k in range(sizes[s])]) for s in order}
    root, above = plain_tree([trees[s][0] for s in order])
    assert made.root == root
    for s, up in zip(order, above, strict=True):
        for k, path in enumerate(trees[s][1]):
            assert [tuple(x) for x in got[s, k].path] == path + up and got[s, k].subroot == trees[s][0]


def test_forest_is_a_commutative_monoid():
    leaves = {t: [sha(f"{t} {k}") for k in range(n)] for t, n in ((0, 300), (1, 1), (2, 17))}
    rows = [(t, len(d), 0, k, v) for t, d in leaves.items() for k, v in enumerate(d)]
    want = plain_tree([plain_tree(d)[0] for d in leaves.values()])[0]
    for step in (1, 7, 100):
        parts = []
        for at in range(0, len(rows), step):
            parts.append(merkle.Forest(3))
            for r in rows[at : at + step]:
                parts[-1].add(*r)
        parts = parts[::2] + parts[1::2][::-1]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.merge(p)
        assert whole.root == want and not whole.open
        assert len(whole.closed) == len(set(whole.closed))
    stretch = merkle.Forest(3)
    for r in rows[20:280]:
        stretch.add(*r)
    assert sum(map(len, stretch.open.values())) <= 4 * 15  # a few on each level at either end


def test_audit_cases(spark):
    out = merkle.audit(spark, documents(spark, odd_rows()).withColumn("text", F.upper("text"))).collect()
    assert len(out) == 9 and len({r.root for r in out}) == 1
    for r in out:
        assert r.verified == (r.folded_root == r.root)
    assert len({(r.doc_id, r.leaf) for r in out}) == 8  # the repeated row
    assert merkle.audit(spark, documents(spark, [])).count() == 0
    assert merkle.build(spark, documents(spark, [])).root is None
