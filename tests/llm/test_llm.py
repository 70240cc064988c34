"""The ten operators against plain versions, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnlake.llm import ann, jpeg, langid, linededup, minhash, mixing, packing, pii, sharding, warc
from tarnlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def documents(spark, rows):
    """(doc_id, text, source) rows with columns that clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)
    return df.withColumn("size", F.lit("clash")).withColumn("shard", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("dropped", F.lit("clash")).withColumn("rank", F.lit("clash"))


def odd_rows():
    """Nulls everywhere, empty and very long texts, repeated rows, ties."""
    return [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, None, None), (None, "x y", "s"), (None, None, None), (3, "", "t"), (4, "word " * 60_000, "t"), (5, "a b c d e f", "t"), (6, "12 ☃ 漢字", None)]


def sf(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 1. packing


def test_tokenizer_is_exact():
    tok, own = Tokenizer.from_file(VOCABULARY), packing.ChunkTokenizer(VOCABULARY, memo_bytes=20_000)
    pool = [chr(i) for i in range(256)] + list("漢ßσΣ١٢👨‍'stre<|>endoftext \ń")
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(3000)] + ["<|endoftext|> a<|endoftext|>b", "½ªº²x 10µm l’été", "ﬁ ǅ İ", ""]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, ids, enc in zip(part, own.encode(part), tok.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == enc.ids, text


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20_000))
def test_piece_lengths(n):
    parts = packing.piece_lengths(n)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 2048 for p in parts) and parts == sorted(parts, reverse=True)
    assert all(c == 1 for p, c in Counter(parts).items() if p < 2048)


def test_packing(spark):
    docs = documents(spark, odd_rows())
    out = packing.pack(docs, VOCABULARY).collect()
    tok = Tokenizer.from_file(VOCABULARY)
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r.start):
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length == 1 << r.bucket
        got[r.doc_id] += r.ids
    for i, t, _ in odd_rows():
        if i not in (1, None):
            assert got[i] == tok.encode(t or "", add_special_tokens=False).ids + [1]
    assert Counter(r.doc_id for r in out if r.start == 0) == {1: 2, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, VOCABULARY, longest=1000)


def test_packing_by_bucket(spark, tmp_path):
    docs = documents(spark, [(i, "word " * (i % 40), "s") for i in range(300)])
    key = lambda df: sorted((r.sequence_id, r.doc_id, r.start, r.length, r.bucket) for r in df.collect())
    out = packing.pack(docs, VOCABULARY, cell_rows=50, longest=8)
    assert key(out) == key(packing.pack(docs.repartition(7), VOCABULARY, cell_rows=50, longest=8))
    assert len({r[0] for r in key(out)}) == len(key(out)) and all(r[0] % 64 == r[4] for r in key(out))
    place = out.withColumn("p", F.spark_partition_id()).collect()
    cells = defaultdict(set)
    for r in place:
        cells[r.bucket, r.sequence_id // 64 % 6].add(r.p)
    assert all(len(p) == 1 for p in cells.values())
    packing.write_buckets(out, f"{tmp_path}/b")
    assert {(r.bucket, r.length) for r in spark.read.parquet(f"{tmp_path}/b").select("bucket", "length").distinct().collect()} == {(k, 1 << k) for k in range(4)}


def test_packing_of_a_whole_table(spark):
    tok = Tokenizer.from_file(VOCABULARY)
    got = defaultdict(list)
    for r in QUERIES["op1_pack_binary"](spark, SF).collect():
        got[r.doc_id].append(r)
    docs = sf(spark).collect()
    assert set(got) == {r.doc_id for r in docs}
    for d in docs:
        ids = np.array(tok.encode(d.text or "", add_special_tokens=False).ids + [1], "<u4")
        rows = sorted(got[d.doc_id], key=lambda r: r.start)
        assert [r.length for r in rows] == packing.piece_lengths(len(ids)) and all(r.doc_tokens == len(ids) and r.offset == 0 for r in rows)
        assert [(r.start, r.ids_crc32) for r in rows] == [(a := sum(x.length for x in rows[:k]), zlib.crc32(ids[a : a + r.length].tobytes())) for k, r in enumerate(rows)]


# 2. pseudonyms


def luhn(s):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_feistel_is_a_permutation(spark):
    m, n = 7, 11
    rows = spark.range(m * n).select(pii.feistel(F.floor(F.col("id") / n), F.col("id") % n, m, n, "k", "t").alias("s")).collect()
    assert len({(r.s.a, r.s.b) for r in rows}) == m * n and all(0 <= r.s.a < m and 0 <= r.s.b < n for r in rows)


def test_pseudonyms_keep_format(spark):
    texts = ["card 4111 1111 1111 1111, 4111111111111111.", "no card 4111111111111112", "on 1980-02-29 (29.02.1980, 02/29/1980)", "not 2023-02-30 or 1850-01-01", "+1 (743) 555-3824 and 212-555-0123", "host 10.0.0.255 not 1.2.3.4.5 or 300.1.1.1", "ssn 123-45-6789 not 000-11-2222", "Mail a.B9@x-y.example.com!", "", None, "x" * 200_000 + " 10.0.0.255"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, pii_card string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    import re

    cards = re.findall(r"\d[\d ]{14,17}\d", out[0].text)
    a, b = (re.sub(r"\D", "", c) for c in cards)
    assert a == b and luhn(a) and a[0] == "4" and a != "4111111111111111" and out[0].text.count(" ") == texts[0].count(" ")
    assert out[1].text == texts[1] and out[3].text == texts[3] and out[8].text == "" and out[9].text is None
    y, rest = out[2].text[3:13], out[2].text[15:-1].split(", ")
    assert rest == ["{2}.{1}.{0}".format(*y.split("-")), "{1}/{2}/{0}".format(*y.split("-"))] and y[:2] == "19"
    assert re.fullmatch(r"\+1 \(\d{3}\) [2-9]\d\d-\d{4} and \d{3}-[2-9]\d\d-\d{4}", out[4].text)
    assert out[5].text.endswith("not 1.2.3.4.5 or 300.1.1.1") and out[5].pii_ip == 1 and out[10].text.split()[1] == out[5].text.split()[1]
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} not 000-11-2222", out[6].text) and out[6].text[4:7] != "123"
    assert re.fullmatch(r"Mail [a-z]\.[A-Z]\d@x-y\.example\.com!", out[7].text)
    other = pii.pseudonymise(df.limit(1), "another key").first()
    assert other.text != out[0].text and pii.pseudonymise(df.limit(0), "key").count() == 0


def plain_pseudonyms(text, key):
    """The rules once more, value by value."""
    import datetime

    import regex as re

    hashed = lambda *parts: int(hashlib.sha256("|".join([key, *map(str, parts)]).encode()).hexdigest()[:12], 16)

    def feistel(a, b, m, n, kind):
        for i in range(8):
            if i % 2 == 0:
                a = (a + hashed(kind, i, b) % m) % m
            else:
                b = (b + hashed(kind, i, a) % n) % n
        return a, b

    def by_length(d, kind):
        n, i = len(d), len(d) // 2
        a, b = feistel(int(d[:i]), int(d[i:]), 10**i, 10 ** (n - i), f"{kind}{n}")
        return f"{a:0{i}d}{b:0{n - i}d}"

    def refill(shape, digits):
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in shape)

    def change(m):
        x = m.group()
        d = re.sub(r"\D", "", x)
        if re.fullmatch(pii.EMAIL, x):
            letters = {c: pool for pool in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") for c in pool}
            local = x.split("@")[0]
            return "".join(letters[c][hashed("email", x.lower(), i) % len(letters[c])] if c in letters else c for i, c in enumerate(local)) + "@" + x.split("@")[1]
        if re.fullmatch(pii.SSN, x):
            area = int(x[:3])
            a, b = feistel((area - 1 - (area > 666)) * 99 + int(x[4:6]) - 1, int(x[7:]) - 1, 898 * 99, 9999, "ssn")
            return f"{a // 99 + 1 + (a // 99 >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
        if re.fullmatch(pii.DATE, x):
            layout = "%Y-%m-%d" if x[4] == "-" else "%d.%m.%Y" if x[2] == "." else "%d/%m/%Y" if x[:2] > "12" else "%m/%d/%Y"
            try:
                day = datetime.datetime.strptime(x, layout).date()
            except ValueError:
                return x
            first = datetime.date(day.year // 100 * 100, 1, 1)
            m, n = pii.CENTURIES[str(day.year)[:2]]
            a, b = divmod((day - first).days, n)
            while True:
                a, b = feistel(a, b, m, n, f"date{day.year // 100}")
                moved = first + datetime.timedelta(a * n + b)
                if layout != "%d/%m/%Y" or moved.day > 12:
                    return moved.strftime(layout)
        if re.fullmatch(pii.IP, x):
            p = [int(v) for v in x.split(".")]
            a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if re.fullmatch(pii.CARD, x):
            if not luhn(d):
                return x
            inner = d[0] + by_length(d[1:-1], "card")
            return refill(x, next(inner + str(c) for c in range(10) if luhn(inner + str(c))))
        if not re.match(r"\+[2-9]", x) and len(d) <= 11:
            a, b = feistel(int(d[-10:-7]), (int(d[-7:-4]) - 200) * 10_000 + int(d[-4:]), 1000, 8_000_000, "phone")
            return refill(x, f"{d[:-10]}{a:03d}{b // 10_000 + 200}{b % 10_000:04d}")
        return refill(x, d[:3] + by_length(d[3:], "abroad")) if 8 <= len(d) <= 15 else x

    return None if text is None else re.sub(pii.ANY, change, text, flags=re.ASCII)


def test_different_dates_stay_different(spark):
    """Every way to write a day of some years with slashes, dots or dashes, as texts that stay as many."""
    rows = spark.sql("SELECT explode(sequence(DATE'1978-01-01', DATE'1982-12-31')) AS d").select(F.explode(F.array(*[F.date_format("d", p) for p in ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy")], F.when(F.dayofmonth("d") > 12, F.date_format("d", "dd/MM/yyyy")))).alias("text")).filter("text IS NOT NULL")
    out = pii.pseudonymise(rows, "k").collect()
    assert len(out) > 6500 and len({r.text for r in out}) == len(out)
    layout = lambda t: "day/" if t[2] == "/" and t[:2] > "12" else t[2].strip("0123456789")
    assert Counter(layout(r.text) for r in out) == Counter(layout(r.text) for r in rows.collect())


def test_long_addresses_are_taken_whole(spark):
    local = "a.long_local-part" * 8
    host = ".".join(["label"] * 30)
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame([(f"to {local}@example.com", ), (f"x@{host}.org",), ("y" * 300_000 + " .z@b.org",)], "text string"), "k").collect()]
    assert "long" not in out[0] and out[0].endswith("@example.com")
    assert out[1] == plain_pseudonyms(f"x@{host}.org", "k") and out[1].endswith(f"@{host}.org")
    assert out[2].startswith("y" * 300_000) and out[2].endswith("@b.org")


def test_pseudonyms_of_a_whole_table(spark):
    before = {r.doc_id: r.text for r in sf(spark).collect()}
    out = {r.doc_id: r.text for r in QUERIES["op2_pseudonyms"](spark, SF).collect()}
    assert out == {i: plain_pseudonyms(t, "a key for these queries") for i, t in before.items()}
    assert sum(out[i] != before[i] for i in out) > 5
    texts = ["666-11-2222 899-99-9999 001-01-0001 665-12-3456 667-12-3456", "1999-12-31 2000-02-29, 31/12/1999 2099-12-31", "5500 0000 0000 0004; 371449635398431 or 378282246310005.", "(212) 555-0123 +14155550123 +49 30 123456", "J.Doe+x@a-b.co.uk, j.doe@x"]
    rows = pii.pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), "k").collect()
    assert [r.text for r in rows] == [plain_pseudonyms(t, "k") for t in texts] and all(r.text != t for r, t in zip(rows, texts, strict=True))


def test_pseudonyms_in_very_long_texts(spark):
    million = ["x@" + "a." * 2000 + "!", "x@" + "a." * 500_000 + "!", "1" * 1_000_000, "a" * 1_000_000, "a@" * 300_000, "1." * 500_000, "1 " * 500_000, "+1" * 500_000, "10.0.0.1 " * 5_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(million)], "doc_id int, text string").withColumn("new", F.lit("kept"))
    out = pii.pseudonymise(df, "k").select("doc_id", F.length("text").alias("n"), (F.col("text") == "").alias("e"), "pii_ip", "new").orderBy("doc_id").collect()
    assert [r.n for r in out[:-1]] == [len(t) for t in million[:-1]] and out[-1].pii_ip == 5_000 and all(r.new == "kept" for r in out)


def test_pseudonyms_of_numbers_before_others(spark):
    texts = ["+44 20 7946 0958 2023", "+44 (20) 7946 0958 2023.", "+4420794609582023", "+49 30 123456"]
    a, b, c, d = (r.text for r in pii.pseudonymise(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), "key").orderBy("doc_id").collect())
    assert "7946 0958" not in a and a.startswith("+44 ") and a.endswith(" 2023") and len(a) == len(texts[0])
    assert "7946 0958" not in b and b.endswith(" 2023.") and c == texts[2] and d != texts[3]


def test_pseudonyms_leave_clean_texts(spark):
    import re

    before = {r.doc_id: r.text for r in sf(spark).collect()}
    ip = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)")
    for r in QUERIES["op2_pseudonyms"](spark, SF).collect():
        text = before[r.doc_id]
        if not re.search("[0-9@]", text):
            assert r.text == text
        found = [*ip.findall(text), *re.findall(r"[A-Za-z0-9.]+@[\w.]+\w", text), *(c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", text) if luhn(c)), *re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text)]
        assert not [x for x in found if x in r.text]
        assert (r.text != text) == bool(found)


# 3. mixing


def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    open_, target, left = set(names), {}, budget * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), " ".join(rng.choice(WORDS, rng.integers(0, 40))), [None, "b", "a", "ä", "c", "d", "e"][min(6, int(rng.geometric(0.4)) - 1)]) for i in range(300)]
    docs = documents(spark, rows + [(900, None, "a"), (901, "", None)])
    out = mixing.mix_plan(spark, docs, bucket_rows=20, keep=["source"]).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.taken == sum(u.words for u in r.uses)
    target = plain_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes) and len(out) == 302
    key = lambda rows: sorted((r.doc_id, r.taken) for r in rows)
    assert key(out) == key(mixing.mix_plan(spark, docs.repartition(5), bucket_rows=20).collect())
    stream = mixing.mix(spark, docs, bucket_rows=20).collect()
    assert [r.position for r in stream] == sorted(r.position for r in stream) and all(0 <= r.position <= 1 for r in stream)
    assert sum(len(r.text.split()) for r in stream) == sum(taken.values())


def test_mixing_odd_cases(spark):
    out = mixing.mix_plan(spark, documents(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows()) and sum(r.size for r in out if r.doc_id == 4) == 60_000
    assert mixing.mix_plan(spark, documents(spark, odd_rows()).limit(0)).count() == 0
    only = mixing.mix_plan(spark, documents(spark, [(1, None, None), (2, "", "a")])).collect()
    assert all(r.taken == 0 for r in only)


def test_mixing_cuts_at_words(spark):
    text = " \n one two\n\tthree  four\r\n five "
    rows = [(1, text, "a"), (2, "x " * 10, "b"), (3, "y " * 10, "c")]
    for budget in (0.4, 0.7, 0.9, 1.1):
        out = [r for r in mixing.mix(spark, documents(spark, rows), budget=budget).collect() if r.doc_id == 1]
        for r in out:
            assert text.startswith(r.text) and len(r.text.split()) == r.words and (r.text == text or not r.text[-1].isspace())


def test_mixing_of_a_whole_table(spark):
    import re

    plan = {r.doc_id: r for r in QUERIES["op3_mix_curriculum"](spark, SF).collect()}
    docs = sf(spark).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        assert plan[d.doc_id].size == n and plan[d.doc_id].taken <= 2 * n
        sizes[d.source] += n
        taken[d.source] += plan[d.doc_id].taken
    target = plain_targets(sizes)
    for d in docs:
        assert plan[d.doc_id].source_size == sizes[d.source] and math.isclose(plan[d.doc_id].target, target[d.source], rel_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes) and len(plan) == len(docs)


def test_curriculum_inverts_demand(spark):
    knots = ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))
    rows = spark.range(101).select((F.col("id") / 100).alias("y"), mixing.time_at(F.col("id") / 100, F.element_at(mixing._literal([knots]), 1)).alias("t")).collect()
    grid = np.linspace(0, 1, 20001)
    w = np.interp(grid, [k for k, _ in knots], [v for _, v in knots])
    area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))))
    for r in rows:
        assert abs(np.interp(r.t, grid, area / area[-1]) - r.y) < 1e-6


# 4. WARC


def test_warc(spark):
    page = "<html>" + "x" * 120 + "</html>"
    rows = [(3, "http://A.b.example.com:80/p?q#f", page), (1, "https://b.example.com", page), (2, None, page), (4, "http://c.org/é\r\nX: y", "é" * 49), (5, "http://c.org/1", "é" * 49), (6, "http://c.org/2", None), (7, "http://c.org/3", ""), (None, "http://c.org/4", page), (8, "http://c.org/5", "l" * 300_000), (8, "http://c.org/5", "l" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).withColumn("digest", F.lit("clash"))
    archive = warc.write(spark, df)
    for most in (100, 1):
        got = warc.read(spark, archive, df.select("url", "page_id"), directory_rows=most).collect()
        assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=repr) == sorted([(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (None, "revisit", 1), (8, "response", None), (8, "response", None)], key=repr)
        for r in got:
            html = next((h for i, _, h in rows if i == r.page_id), "") or ""
            assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest() and r.payload_bytes == len(html.encode())
            assert r.payload == (html.encode() if r.record_type == "response" else None)
    key = lambda u: spark.createDataFrame([(u,)], "u string").select(warc.url_key(F.col("u")).alias("k")).first().k
    assert key("http://A.b.example.com:80/p?q#f") == "com,example,b,a)/p?q" and key("https://b.example.com") == "com,example,b)/" and key(None) == ")/"
    assert warc.locate(spark, archive, spark.createDataFrame([("http://c.org/none", 5), ("http://c.org/1", 99)], "url string, page_id long")).count() == 0
    empty = warc.write(spark, df.limit(0))
    assert warc.read(spark, empty, df.select("url", "page_id")).count() == 0


def test_warc_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 900)
    monkeypatch.setattr(warc, "READ_BYTES", 400)
    df = spark.createDataFrame([(i, f"http://h{i % 4}.org/{i // 8}", f"page {i}") for i in range(64)], "page_id long, url string, html string")
    archive = warc.write(spark, df)
    for most in (100, 3):
        assert sorted(r.page_id for r in warc.read(spark, archive, df, directory_rows=most).collect()) == list(range(64))


# 5. neighbours


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            rows = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [int(ids[j]) for j in rows]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.6).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:400] = x[100]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = ann.search(spark, df, df.filter("vec_id % 20 = 0"), block_rows=300).collect()
    want, got = brute(np.arange(3000), x.astype(np.float64), 20), defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r.query_id].append(r.vec_id)
        assert math.isclose(r.score, float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)), rel_tol=1e-9, abs_tol=1e-9)
    assert np.mean([len(set(got[i]) & set(w)) / 20 for i, w in want.items()]) >= 0.9
    assert got[120] == [j for j in range(100, 400) if j != 120][:20]


def test_neighbours_odd_cases(spark):
    bad = [(None, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [])]
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [0.5, 0.5]), *bad], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    out = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(spark, df, df.filter("vec_id % 20 = 0")).collect())
    assert out == [(0, 1, 20), (0, 2, 21), (20, 1, 0), (20, 2, 21)]
    assert ann.search(spark, df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_repeated_ids_and_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.1, 0.1]), (5, [9.0, 9.0]), (5, [0.2, 0.0]), (6, [3.0, 0.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 1.0, 1.0]), (22, [0.0, 0.0, 2.0]), (40, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(spark, df, df.filter("vec_id % 20 = 0")).collect())
    assert out == [(0, 1, 5, 9.0), (0, 2, 6, 3.0), (20, 1, 21, 6.0), (20, 2, 22, 6.0)]


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding) and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = defaultdict(list)
    for r in QUERIES["op5_learned_partitions"](spark, sf_dir).collect():
        got[r.query_id].append(r.vec_id)
    want = brute(ids, x, 20)
    assert set(got) == set(want) and np.mean([len(set(got[i]) & set(w)) / len(w) for i, w in want.items()]) >= 0.9


def test_clustered_vectors_are_searched_in_part(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 24))
    x = centres[rng.integers(0, 200, 12_000)] + rng.normal(size=(12_000, 24)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    placed, asked = ann.routed(spark, df, df.filter("vec_id % 20 = 0"))
    sizes = Counter(r.part for r in placed.collect())
    asks = asked.collect()
    share = np.mean([sum(sizes[p] for p in r.parts) / len(x) for r in asks])
    assert len(sizes) > 32 and share < 0.2
    part = {r.id: r.part for r in placed.collect()}
    want = brute(np.arange(len(x)), x, 20)
    assert np.mean([part[j] in set(r.parts) for r in asks for j in want[r.id]]) >= 0.9


def test_neighbours_of_mixed_norm(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 16)) * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = (x * rng.lognormal(0, 0.7, (4000, 1))).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(spark, df, df.filter("vec_id % 20 = 0")).collect():
        got[r.query_id].append(r.vec_id)
        assert math.isclose(r.score, float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)), rel_tol=1e-9, abs_tol=1e-9)
    recall = np.mean([len(set(got[i]) & set(w)) / 20 for i, w in brute(np.arange(4000), x.astype(np.float64), 20).items()])
    assert recall >= 0.95, recall


# 6. lines


def test_lines(spark):
    rows = [(i, f"Top \n own {i}\n\n{'rare' if i < 3 else 'x' + str(i)}\nTop", "s") for i in range(30)] + [(100, "Top", "t"), (101, "  Top", "s"), (102, None, "s"), (103, "", "s"), (104, "Top", None), (105, "l " * 500_000 + "\nTop", "s")]
    docs = documents(spark, rows).withColumn("site", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("__site", F.lit("clash")).withColumn("gone", F.create_map(F.lit("a"), F.lit(1)))
    found = linededup.drop_boilerplate(spark, docs)
    out = {r.doc_id: r for r in found.collect()}
    assert out[2].text == " own 2\n\nrare" and (out[3].lines, out[3].dropped) == (4, 2) and out[3].source == "s" and out[3]["__site"] == out[3].site == "clash"
    assert out[100].text == "Top" and out[101].text == "" and out[102].text is None and out[103].text == "" and out[104].text == "Top" and out[105].text == "l " * 500_000
    assert set(found.columns) == {*docs.columns, "lines"} and len(out) == len(rows) and linededup.drop_boilerplate(spark, docs.limit(0)).count() == 0
    hosts = spark.createDataFrame([("HTTP://u:p@A.com:8/x",), ("no url",), (None,)], "u string").select(linededup.host(F.col("u")).alias("h"))
    assert [r.h for r in hosts.collect()] == ["a.com", "", None]
    html = "<html><head><script>a < b\n</script><style>p{}</style></head><body><!-- x --><nav><a href='/'>Home</a></nav><P class=x>One <b>two</b><br>three</p></body>"
    lines = spark.createDataFrame([(html,), (None,)], "h string").select(linededup.html_lines(F.col("h")).alias("t")).collect()
    assert [x for x in lines[0].t.split("\n") if x] == ["Home", "One two", "three"] and lines[1].t is None


def test_lines_of_small_sites(spark):
    """The plain quotient: a line on both pages of a site of two is on all of them; on the one page of a site it repeats nothing."""
    rows = [(10 * k + i, f"own {k} {i}\nmenu", f"s{k}") for k in range(1, 6) for i in range(k)] + [(900, "both", "u"), (901, "both\nmore", "u")]
    out = {r.doc_id: r for r in linededup.drop_boilerplate(spark, documents(spark, rows)).collect()}
    assert {i // 10 for i, r in out.items() if r.dropped} == {2, 3, 4, 5, 90} and out[10].text == "own 1 0\nmenu" and out[900].text == "" and out[901].text == "more"
    some = {r.doc_id: r for r in linededup.drop_boilerplate(spark, documents(spark, rows), prior_pages=30).collect()}
    assert {i // 10 for i, r in some.items() if r.dropped} == {4, 5}


def test_lines_at_the_ratio(spark):
    rows = [(i, f"own {i}" + "\nmany" * (i < 101) + "\nfew" * (i < 100), "s") for i in range(1000)]
    out = {r.doc_id: r for r in linededup.drop_boilerplate(spark, documents(spark, rows)).collect()}
    assert out[3].text == "own 3\nfew" and sum(r.dropped for r in out.values()) == 101


def test_many_lines_of_hot_sites(spark, monkeypatch):
    from tarnlake.llm import shared

    rows = [(i, "\n".join(["menu", f"own {i}", *(f"foot {k}" for k in range(i % 40))]), "s") for i in range(300)]
    want = sorted((r.doc_id, r.text) for r in linededup.drop_boilerplate(spark, documents(spark, rows)).collect())
    monkeypatch.setattr(shared, "HOT_BYTES", 10)
    assert sorted((r.doc_id, r.text) for r in linededup.drop_boilerplate(spark, documents(spark, rows)).collect()) == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twins(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = c.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(x)] for x in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == want


# 7. JPEG


class Writer:
    """A baseline encoder for coefficients given as they are, to check the decoder on what its own encoder never writes."""

    def __init__(self):
        self.bits = ""

    def code(self, table, symbol):
        code, n = table[symbol]
        self.bits += f"{code:0{n}b}"

    def value(self, v, size):
        if size:
            self.bits += f"{v if v > 0 else v + (1 << size) - 1:0{size}b}"

    def done(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00") if bits else b""


def test_decoder_on_colour_with_restarts_and_ac():
    dc_spec = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
    ac_spec = (bytes([0, 2, 1, 1] + [0] * 12), bytes([0x00, 0x01, 0xF0, 0x12]))
    dc, ac = jpeg.huffman(*dc_spec)[2], jpeg.huffman(*ac_spec)[2]
    rng = np.random.default_rng(0)
    mcus, want, scan, last, w = 6, np.zeros((4, 6), int), [], [0, 0, 0], Writer()
    for k in range(mcus):
        if k and k % 2 == 0:
            scan.append(w.done() + bytes([0xFF, 0xD0 + (k // 2 - 1) % 8]))
            w, last = Writer(), [0, 0, 0]
        for part, blocks in ((0, 4), (1, 1), (2, 1)):
            for j in range(blocks):
                level = int(rng.integers(-100, 100))
                d = level - last[part]
                last[part] = level
                w.code(dc, abs(d).bit_length())
                w.value(d, abs(d).bit_length())
                w.code(ac, 0x12)
                w.value(-3, 2)
                w.code(ac, 0xF0)
                w.code(ac, 0x01)
                w.value(1, 1)
                w.code(ac, 0x00)
                if part == 0:
                    want[k // 3 * 2 + j // 2, k % 3 * 2 + j % 2] = level
    scan.append(w.done())
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, bytes([0, 6] + [1] * 63)) + jpeg._segment(0xC0, bytes([8, 0, 30, 0, 45, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += jpeg._segment(0xC4, b"\x00" + dc_spec[0] + dc_spec[1] + b"\x10" + ac_spec[0] + ac_spec[1]) + jpeg._segment(0xDD, b"\0\2") + jpeg._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    thumb, size, end = jpeg.decode_frame(head + b"".join(scan) + b"\xff\xd9", 0, jpeg._Tables())
    assert size == (45, 30) and end == len(head) + sum(map(len, scan)) + 2
    assert (thumb == np.clip(np.rint(want * 0.75 + 128), 0, 255)).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900))
def test_jpeg_round_trip_fast_and_slow(data):
    payload = data + bytes(-len(data) % 64 or (0 if data else 64))
    media, tables = jpeg.encode(payload), jpeg._Tables()
    assert jpeg.decode(media, tables)[0] == payload
    uniform, jpeg._uniform = jpeg._uniform, lambda *a: None
    try:
        assert jpeg.decode(media, tables) == jpeg.decode(media, jpeg._Tables())
        assert jpeg.decode(media, tables)[0] == payload
    finally:
        jpeg._uniform = uniform


def test_jpeg_uniform_scans_of_other_widths():
    levels = np.array([5, -3, 100, 100, -120, 0, 7, 7])
    dc_spec = (bytes([0] * 3 + [9] + [0] * 12), bytes(range(9)))
    dc = jpeg.huffman(*dc_spec)
    assert jpeg._uniform((0, 0, 0, 0, dc[2]), (0, 0, 0, 0, {0: (0, 1)})) is None
    nine = (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1)))
    table = jpeg._Tables()[nine[0] + nine[1]]
    assert jpeg._uniform(table, (0, 0, 0, 0, {0: (0, 1)})) == (9, 1)
    w, last = Writer(), 0
    for v in levels.tolist():
        d, last = v - last, v
        w.code(table[4], abs(d).bit_length())
        w.value(d, abs(d).bit_length())
        w.bits += "0"
    data = w.done().replace(b"\xff\x00", b"\xff")
    assert np.cumsum(jpeg._strided(data, 8, table, 9, 1, jpeg._Tables())).tolist() == levels.tolist()


def test_media(spark):
    docs = documents(spark, odd_rows() + [(7, "é" * 300_000, "t")])
    out = jpeg.media_features(jpeg.media_column(docs)).collect()
    texts = {i: t for i, t, _ in odd_rows()} | {7: "é" * 300_000}
    for r in out:
        if r.doc_id is not None:
            payload = jpeg.payload_of(texts[r.doc_id])
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len(out) == 10 and len({(r.feature, r.media_sha256) for r in out if r.doc_id in (1, 5)}) == 1
    assert len(next(r.feature for r in out if r.doc_id == 7).split(",")) == 2
    assert jpeg.media_features(jpeg.media_column(docs.limit(0))).count() == 0
    kept = jpeg.stored(spark, jpeg.media_column(docs.withColumn("media", F.lit("clash")).withColumn("m", F.create_map(F.lit("a"), F.lit(1))), keep=["media", "m", "shard"]))
    assert kept.columns == ["doc_id", "m", "shard", "n_bytes", "media"] and kept.filter("m['a'] = 1 AND shard = 'clash'").count() == 10
    assert sorted(jpeg.media_features(kept).collect(), key=repr) == sorted(out, key=repr)


def test_media_of_a_whole_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_jpeg_thumbnails"](spark, SF).collect()}
    docs = sf(spark).collect()
    assert len(rows) == len(docs)
    for d in docs:
        payload = jpeg.payload_of(d.text)
        media = jpeg.encode(payload)
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len((d.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


# 8. shards


def test_shards(spark, tmp_path):
    docs = documents(spark, odd_rows() + [(i, "same text", "hot") for i in range(100, 400)])
    dealt = sharding.external_shuffle(spark, docs, shards=8, bucket_bytes=4000)
    out = dealt.collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(out) == 309 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t) for i, t, _ in odd_rows()) + Counter((i, "same text") for i in range(100, 400))
    hot = [r.shard * 1 + 8 * r.slot for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0)) if r.text == "same text"]
    assert abs(np.corrcoef(np.arange(len(hot)), hot)[0, 1]) < 0.3
    assert sharding.external_shuffle(spark, docs.limit(0), shards=8).count() == 0
    sharding.write_shards(dealt, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").groupBy("shard").count().count() == 8


def test_shards_do_not_hang_on_partitions(spark):
    """Many buckets, dealt from other partitions and read in another order: each row has the place that it had."""
    docs = documents(spark, [(i, f"text {i % 700}", "s") for i in range(3000)])
    runs = [sharding.external_shuffle(spark, d, shards=8, bucket_bytes=20_000).select("doc_id", "shard", "slot") for d in (docs.repartition(3), docs.repartition(7).orderBy(F.desc("doc_id")), docs.repartition(7))]
    places = [{r.doc_id: (r.shard, r.slot) for r in d.collect()} for d in runs]
    assert places[0] == places[1] == places[2] and len(set(places[0].values())) == 3000
    order = np.array([places[0][i][1] * 8 + places[0][i][0] for i in range(3000)])
    assert abs(np.corrcoef(np.arange(3000), order)[0, 1]) < 0.1


def test_shards_of_odd_columns(spark):
    docs = documents(spark, odd_rows()).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("nested", F.array(F.struct(F.create_map(F.lit(1), F.lit("x")).alias("k"))))
    docs = docs.withColumn("wide", F.when(F.col("doc_id") == 3, F.lit("w" * 100_000))).withColumn("row", F.lit("clash")).withColumn("bucket", F.lit("clash"))
    first = sharding.external_shuffle(spark, docs, shards=3, bucket_bytes=2000)
    assert first.columns == [*docs.drop("shard").columns, "shard", "slot"]
    key = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", str(r.m), r.wide or "", r.shard, r.slot) for r in df.collect())
    assert key(first) == key(sharding.external_shuffle(spark, docs.repartition(5), shards=3, bucket_bytes=2000)) and len(key(first)) == len(odd_rows())


def test_shards_of_a_whole_table(spark):
    rows = QUERIES["op8_shuffle_shards"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in sf(spark).collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    assert sorted((r.slot, r.shard) for r in rows) == [divmod(k, 8) for k in range(len(docs))]
    assert rows != sorted(rows, key=lambda r: r.doc_id)


# 9. near duplicates


def plain_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_texts(n, seed, edits):
    rng = np.random.default_rng(seed)
    base = rng.choice(WORDS, 150).tolist()
    out = {}
    for i in range(n):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, edits)):
            words[at] = f"w{i}x{at}"
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize(("group", "star"), [(10**9, 20_000), (1500, 20_000), (1500, 900), (200, 200)])
def test_near_duplicates(spark, monkeypatch, group, star):
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", group)
    monkeypatch.setattr(minhash, "STAR_SHINGLES", star)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    rng = np.random.default_rng(5)
    texts = near_texts(60, 1, 7) | {100 + i: " ".join(rng.choice(WORDS, rng.integers(1, 9))) for i in range(80)} | {300: None, 301: "", 302: " \n", 303: "A b C", 304: "a B c", 305: "a b c"}
    df = spark.createDataFrame(list(texts.items()) + [(0, texts[0]), (None, texts[0])], "doc_id long, text string")
    out = minhash.near_duplicates(spark, df).collect()
    want = plain_components(texts)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len(out) == len(texts) + 2 and minhash.near_duplicates(spark, df.limit(0)).count() == 0


def test_near_duplicates_of_a_chain(spark, monkeypatch):
    """A large family whose ends have little in common: most members are linked to their neighbours only."""
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 1000)
    monkeypatch.setattr(minhash, "STAR_SHINGLES", 500)
    texts = {}
    for i in range(60):
        texts[i] = " ".join(f"w{k}" for k in range(4 * i, 4 * i + 100))
    want = plain_components(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df).collect()} == want
    assert {c for _, c in want.values()} == {0}


def test_bands_follow_the_threshold(spark):
    assert [minhash.band_rows(p) for p in (100, 85, 80, 50)] == [256, 7, 5, 2]
    for p in (6, 30, 50, 80, 85, 99):
        r = minhash.band_rows(p)
        assert (1 - (p / 100) ** r) ** (minhash.BINS // r) < 1e-6
    rng = np.random.default_rng(6)
    pairs = {}
    for i in range(40):  # 60 of 120 shingles are common
        common = [f"c{i}x{k}" for k in range(64)]
        for j in range(2):
            pairs[2 * i + j] = " ".join(common + [f"o{i}x{j}x{k}" for k in rng.integers(0, 10**9, 30)])
    want = plain_components(pairs, 50)
    assert sum(i != c for i, (_, c) in want.items()) == 40
    df = spark.createDataFrame(list(pairs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark, df, percent=50).collect()} == want


def test_connecting_links():
    rng = np.random.default_rng(8)
    words = minhash._Words()
    for trial in range(6):
        texts = near_texts(40, trial, 3 + trial) | {i + 50: " ".join(rng.choice(WORDS, 60)) for i in range(10)}
        sets = [minhash.shingles(t, words) for t in texts.values()]
        label = list(range(len(sets)))
        for i, j in minhash.connecting_links(sets, 85):
            label = [label[i] if x == label[j] else x for x in label]
        want = plain_components(dict(enumerate(texts.values())))
        first = {}
        assert [first.setdefault(x, k) for k, x in enumerate(label)] == [want[k][1] for k in range(len(sets))]
        # what is known to be connected needs no links
        known = [want[k][1] if k % 3 else None for k in range(len(sets))]
        label = [k if x is None else known.index(x) for k, x in enumerate(known)]
        for i, j in minhash.connecting_links(sets, 85, known):
            label = [label[i] if x == label[j] else x for x in label]
        first = {}
        assert [first.setdefault(x, k) for k, x in enumerate(label)] == [want[k][1] for k in range(len(sets))]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 7, 60, 3000):
        shared, a, b = (rng.integers(0, 2**63, m, dtype=np.uint64) for m in (4 * n, n, n))
        x, y = (np.unique(minhash.mix(np.concatenate((shared, own)))) for own in (a, b))
        s, t = minhash.sketch(x), minhash.sketch(y)
        assert len(np.unique(s)) == 256 and ((s >> np.uint64(56)) == np.arange(256)).all()
        assert abs((s == t).mean() - 4 / 6) < (0.35 if n == 1 else 0.15)


# 10. language


def test_language(spark):
    rng = np.random.default_rng(0)
    make = lambda pool: "".join(rng.choice(list(pool), 200))
    rows = [(i, make("abcde  " if i % 2 else "éüñß  "), "x" if i % 2 else "y") for i in range(120)] + [(500, None, "x"), (501, "123 ... ☃", "y"), (502, "abc", None), (None, "abcabc", "x"), (503, "ab " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    names, prototypes = langid.fit(df.filter(~langid.held_out()))
    assert names == ["x", "y"]
    out = {r.doc_id: r for r in langid.classify(df, names, prototypes).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:120]) and all(0 <= r.score <= 1 for r in out.values())
    assert (out[500].lang_pred, out[500].score) == ("und", 0.0) and out[501].lang_pred == "und" and out[502].lang_pred == "x" and out[503].lang_pred == "x"
    assert langid.classify(df.limit(0), names, prototypes).count() == 0
    none, empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.classify(df, none, empty).collect()} == {"und"}
    held = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items() if i is not None)


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in sf(spark).select("doc_id", "lang").collect()}
    out = [r for r in QUERIES["op10_language"](spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) >= 0.95


def test_bound_on_training_rows(spark):
    docs = sf(spark)
    names, prototypes = langid.fit(docs, train_rows=100)
    assert len(names) == 4 and np.allclose(np.linalg.norm(prototypes, axis=1), 1, atol=1e-4)


def test_rare_languages_are_learned(spark):
    rows = [(i, "abc abd", "x" if i % 2 else "y") for i in range(3000)] + [(5000 + i, "zzz zyz", "z") for i in range(4)]
    names, _ = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=100)
    assert names == ["x", "y", "z"]


def test_languages_of_other_scripts(spark):
    rng = np.random.default_rng(7)
    pools = {"ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "el": "αβγδεζηθικλμνξοπρστυφχψω", "he": "אבגדהוזחטיכלמנסעפצקרשת", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "ja": "あいうえおかきくけこさしすせそたちつてと日本語", "zh": "的一是不了人我在有他这中大来上国个到说们"}
    words = {k: ["".join(rng.choice(list(p), rng.integers(2, 7))) for _ in range(80)] for k, p in pools.items()}
    rows = [(i, " ".join(rng.choice(words[k], 30)), k) for i, k in enumerate(list(pools) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, prototypes = langid.fit(df.filter(~langid.held_out()))
    out = {r.doc_id: r.lang_pred for r in langid.classify(df, names, prototypes).filter(langid.held_out()).collect()}
    truth = {i: k for i, _, k in rows}
    assert len(out) > 50 and np.mean([truth[i] == p for i, p in out.items()]) >= 0.98


def test_profiles_do_not_depend_on_what_was_met_before(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x400, 0x2000, 400))) for _ in range(30)]
    first = langid.Profiler()
    want = np.vstack([first.bundle([first.counts(t)]) for t in texts])
    monkeypatch.setattr(langid, "_KNOWN", 500)
    monkeypatch.setattr(langid, "_COLUMNS", 300)
    second = langid.Profiler()
    assert np.allclose(second.bundle([second.counts(t) for t in texts]), want)


def test_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError, match="whole number"):
        minhash.near_duplicates(spark, spark.createDataFrame([("a", "x y z")], "doc_id string, text string"))


def test_repetitive_texts_weigh_their_bytes(spark):
    rows = [(k, " ".join(f"w{k}{i % 6}" for i in range(30_000)), "s") for k in range(3)]
    out = minhash.features(documents(spark, rows)).collect()
    assert all(r.n_shingles == 6 and r.weight > 14_000 for r in out)
