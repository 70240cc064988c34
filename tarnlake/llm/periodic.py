"""Periodic runs in word sequences, by Lyndon arrays over an ordered alphabet.

A run is a maximal stretch with smallest period q that is at least twice as long as q. After Ellert and Fischer: for either
order of the alphabet the Lyndon array is computed (for each suffix the next smaller one, the end being smallest), and of each
edge (i, next smaller j) the right extension, the length that suffixes i and j have in common. Every run has a period, w[i:j]
with i in its first q words, that is such an edge in one of the two orders, and its extensions to the right and to the left are
the ends of the run.

Only comparisons of words decide; no suffix structure, hash or numbering of words is made. Suffixes are compared from left to
right with a stack of the suffixes that have no smaller one yet. Matched extensions are used again in two ways, so that words are compared in
linear time: what suffix i on the stack has in common with the one above it, k, and k with j, gives what i has in common with j
unless the two are equal; and where w[a:a+e] = w[b:b+e] was matched before and j < b+e, the comparison that was made at j-(b-a)
holds at j as well, or all is equal up to b+e and matching goes on there. A run's left extension is matched at its first edge only, over
fewer than q words.

Per row work is Python, as each word depends on the one before; rows are independent, so Spark deals them out and a very long text
is one task's row.

Defined cases: a null text has no words and no runs; so has an empty one; repeated rows give equal results; an empty table gives no
rows; other columns are kept, whatever their names, those named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import crc32_sql, released

LEAST = 24
EXPONENT = 3
EXPONENT_UNIT = 1000
_ROWS = 256
_KINDS = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def edges(w: list, falling: bool, spare: int = 0) -> list[tuple[int, int, int]]:
    """(i, j, e): suffix j is the next smaller after suffix i and both have ``e`` items in common, more than ``spare * (j - i)``.

    ``w`` holds comparable items. ``falling`` turns their order around; the end of the text is smallest in either order.
    The first edge of a run of x periods or more has over x - 2 periods in common, as less than one lies to its left.
    """
    n = len(w)
    found: list[tuple[int, int, int]] = []
    if not n:
        return found
    stack = [0]
    under = [0] * n  # what the suffix has in common with the one below it on the stack when it was put there
    first = [0] * n  # what suffixes j-1 and j have in common
    over: dict[tuple[int, int], int] = {}  # the same of other pairs compared, where it isn't 0
    shift, reach = 0, 0  # w[k] == w[k - shift] for all k from some j up to reach
    last = w[0]
    for j in range(1, n):
        word = w[j]
        k = j - 1
        if word != last:
            common = 0
            smaller = (word < last) is not falling
        else:
            if j < reach and (c := first[j - shift]) < reach - j:
                common = c
            else:
                common = reach - j if j < reach else 1
                while j + common < n and w[k + common] == w[j + common]:
                    common += 1
                if j + common > reach:
                    shift, reach = j - k, j + common
            first[j] = common
            smaller = j + common == n or (w[j + common] < w[k + common]) is not falling
        last = word
        while smaller:
            stack.pop()
            if common > spare * (j - k):
                found.append((k, j, common))
            if not stack:
                break
            i = stack[-1]
            below = under[k]
            if below < common:  # suffix i is as far from k as it is from j
                common = below
                smaller = False
            elif below == common:
                if common or w[i] == word:
                    c = over.get((i - shift, j - shift), 0) if j + common < reach else 0
                    if common <= c < reach - j:
                        common = c
                    else:
                        common = max(common, 1, min(c, reach - j))
                        while j + common < n and w[i + common] == w[j + common]:
                            common += 1
                        if j + common > reach:
                            shift, reach = j - i, j + common
                    if common:
                        over[i, j] = common
                    smaller = j + common == n or (w[j + common] < w[i + common]) is not falling
                else:
                    smaller = (word < w[i]) is not falling
            k = i
        under[j] = common if stack else 0
        stack.append(j)
    return found


def runs(w: list, least: int = 2, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` items and ``exponent`` (2 or more) periods, in that order."""
    out = set()
    for falling in (False, True):
        found = edges(w, falling, exponent - 2)
        known = {(i, j) for i, j, common in found if common >= j - i}
        for i, j, common in found:
            q = j - i
            if (i - q, i) in known:  # not the first edge of its run
                continue
            back = 0
            while back < i and back < q and w[i - back - 1] == w[j - back - 1]:
                back += 1
            length = back + q + common
            if length >= least and length >= exponent * q:
                out.add((i - back, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def dropped(n: int, found: list[tuple[int, int, int]]) -> bytearray:
    """A one for each word that lies in a run after that run's first period."""
    out = bytearray(n)
    for start, length, q in found:
        out[start + q : start + length] = b"\1" * (length - q)
    return out


def _greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    best = None
    for run in found:  # by start and period, so that ties keep the earlier one
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(docs: DataFrame, *, text: str = "text", least: int = LEAST, exponent: int = EXPONENT, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, key: str | None = None, emit_text: bool = True) -> DataFrame:
    """``docs`` with the runs of each text's words (``n_runs``, the one of greatest exponent as ``start, length, period,
    exponent_milli``, ``runs_sha256``) and what is left when each keeps its first period (``collapsed string, collapsed_sha256``).

    Words are what blanks, tabs, line and page ends separate. ``rewrite(key, words)`` may give other words for a row.
    """
    if least < 1 or exponent < 2:
        raise ValueError("a run has two periods at least")
    taken = [c for c in docs.columns if c not in _KINDS and (c != "collapsed" or not emit_text)]
    key_column = F.col(f"`{key}`") if key else F.lit(None).cast("string")
    inner = docs.select(F.col(f"`{text}`").cast("binary").alias("__text"), key_column.alias("__key"), *[F.col(f"`{c}`") for c in taken])
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in inner.schema.fields[2:])

    def read(words: list[bytes]) -> tuple:
        found = runs(words, least, exponent) if len(words) >= max(least, exponent) else []
        if found:
            gone = dropped(len(words), found)
            words = [x for x, out in zip(words, gone, strict=True) if not out]
        rest = b" ".join(words)
        top = _greatest(found)
        listed = "".join("%d,%d,%d\n" % run for run in found)
        best = (None,) * 4 if top is None else (*top, EXPONENT_UNIT * top[1] // top[2])
        return (len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(), rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                out = []
                for value, name in zip(batch.column(0), batch.column(1), strict=True):
                    words = (value.as_py() or b"").split()
                    if rewrite is not None:
                        words = rewrite(name.as_py(), words)
                    out.append(read(words) if emit_text else read(words)[:-1])
                names = [*_KINDS, *["collapsed"] * emit_text]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*_KINDS.values(), pa.string()], strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], [*batch.schema.names[2:], *names])

    return inner.mapInArrow(released(run), kinds + SCHEMA + ", collapsed string" * emit_text)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of every tenth document, by the checksum of its id, a tail that repeats: a case in which something is known to be found."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


#: Every run of 24 words and three periods q repeats its sequences of eight words at distance q, so stretches of such pairs are its
#: extent; a stretch with several distances has the smallest for its period.
OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS key, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents),
sized AS (SELECT key, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS tail, h // 10 AS g FROM docs),
cut AS (SELECT *, CASE WHEN tail THEN g % n END AS a FROM sized),
held AS MATERIALIZED (SELECT *, CASE WHEN tail THEN 1 + (n - a) // (3 + g % 8) END AS p FROM cut),
orig AS (SELECT key, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k FROM held),
placed AS (SELECT o.key, o.k, CASE WHEN h.tail AND o.k >= h.a THEN h.a + (o.k - h.a) % h.p ELSE o.k END AS from_k FROM orig o JOIN held h USING (key)),
words AS MATERIALIZED (SELECT p.key, p.k, o.word FROM placed p JOIN orig o ON p.key = o.key AND p.from_k = o.k),
eights AS (SELECT key, k, list(word) OVER (PARTITION BY key ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ws FROM words),
full8 AS (SELECT key, k, array_to_string(ws, ' ') AS s FROM eights WHERE len(ws) = 8),
pairs AS (SELECT x.key, x.k, y.k - x.k AS q FROM full8 x JOIN full8 y ON x.key = y.key AND x.s = y.s AND x.k < y.k),
marked AS (SELECT *, k - row_number() OVER (PARTITION BY key, q ORDER BY k) AS isle FROM pairs),
isles AS (SELECT key, q, min(k) AS s, count(*) + 7 + q AS len FROM marked GROUP BY key, q, isle),
runs AS MATERIALIZED (SELECT key, s, len, min(q) AS q FROM isles WHERE len >= greatest({LEAST}, {EXPONENT} * q) GROUP BY key, s, len),
listed AS (SELECT key, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS text FROM runs GROUP BY key),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY len::DOUBLE / q DESC, s, q) AS r FROM runs) WHERE r = 1),
gone AS (SELECT DISTINCT key, unnest(range(s + q, s + len)) AS k FROM runs),
kept AS (SELECT w.key, string_agg(w.word, ' ' ORDER BY w.k) AS text FROM words w ANTI JOIN gone g ON w.key = g.key AND w.k = g.k GROUP BY w.key)
SELECT h.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.len // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM held h LEFT JOIN listed l USING (key) LEFT JOIN best b USING (key) LEFT JOIN kept k USING (key)
"""
