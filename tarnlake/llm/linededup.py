"""Line deduplication by site-relative frequency.

Rows are grouped by site (the host of a page, or what stands for it). For each line the pages of the site that contain
it are counted and divided by the site's page total; lines above a boilerplate ratio are dropped from every page of
that site. A line on one page alone repeats nothing and stays. Where few pages shall prove little, ``prior_pages`` pages without
any line may be added to each site's total. The rule is the same at every size. A line is known
by its text without blanks at either end; blank lines are neither counted nor dropped. A page counts once for a line
however often it repeats it.

Only (site, line hash) pairs are shuffled to be counted, summed up before the shuffle. A site's dropped lines are few:
at most lines per page / ratio. They come back to the pages as one array per
site; arrays of sites with over a 200th of all pages are broadcast if they are small together and dealt to salted parts of
the site's pages if not, the others are joined by site. Lines are compared by 64-bit hashes.

Defined cases: null sites form one site; a null text stays null with no lines, an empty one stays empty; a very long
text is one row; a page whose every line goes has an empty text; repeated rows count each; lines at exactly the ratio
stay; an empty table gives no rows; other columns are kept whatever their names, those named ``lines, dropped`` replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_counted, written

RATIO = 0.1
#: What has no text to be read, elements that begin a line, and other markup (fixed patterns, alike in RE2 and Java).
UNREAD = r"(?i)<(?:script\b[^>]*>(?s:.*?)</script\s*>|style\b[^>]*>(?s:.*?)</style\s*>|!--(?s:.*?)-->)"
BLOCK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
MARKUP = r"<[^>]*>"


def _line(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\r"))


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty if it has none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)


def html_lines(html: Column) -> Column:
    """Text of a page with a line for each block; character references stay as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNREAD, ""), BLOCK, "\n"), MARKUP, "")


def drop_boilerplate(spark: SparkSession, df: DataFrame, *, site: str | Column = "source", text: str = "text", ratio: float = RATIO, prior_pages: float = 0) -> DataFrame:
    """``df`` with ``text`` rid of boilerplate lines, and ``lines, dropped long``: how many it had and lost."""
    columns = [c for c in df.columns if c not in ("lines", "dropped")]
    where = (F.col(f"`{site}`") if isinstance(site, str) else site).cast("string")
    skey = F.when(where.isNotNull(), F.concat(F.lit("a"), where)).otherwise("b")
    pages = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"), skey.alias("site"))
    split = F.split("text", "\n")
    full = F.filter(split, lambda x: _line(x) != "")
    own = F.array_distinct(F.transform(full, lambda x: F.xxhash64(_line(x))))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    counts = pages.select("site", F.explode(own).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).filter("n > 1")
    often = F.col("n") > ratio * (F.col("pages") + prior_pages)
    common = written(spark, counts.join(totals, "site").filter(often).groupBy("site").agg(F.collect_list("line").alias("gone"), F.first("pages").alias("pages")), "boilerplate")
    joined = join_counted(pages, common, ["site"], "pages", df.count(), width=8 * F.size("gone"))
    kept = F.filter(split, lambda x: (_line(x) == "") | ~F.array_contains("gone", F.xxhash64(_line(x))))
    out = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(full)).cast("long")
    dropped = F.when(F.col("kept").isNull(), 0).otherwise(F.size(split) - F.size("kept")).cast("long")
    out = out.withColumn("lines", lines).withColumn("dropped", dropped)
    # a text that loses all its lines is empty, whatever blank lines stay
    rest = F.when(F.col("dropped") == 0, F.col("text")).when(F.col("dropped") == F.col("lines"), "").otherwise(F.array_join("kept", "\n"))
    return out.select(*[(rest if c == text else F.col("row").getField(c)).alias(c) for c in columns], "lines", "dropped")


OP6_SQL = f"""
WITH read AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1) AS host,
    regexp_replace(regexp_replace(regexp_replace(html, '{UNREAD}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{MARKUP}', '', 'g') AS text
  FROM pages
), split AS (
  SELECT page_id, host, text, string_split(text, chr(10)) AS ls FROM read
), totals AS (
  SELECT host, count(*) AS pages FROM read GROUP BY host
), counted AS (
  SELECT host, line, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: x <> ''))) AS line FROM split
  ) GROUP BY host, line
), common AS (
  SELECT c.host, list(c.line) AS gone FROM counted c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE c.n > 1 AND c.n::DOUBLE > {RATIO}::DOUBLE * t.pages GROUP BY c.host
), marked AS (
  SELECT s.page_id, s.host, s.text, s.ls,
    list_filter(s.ls, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '') AS held,
    list_filter(s.ls, lambda x: trim(x, chr(32) || chr(9) || chr(13)) = '' OR c.gone IS NULL OR NOT list_contains(c.gone, trim(x, chr(32) || chr(9) || chr(13)))) AS kept
  FROM split s LEFT JOIN common c ON s.host IS NOT DISTINCT FROM c.host
)
SELECT page_id, host, coalesce(len(held), 0)::BIGINT AS lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS dropped,
  CASE WHEN text IS NULL OR len(ls) = len(kept) THEN text WHEN len(ls) - len(kept) = len(held) THEN '' ELSE array_to_string(kept, chr(10)) END AS text
FROM marked
"""
