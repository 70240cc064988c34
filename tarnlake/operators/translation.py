"""Checks of translations (TX-25 to TX-27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions import split
from tarnlake.functions.text import fact_tokens


def lost_facts(pairs: DataFrame, key: str, source: str = "source", target: str = "target", empty: Column | None = None) -> DataFrame:
    """TX-26: ``key, fact, lost`` for each fact that ``target`` holds less often than ``source``; an empty target loses ``empty_translation``.

    Facts are counted as multisets, source and target in one grouping. ``empty`` says which targets count as empty, blank ones if it isn't given.
    """
    count = lambda name, n: pairs.select(key, F.explode(fact_tokens(F.col(name))).alias("fact")).withColumn("n", F.lit(n))
    empty = F.trim(F.coalesce(F.col(target), F.lit(""))) == "" if empty is None else empty
    both = count(source, 1).unionByName(count(target, -1)).join(pairs.filter(empty).select(key).distinct(), key, "left_anti")
    lost = both.groupBy(key, "fact").agg(F.sum("n").cast("long").alias("lost")).filter("lost > 0")
    return lost.unionByName(pairs.filter(empty).select(key, F.lit("empty_translation").alias("fact"), F.lit(1).cast("long").alias("lost")))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("held", T.MapType(T.StringType(), T.StringType()))]))
def _masked(texts):
    import pandas as pd

    found = [split.mask(t) for t in texts]
    return pd.DataFrame({"text": [t for t, _ in found], "held": [h for _, h in found]})


def masked(text: Column) -> Column:
    """TX-27: struct ``text, held``: placeholders for what must stay, and what they stand for."""
    return _masked(text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def segments(texts):
    """TX-25."""
    return texts.map(lambda t: split.translation_segments(t or ""))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("lost", T.ArrayType(T.StringType()))]))
def _restored(texts, held):
    import json

    import pandas as pd

    found = [split.unmask(t or "", json.loads(h) if h else {}) for t, h in zip(texts, held, strict=True)]
    return pd.DataFrame({"text": [t for t, _ in found], "lost": [g for _, g in found]})


def restored(text: Column, held: Column) -> Column:
    """TX-27: struct ``text, lost``: a masked text with its parts (``held``, as JSON) back, and placeholders that it lost."""
    return _restored(text, held)


@F.pandas_udf(T.StringType())
def first_json(texts):
    """TX-28: the first JSON object of a text, written compactly; ``{}`` without one."""
    import json

    return texts.map(lambda t: json.dumps(split.first_json_object(t or ""), separators=(",", ":"), ensure_ascii=False))
