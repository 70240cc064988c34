"""Deterministic stand-ins for model calls (UD-01 to UD-08); callers inject real ones."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.split import first_json_object
from tarnlake.snapshots import Store
from tarnlake.storage import stored

DIMENSIONS = 64


_SEEN: dict[str, int] = {}


def _token_hash(word: str) -> int:
    """Hash of a token, remembered by the worker for tokens it has met."""
    found = _SEEN.get(word)
    if found is None:
        if len(_SEEN) >= 500_000:
            _SEEN.clear()
        found = _SEEN[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
    return found


_WORD = re.compile(r"\w+")


def _counts(texts: list[str]) -> np.ndarray:
    """Signed counts of hashed tokens, a row for each text."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = list(chain.from_iterable(words))
    found = list(map(_SEEN.get, flat))
    if None in found:
        found = [_token_hash(w) if x is None else x for w, x in zip(flat, found, strict=True)]
    h = np.fromiter(found, np.uint64, len(found))
    at = np.repeat(np.arange(len(words)), sizes) * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64)
    return np.bincount(at, np.where(h >> np.uint64(63), 1.0, -1.0), len(words) * DIMENSIONS).reshape(-1, DIMENSIONS)


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def hash_embedding(texts: list[str]) -> list[list[float]]:
    """UD-01: signed counts of hashed tokens, scaled to length 1."""
    return _scaled(_counts(texts)).tolist()


#: Counts of the last sentences that were met.
_PARTS: dict[str, np.ndarray] = {}


def _likeness(parts: list[str], size: int) -> list[float]:
    """For each mark between two parts the inner product of the embeddings of up to ``size`` parts before it and of those after it, joined by spaces.

    Counts of joined parts are sums of theirs, so each part is read once, also where a level below asks for it again; they are whole
    numbers, so the products are those of :func:`hash_embedding` to the last bit.
    """
    new = [p for p in dict.fromkeys(parts) if p not in _PARTS]
    if len(_PARTS) + len(new) > 5000:
        _PARTS.clear()
        new = list(dict.fromkeys(parts))
    if new:
        _PARTS.update(zip(new, _counts(new), strict=True))
    upto = np.zeros((len(parts) + 1, DIMENSIONS))
    np.cumsum([_PARTS[p] for p in parts], axis=0, out=upto[1:])
    i = np.arange(1, len(parts))
    return list(map(sum, (_scaled(upto[i] - upto[np.maximum(i - size, 0)]) * _scaled(upto[np.minimum(i + size, len(parts))] - upto[i])).tolist()))


hash_embedding.likeness = _likeness


def embed(text: Column, model: Callable[[], Callable[[list[str]], list[list[float]]]] = lambda: hash_embedding, batch: int = 50) -> Column:
    """UD-01: the model is made once a worker and sees batches; a wrong number of vectors is an error."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model()
        for s in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(s), batch):
                part = s.iloc[at : at + batch].fillna("").tolist()
                got = f(part)
                if len(got) != len(part):
                    raise ValueError("the model returned another number of vectors")
                vectors += got
            yield pd.Series(vectors, index=s.index)

    return run(text)


def grade(best: Column, ambiguity: Column) -> Column:
    """UD-03: what a grader says, by thresholds on the best candidate's score; the fields that routing reads."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(best > 60, "strong").when(best > 20, "weak").otherwise("none").alias("relevance"), F.when(best > 80, "sufficient").when(best > 40, "partial").otherwise("none").alias("answerability"),
        ambiguity.alias("ambiguity"), F.lit("answer").alias("route"), F.lit(0.5).alias("confidence"), F.lit("by score").alias("reason"), none.alias("missing_slots"), F.lit("").alias("hitl_prompt"), none.alias("hitl_options"),
    )


def structured(asked: DataFrame, call: Callable[[DataFrame], DataFrame], name: str, fields: Sequence[str]) -> DataFrame:
    """UD-03: ``key, answer, attempts, error``: a model's reply to each prompt (``asked``: key, prompt) as a JSON object with all ``fields``.

    ``call`` gives ``key, reply``. A reply may have text or a fence around its object; one without an object, or without some field, is asked for
    once more with the format spelled out, and only such ones are. What fails again has a null answer and says so. Replies are
    written before they are read, so no prompt is sent twice.
    """
    spark = asked.sparkSession
    repair = f"上一条响应无法解析。请调用 {name}，或只输出一个合法 JSON 对象；必须包含这些字段：{', '.join(fields)}。不要解释，不要使用 Markdown。"
    said = F.pandas_udf(lambda texts: texts.map(lambda t: json.dumps(first_json_object(t or ""), ensure_ascii=False)), "string")

    def parsed(prompts: DataFrame) -> DataFrame:
        told = stored(spark, call(prompts.select("key", "prompt")).select("key", said("reply").alias("answer")), "replies")
        held = F.json_object_keys("answer")
        whole = F.forall(F.array(*[F.lit(f) for f in fields]), lambda f: F.array_contains(held, f))
        return prompts.select("key", "prompt").join(told, "key", "left").withColumn("answer", F.when(whole, F.col("answer")))

    one = parsed(asked)
    again = one.filter("answer IS NULL").select("key", F.concat("prompt", F.lit("\n"), F.lit(repair)).alias("prompt"))
    two = parsed(again) if not again.isEmpty() else again.withColumn("answer", F.lit(None).cast("string"))
    why = F.when(F.col("answer").isNull(), F.lit(f"{name} returned neither a tool call nor valid JSON after a format retry"))
    good = one.filter("answer IS NOT NULL").select("key", "answer", F.lit(1).alias("attempts"))
    return good.unionByName(two.select("key", "answer", F.lit(2).alias("attempts"))).withColumn("error", why)


def split_question(question: Column) -> Column:
    """UD-04: two to four sub-questions at conjunctions, or none."""
    parts = F.filter(F.transform(F.split(question, r"(?i)\s+and\s+|[;；、]|以及|和"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts).between(2, 4), parts)


def rewrite_question(question: Column, mode: str = "step_back") -> Column:
    """UD-05: a wider question, or a made-up passage to search with."""
    return F.concat(F.lit("Background of: "), question) if mode == "step_back" else F.concat(F.lit("A passage that answers: "), question)


def answer(context: Column, refusal: str = "The knowledge base has no answer.") -> Column:
    """UD-06: the evidence's first sentence; a fixed refusal without evidence."""
    first = F.regexp_extract(F.regexp_replace(context, r"\A\[\d+\][^\n]*\n", ""), r"\A([^.!?\n]*[.!?]?)", 1)
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(refusal)).otherwise(first)


def judge(answer: Column, fact: Column) -> Column:
    """UD-07: pass if the answer holds the fact."""
    return F.when(fact.isNull() | answer.isNull(), "review").when(F.contains(F.lower(answer), F.lower(fact)), "pass").otherwise("fail")


#: Fixed value: names the wording that translations were made with.
PROMPT_VERSION = "enterprise-zh-v2"


def translation_key(text: Column, language: str, model: str = "identity", version: str = PROMPT_VERSION) -> Column:
    """UD-08: hash of the text's hash and of all that a translation depends on."""
    return F.sha2(F.concat_ws("\n", F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(language), F.lit(model), F.lit(version)), 256)


CACHED = "key string, translation string"


def translate_through(texts: DataFrame, path: str, language: str, call: Callable[[DataFrame], DataFrame], model: str = "identity", version: str = PROMPT_VERSION) -> DataFrame:
    """UD-08: ``texts`` with ``key, translation, cached``, through a cache in ``path`` that keeps what it lacked.

    ``call`` gets the missing texts (key, text), each once however often it is asked for, and gives ``key, translation``; without missing ones it
    is not called. What it gives is written before it is read, so a model is asked once, and committed as an addition: several
    writers may add at a time, and of two translations of one key the smaller one counts for every reader. A null text has none.
    """
    spark = texts.sparkSession
    store = Store(spark, path)
    snapshot = store.snapshot()
    held = lambda s: store.read(s, "translations", "t", CACHED).groupBy("key").agg(F.min("translation").alias("translation"))
    asked = texts.withColumn("key", translation_key(F.col("text"), language, model, version))
    known = held(snapshot)
    missing = asked.filter("text IS NOT NULL").groupBy("key").agg(F.min("text").alias("text")).join(known.select("key"), "key", "left_anti")
    missing = stored(spark, missing, "missing")
    if not missing.isEmpty():
        name, note = store.stage(lambda at: call(missing).select("key", "translation").write.parquet(f"{at}/t"), "translations")
        snapshot = store.commit(snapshot, {name: note}, again=8)
    before = known.select("key", F.lit(True).alias("__was"))
    return asked.join(held(snapshot), "key", "left").join(before, "key", "left").withColumn("cached", F.col("text").isNotNull() & F.coalesce("__was", F.lit(False))).withColumn("translation", F.when(F.col("text").isNotNull(), F.col("translation"))).drop("__was")


def translate(texts: DataFrame, cache: DataFrame, language: str, model: str = "identity", version: str = PROMPT_VERSION) -> DataFrame:
    """UD-08: ``text, key, translation, cached``: from the cache (key, translation) by content and settings; what is missing goes to the stand-in, which leaves it as it is.

    Texts that are equal share a key, and with it a cached translation.
    """
    held = cache.groupBy("key").agg(F.first("translation", ignorenulls=True).alias("__t"))
    asked = texts.withColumn("key", translation_key(F.col("text"), language, model, version))
    return asked.join(held, "key", "left").withColumn("cached", F.col("__t").isNotNull()).withColumn("translation", F.coalesce("__t", "text")).drop("__t")
