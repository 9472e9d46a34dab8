"""Healing words that a stray blank split in two.

Eligible neighbours form islands; merging left to right without overlap takes every
other pair of an island, which is a window expression over eligible pairs alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..script import ScriptProfile
from ..staging import small, stage
from . import morph
from .lexicon import MAX_BROADCAST, Lexicon


def near(toks: Column, p: ScriptProfile) -> Column:
    """array<struct<pos,start,end,w1,w2>>: words of a token array with one blank between them, protected words aside."""
    at = F.when(F.size(toks) > 2, F.sequence(F.lit(0), F.size(toks) - 3)).otherwise(F.array().cast("array<int>"))
    t = lambda i, c: F.get(toks, i)[c]
    fine = lambda i: (t(i, "type") == "word") & (t(i + 1, "value") == " ") & (t(i + 2, "type") == "word")
    some = F.transform(F.filter(at, fine), lambda i: F.struct(i.alias("pos"), t(i, "start").alias("start"), t(i + 2, "end").alias("end"), t(i, "value").alias("w1"), t(i + 2, "value").alias("w2")))
    return F.filter(some, lambda x: ~x["w1"].isin(*p.protected) & ~x["w2"].isin(*p.protected))


def starts(text: Column, p: ScriptProfile) -> Column:
    """array<string>: every word of a text, with the next one behind it if one blank alone parts them."""
    return F.regexp_extract_all(text, F.lit(f"(?<![{p.word}])(?=([{p.word}]++(?: [{p.word}]++)?))"), F.lit(1))


def judged(pairs: DataFrame, lexicon: Lexicon, p: ScriptProfile) -> DataFrame:
    """Distinct (w1, w2) that are one word, of pairs that may repeat; protected words aside.

    If the lexicon is broadcast, pairs that cannot be one word go before any are dealt out.
    """
    each = pairs.filter(~F.col("w1").isin(*p.protected) & ~F.col("w2").isin(*p.protected)).select("w1", "w2", F.concat("w1", "w2").alias("word"))
    if lexicon.size > MAX_BROADCAST:
        each = each.distinct()
    # A second word that is a suffix or starts like an auxiliary needs no lookup.
    sure = reduce(lambda x, a: x | F.startswith("w2", F.lit(a)), p.auxiliaries, F.col("w2").isin(*p.suffixes))
    tail = reduce(lambda x, t: x | F.endswith("word", F.lit(t)), p.suffixes, F.lit(False))
    there = lambda name, flag: lexicon.words(name).withColumn(flag, F.lit(True))
    known = each.join(there("word", "joined"), "word", "left").join(there("w1", "first"), "w1", "left")
    fine = F.coalesce(sure | F.col("joined"), F.lit(False))
    kept = known.select("w1", "w2", "word", fine.alias("fine"), (F.col("first").isNull() & tail).alias("open")).filter("fine OR open").select("w1", "w2", "word", "fine")
    kept = stage(kept.distinct())
    rest = kept.filter("NOT fine")
    parts = morph.decompose(rest.select("word").distinct(), lexicon, p).select("word")
    return kept.filter("fine").select("w1", "w2").unionByName(rest.join(parts, "word", "left_semi").select("w1", "w2"))


def pairs(texts: DataFrame, lexicon: Lexicon, p: ScriptProfile, *, key="doc_id", toks_col="toks") -> DataFrame:
    """(key, pos, start, end, w1, w2) of the pairs that are merged.

    ``texts`` has the key (unique) and an array of tokens, whose pos is their place in
    it.  Pairs are found within each text and judged once per distinct pair of words.
    """
    some = stage(texts.select(key, F.explode(near(F.col(toks_col), p)).alias("n")).select(key, "n.*"))
    good = stage(judged(some.select("w1", "w2"), lexicon, p))
    ok = some.join(small(good), ["w1", "w2"], "left_semi")
    # Pairs at places i and i + 2 share a word.
    o = Window.partitionBy(key).orderBy("pos")
    isle = ok.withColumn("isle", F.col("pos") - 2 * F.row_number().over(o))
    turn = F.row_number().over(Window.partitionBy(key, "isle").orderBy("pos"))
    return isle.withColumn("turn", turn).filter("turn % 2 = 1").select(key, "pos", "start", "end", "w1", "w2")
