"""Morphology, set at a time: every function takes distinct words and answers for all of them.

Suffix matches are equi-joins on word tails (never an ``endswith`` join), stems and
compound parts are probed in the lexicon by hash joins, and the first hit in rule order
wins by ``min``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..script import ScriptProfile
from ..staging import stage
from .lexicon import Lexicon, literal_table


def suffix_table(df: DataFrame, p: ScriptProfile) -> DataFrame:
    """(suffix, rank, reported): the profile's suffixes, longest first."""
    rows = [(s, i, p.reported.get(s, s)) for i, s in enumerate(p.ranked_suffixes)]
    return F.broadcast(literal_table(df.sparkSession, rows, ["suffix", "rank", "reported"]))


def suffix_matches(words: DataFrame, p: ScriptProfile) -> DataFrame:
    """(word, root, suffix, rank, reported) of every suffix that a longer word ends in."""
    n = F.length("word")
    most = max(map(len, p.suffixes), default=0)
    k = F.explode(F.sequence(F.lit(1), F.least(n - 1, F.lit(most))))
    tails = words.filter(n > 1).select("word", k.alias("k")).select("word", "k", T.substr("word", F.length("word") - F.col("k") + 1, F.col("k")).alias("suffix"))
    return tails.join(suffix_table(words, p), "suffix").select("word", T.substr("word", 1, F.length("word") - F.col("k")).alias("root"), "suffix", "rank", "reported")


def _stems(root: Column, p: ScriptProfile) -> Column:
    """array<struct<r,stem>>: the root itself, then its variants in order; barred ones are null."""
    n = F.length(root)
    fine = lambda s: F.when((F.length(s) >= 2) & ~s.isin(*p.initials), s)
    tail, add = p.verb_tail
    verb = (n >= 3) & F.endswith(root, F.lit(tail)) if tail else F.lit(False)
    forms = [root] + [fine(F.concat(root, F.lit(a))) for a in p.stem_adds]
    forms.append(F.when(verb, fine(F.concat(root, F.lit(add)))))
    forms += [F.when(~verb & (n > 3), fine(F.concat(T.substr(root, 1, n - 1), F.lit(s)))) for s in p.stem_swaps]
    return F.array(*[F.struct(F.lit(i).alias("r"), f.alias("stem")) for i, f in enumerate(forms)])


def decompose(words: DataFrame, lexicon: Lexicon, p: ScriptProfile) -> DataFrame:
    """(word, root, suffix) of the words that are known or have a known stem; known: an empty suffix."""
    lex = lexicon.words("stem")
    words = words.select("word")
    exact = words.join(lex, F.col("word") == F.col("stem")).select("word", F.col("stem").alias("root"), F.lit("").alias("suffix"))
    open_ = words.join(lex, F.col("word") == F.col("stem"), "left_anti")
    hits = suffix_matches(open_, p).select("word", "rank", "reported", F.explode(_stems(F.col("root"), p)).alias("s"))
    hits = hits.select("word", "rank", "reported", "s.r", "s.stem").filter("stem IS NOT NULL").join(lex, "stem")
    best = hits.groupBy("word").agg(F.min(F.struct("rank", "r", "stem", "reported")).alias("b"))
    return exact.unionByName(best.select("word", F.col("b.stem").alias("root"), F.col("b.reported").alias("suffix")))


def compounds(words: DataFrame, lexicon: Lexicon, p: ScriptProfile) -> DataFrame:
    """The words that are a prefix and a known word, or two known parts (the first may gain a vowel)."""
    lex = lexicon.words("part")
    n = F.length("word")
    long_ = words.select("word").filter(n >= 4)
    heads = F.filter(F.array(*[F.lit(x) for x in p.prefixes] or [F.lit("\0")]), lambda x: F.startswith("word", x) & (n > F.length(x) + 1))
    by_prefix = long_.select("word", F.explode(heads).alias("h")).select("word", F.lit("").alias("left"), T.substr("word", F.length("h") + 1, F.length("word")).alias("part"))
    cuts = long_.filter(n >= 5).select("word", F.explode(F.sequence(F.lit(2), n - 3)).alias("i"))
    by_cut = cuts.select("word", T.substr("word", 1, F.col("i")).alias("left"), T.substr("word", F.col("i") + 1, F.length("word")).alias("part"))
    by_cut = by_cut.filter(~F.col("left").isin(*p.suffixes) & ~F.col("part").isin(*p.suffixes))
    rest = stage(by_prefix.unionByName(by_cut).join(lex, "part", "left_semi"))
    ends = F.array(*[F.lit(x) for x in p.compound_adds])
    firsts = rest.filter("left <> ''").select("word", F.explode(F.transform(ends, lambda e: F.concat(F.col("left"), e))).alias("part"))
    return rest.filter("left = ''").select("word").unionByName(firsts.join(lex, "part", "left_semi").select("word")).distinct()


def has_broken(word: Column, p: ScriptProfile) -> Column:
    return reduce(lambda x, b: x | F.contains(word, F.lit(b)), [b for b, _ in p.suffix_norm], F.lit(False))


def valid(words: DataFrame, lexicon: Lexicon, p: ScriptProfile) -> DataFrame:
    """(word, valid): known; else no broken suffix inside and a sound decomposition, or a compound."""
    words = stage(words.select("word").distinct())
    parts = stage(decompose(words, lexicon, p)).select(F.col("word").alias("w"), "suffix")
    rest = stage(words.join(parts, F.col("word") == F.col("w"), "left_anti"))
    comp = stage(compounds(rest, lexicon, p)).select(F.col("word").alias("c"))
    j = words.join(parts, F.col("word") == F.col("w"), "left").join(comp, F.col("word") == F.col("c"), "left")
    weak = (F.length("word") <= p.weak_length) & F.col("suffix").isin(*p.weak_suffixes)
    broken = F.col("suffix").isin(*[b for b, _ in p.suffix_norm])
    ok = F.when(F.col("suffix") == "", True).when(has_broken(F.col("word"), p), False).when(F.col("suffix").isNotNull() & ~broken, ~weak).otherwise(F.col("c").isNotNull())
    return j.select("word", ok.alias("valid"))


def resolve(words: DataFrame, lexicon: Lexicon, p: ScriptProfile) -> DataFrame:
    """(word, form): the word if known, its root and suffix joined anew, or itself if a compound."""
    words = stage(words.select("word").distinct())
    parts = stage(decompose(words, lexicon, p).select("word", T.join_suffix(F.col("root"), F.col("suffix"), p).alias("form")))
    rest = stage(words.join(parts, "word", "left_anti"))
    return parts.unionByName(compounds(rest, lexicon, p).select("word", F.col("word").alias("form")))
