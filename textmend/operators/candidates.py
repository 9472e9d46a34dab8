"""Correction candidates of unknown words: generators, resolution, dedup and rank.

Each generator is a list of raw strings with a cost and its place in the order; all
of them are resolved together, once per distinct string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..script import ScriptProfile
from ..staging import stage
from . import morph
from .lexicon import Lexicon, literal_table

RAW = ["word", "gen", "ord", "cost", "type", "raw", "second", "fixed"]


def _each(n: Column) -> Column:
    """1..n, empty for n < 1."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _splice(w: Column, i: Column, cut, put: Column) -> Column:
    """``w`` with ``cut`` characters from place i (from 1) replaced by ``put``."""
    return F.concat(T.substr(w, 1, i - 1), put, T.substr(w, i + cut, F.length(w)))


def confusion_table(df: DataFrame, p: ScriptProfile) -> DataFrame:
    return F.broadcast(literal_table(df.sparkSession, p.directed, ["src", "dst", "cost", "seq"]))


def _substrings(df: DataFrame, col: str, sizes: list[int]) -> DataFrame:
    ks = F.array(*[F.lit(k) for k in sizes])
    at = F.flatten(F.transform(ks, lambda k: F.transform(_each(F.length(col) - k + 1), lambda i: F.struct(k.alias("k"), i.alias("i")))))
    return df.select("*", F.explode(at).alias("a")).select(*df.columns, "a.k", "a.i", T.substr(col, F.col("a.i"), F.col("a.k")).alias("src"))


def _row(gen: int, ord_, cost, kind: str, raw: Column, second: Column | None = None, fixed: Column | None = None):
    none = F.lit(None).cast("string")
    return ["word", F.lit(gen).alias("gen"), ord_.cast("int").alias("ord"), (cost if isinstance(cost, Column) else F.lit(cost)).alias("cost"), F.lit(kind).alias("type"), raw.alias("raw"), (none if second is None else second).alias("second"), (none if fixed is None else fixed).alias("fixed")]


def prepared(words: DataFrame, p: ScriptProfile) -> DataFrame:
    """(word, w): distinct words and their normalised forms, on which the generators work."""
    return words.select("word").distinct().select("word", T.normalise(F.col("word"), p).alias("w"))


def gen_normalised(words: DataFrame, p: ScriptProfile) -> DataFrame:
    return words.filter("w <> word").select(*_row(2, F.lit(0), 0.2, "ocr_repair", F.col("w")))


def gen_confusion(words: DataFrame, p: ScriptProfile, sizes=(5, 4, 3, 2), gen: int = 3) -> DataFrame:
    """Replacements of substrings by what they are confused with; longest first, left to right."""
    hit = _substrings(words.select("word", "w"), "w", list(sizes)).join(confusion_table(words, p), "src")
    return hit.select(*_row(gen, (9 - F.col("k")) * 1_000_000 + F.col("i") * 1000 + F.col("seq"), F.col("cost"), "ocr_repair", _splice(F.col("w"), F.col("i"), F.col("k"), F.col("dst"))))


def gen_suffix_norm(words: DataFrame, p: ScriptProfile) -> DataFrame:
    """Broken suffixes mended everywhere; at the end, if that resolves to nothing, by way of a vowel stem."""
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b"), F.lit(g).alias("g")) for i, (b, g) in enumerate(p.suffix_norm)])
    w = words.select("word", "w")
    hit = w.select("word", "w", F.explode(F.filter(table, lambda x: F.contains("w", x["b"]))).alias("x"))
    stem = F.concat(T.substr("w", 1, F.length("w") - F.length("x.b")), F.lit(p.link_vowel))
    end = F.endswith("w", F.col("x.b")) & (F.length("w") > F.length("x.b"))
    return hit.select(*_row(4, F.col("x.i"), 0.2, "word_correction", F.replace("w", F.col("x.b"), F.col("x.g")), F.when(end, stem), F.when(end, T.join_suffix(stem, F.col("x.g"), p))))


def gen_vowel_flip(words: DataFrame, p: ScriptProfile) -> DataFrame:
    src, dst = "".join(a + b for a, b in p.vowel_flips), "".join(b + a for a, b in p.vowel_flips)
    w = words.select("word", "w")
    at = w.select("word", "w", F.explode(_each(F.length("w"))).alias("i")).withColumn("c", T.substr("w", F.col("i"), 1)).filter(F.call_function("instr", F.lit(src), F.col("c")) > 0)
    return at.select(*_row(6, F.col("i"), 0.25, "word_correction", _splice(F.col("w"), F.col("i"), 1, F.translate("c", src, dst))))


def gen_stem_confusion(words: DataFrame, p: ScriptProfile) -> DataFrame:
    """Confusions inside the stem before the longest suffix; the suffix is joined on again."""
    w = words.select("word", "w")
    m = morph.suffix_matches(w.select(F.col("w").alias("word")).distinct(), p).filter(F.length("root") >= 2)
    top = m.groupBy("word").agg(F.min(F.struct("rank", "root", "suffix")).alias("b")).select(F.col("word").alias("w"), F.col("b.root").alias("root"), F.col("b.suffix").alias("suffix"))
    hit = _substrings(w.join(top, "w"), "root", [3, 2, 1]).join(confusion_table(words, p), "src")
    stem = _splice(F.col("root"), F.col("i"), F.col("k"), F.col("dst"))
    linked = F.concat(stem, F.lit(p.link_vowel))
    return hit.select(*_row(7, (9 - F.col("k")) * 1_000_000 + F.col("i") * 1000 + F.col("seq"), F.col("cost"), "ocr_repair", T.join_suffix(stem, F.col("suffix"), p), T.join_suffix(linked, F.col("suffix"), p)))


def gen_virama(words: DataFrame, p: ScriptProfile) -> DataFrame:
    """The joining sign between neighbouring consonants, alone and with each ending."""
    w = words.select("word", "w")
    c = lambda i: F.call_function("instr", F.lit(p.consonants), T.substr("w", i, 1)) > 0
    at = w.select("word", "w", F.explode(F.filter(_each(F.length("w") - 1), lambda i: c(i) & c(i + 1))).alias("i"))
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in enumerate(("", *p.virama_exts))])
    x = at.select("word", "w", "i", F.explode(ends).alias("x"))
    raw = F.concat(T.substr("w", 1, F.col("i")), F.lit(p.virama), T.substr("w", F.col("i") + 1, F.length("w")), F.col("x.e"))
    return x.select(*_row(8, F.col("i") * 100 + F.col("x.k"), F.when(F.col("x.k") == 0, 0.3).otherwise(0.4), "ocr_repair", raw))


def gen_nasal(words: DataFrame, p: ScriptProfile) -> DataFrame:
    w = F.col("w")
    return words.filter(F.contains(w, F.lit(p.nasal))).select(*_row(9, F.lit(0), 0.35, "ocr_repair", F.replace(w, F.lit(p.nasal), F.lit(""))))


def gen_delete(words: DataFrame, p: ScriptProfile) -> DataFrame:
    w = words.select("word", "w").filter(F.length("w") >= 3)
    return w.select("word", "w", F.explode(_each(F.length("w"))).alias("i")).select(*_row(10, F.col("i"), 0.4, "word_correction", _splice(F.col("w"), F.col("i"), 1, F.lit(""))))


def gen_append(words: DataFrame, p: ScriptProfile) -> DataFrame:
    """Each consonant at the end, in code-point order."""
    w = words.select("word", "w").filter(F.length("w") >= 3)
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(sorted(p.consonants))])
    return w.select("word", "w", F.explode(ends).alias("x")).select(*_row(11, F.col("x.k"), 0.35, "word_correction", F.concat("w", "x.c")))


def raw(words: DataFrame, p: ScriptProfile) -> DataFrame:
    """All raw candidates of distinct words, with their place in the order."""
    words = stage(prepared(words, p))
    gens = [gen_normalised(words, p), gen_confusion(words, p), gen_suffix_norm(words, p), gen_confusion(words, p, (1,), 5), gen_vowel_flip(words, p), gen_stem_confusion(words, p), gen_virama(words, p), gen_nasal(words, p), gen_delete(words, p), gen_append(words, p)]
    out = gens[0]
    for g in gens[1:]:
        out = out.unionByName(g)
    return out.select(*RAW)


def resolved(cands: DataFrame, lexicon: Lexicon, p: ScriptProfile) -> DataFrame:
    """(word, gen, ord, cost, type, cand): candidates that lead to a valid form.

    A second choice counts where the first leads nowhere; a ``fixed`` form is taken as it
    is if the second choice decomposes.
    """
    firsts = cands.select(F.col("raw").alias("word"))
    seconds = cands.filter("second IS NOT NULL AND fixed IS NULL").select(F.col("second").alias("word"))
    forms = stage(morph.resolve(firsts.unionByName(seconds), lexicon, p))
    parts = stage(morph.decompose(stage(cands.filter("fixed IS NOT NULL").select(F.col("second").alias("word")).distinct()), lexicon, p)).select(F.col("word").alias("second"), F.lit(True).alias("sound"))
    one = forms.select(F.col("word").alias("raw"), F.col("form").alias("f1"))
    two = forms.select(F.col("word").alias("second"), F.col("form").alias("f2"))
    simple = cands.filter("second IS NULL").join(one, "raw").select("word", "gen", "ord", "cost", "type", F.col("f1").alias("cand"))
    pair = cands.filter("second IS NOT NULL").join(one, "raw", "left").join(two, "second", "left").join(parts, "second", "left")
    form = F.coalesce("f1", F.when(F.col("fixed").isNotNull(), F.when(F.col("sound"), F.col("fixed"))).otherwise(F.col("f2")))
    return simple.unionByName(pair.select("word", "gen", "ord", "cost", "type", form.alias("cand"))).filter("cand <> ''")


def best(found: DataFrame) -> DataFrame:
    """(word, cand, cost, type, gen, ord): per candidate the least cost, the first type at it, the first place."""
    place = F.struct("gen", "ord")
    g = found.groupBy("word", "cand").agg(F.min("cost").alias("cost"), F.min(place).alias("at"), F.min_by("type", F.struct("cost", "gen", "ord")).alias("type"))
    return g.select("word", "cand", "cost", "type", "at.gen", "at.ord")


def with_neighbours(cands: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Candidates with whether the lexicon has them, and their neighbours in it."""
    return cands.join(lexicon.neighbours().select(F.col("word").alias("cand"), F.col("ord").alias("lex"), "before", "after"), "cand", "left").withColumn("seen", F.col("lex").isNotNull())


def lm_score(seen: Column, before: Column, after: Column, prev: Column, nxt: Column, n_words) -> Column:
    """Log probability of a candidate by the lexicon's own counts, plus 1.5 per neighbour it is sorted next to."""
    uni = F.log(F.when(seen, 2.0).otherwise(1.0) / (2.0 * F.lit(n_words)))
    hit = lambda a, b: F.when(F.coalesce(a == b, F.lit(False)), 1.5).otherwise(0.0)
    return uni + hit(prev, before) + hit(nxt, after)


def bonus(lm: Column, prev: Column, nxt: Column) -> Column:
    return F.when(prev.isNotNull() | nxt.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(0.3), (lm + 10.0) / 20.0))).otherwise(0.0)
