"""Text correction: the flagship transform.

Normalise, tokenise, heal, then correct the words that the lexicon cannot explain.
Only distinct words and pairs of words go through joins; what they yield for a text comes
back as a small dictionary, and one ordered fold over the text (in Arrow batches) merges
pairs and picks the best candidate of each unexplained word in its context, where the left
neighbour counts as already corrected.  Tokens are never written or shuffled; every text is
joined once with what was found for it.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache, reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..script import ScriptProfile
from ..staging import free, held, scope, ship, small, stage
from . import candidates as C
from . import heal, morph
from .lexicon import Lexicon

CORRECTION = "array<struct<original:string,correction:string,edit_distance:double,type:string,start:int,end:int>>"


def tokenize(docs: DataFrame, p: ScriptProfile, *, id_col="doc_id", text_col="text", normalise: bool = True) -> DataFrame:
    """(id, pos, type, value, start, end); offsets are those of the normalised text."""
    t = T.normalise(F.col(text_col), p) if normalise else F.col(text_col)
    return docs.select(id_col, F.explode(T.tokens(t, p)).alias("t")).select(id_col, "t.pos", "t.type", "t.value", "t.start", "t.end")


#: Words whose raw candidates are worked out at one time, and the most portions of a table.
PORTION, PORTIONS = 50_000, 24

#: Bytes of staged texts that are folded at one time where corrections alone are asked for, and the most portions.
TEXTS, TEXT_PORTIONS = 16 << 20, 8

#: The most numbers of 64 bits in the sieve of a dictionary's keys.
SIEVE = 1 << 20


def candidates_of(words: DataFrame, lex: Lexicon, p: ScriptProfile) -> DataFrame:
    """(word, cand, cost, type, gen, ord, lex, before, after, seen) for the words that are not valid.

    Raw candidates are many times the words, and few lead to a valid form: they are worked out
    for a portion of the words after the other, and their tables go with the portion.
    """
    spark = words.sparkSession
    with scope() as s:
        bad = s.keep(stage(morph.valid(words.filter(F.length("word") > 1), lex, p).filter("NOT valid").select("word")))
    n = max(1, min(PORTIONS, -(-bad.count() // PORTION)))
    out = None
    for i in range(n):
        free(spark)
        with scope() as s:
            some = bad.filter(F.pmod(F.xxhash64("word"), F.lit(n)) == i) if n > 1 else bad
            best = s.keep(stage(C.best(C.resolved(stage(C.raw(some, p)), lex, p))))
        out = best if out is None else out.unionByName(best)
    return C.with_neighbours(out, lex)


def choose(cands, prev, nxt, n_words):
    """The best candidate of an array in a context: least score, first place among equals."""
    def key(c):
        lm = C.lm_score(c["seen"], c["before"], c["after"], prev, nxt, n_words)
        return F.struct(F.round(c["cost"] - C.bonus(lm, prev, nxt), 3).alias("score"), c["gen"].alias("gen"), c["ord"].alias("ord"), c["cand"].alias("cand"), c["type"].alias("type"))

    return F.array_min(F.transform(cands, key))


def per_word(words: DataFrame, lex: Lexicon, p: ScriptProfile) -> DataFrame:
    """(word, cands) of distinct words that are not valid and have candidates; cands with their distances."""
    ship(words.sparkSession)
    c = candidates_of(words, lex, p).withColumn("dist", T.distances(F.col("word"), F.col("cand"), p))
    return c.groupBy("word").agg(F.collect_list(F.struct("cand", "cost", "type", "gen", "ord", "before", "after", "seen", "dist")).alias("cands"))


def suggest(words: DataFrame, lex: Lexicon, p: ScriptProfile) -> DataFrame:
    """(word, correction, edit_distance, type) of single words without context."""
    none = F.lit(None).cast("string")
    with scope() as s:
        got = per_word(words.select("word").distinct(), lex, p)
        top = got.select("word", choose(F.col("cands"), none, none, lex.size).alias("b")).filter(F.col("b.cand") != F.col("word"))
        top = s.keep(stage(top))
    out = words.join(top, "word", "left")
    dist = F.when(F.col("b").isNotNull(), T.weighted_distance(F.col("word"), F.col("b.cand"), p)).otherwise(0.0)
    return out.select("word", F.coalesce("b.cand", "word").alias("correction"), dist.alias("edit_distance"), F.coalesce("b.type", F.lit("none")).alias("type"))


def _scores(c: Column, n_words: int) -> Column:
    """Scores of a candidate by its context: none at all, then with no, one and two of its neighbours in the lexicon."""
    x, y = F.lit("x"), F.lit("y")
    near = [C.bonus(C.lm_score(c["seen"], x, x, prev, nxt, n_words), prev, nxt) for prev, nxt in ((y, y), (x, y), (x, x))]
    return F.array(*[F.round(c["cost"] - b, 3) for b in (F.lit(0.0), *near)])


def contenders(cands: Column) -> Column:
    """Those of a word's packed candidates that some context makes the best: the others never get below the best without neighbours."""
    key = lambda c, s: F.struct(s.alias("s"), c["g"].alias("g"), c["o"].alias("o"), c["c"].alias("c"), c["t"].alias("t"))
    first = lambda k: F.array_min(F.transform(cands, lambda c: key(c, F.get(c["s"], F.lit(k)))))
    least = lambda c: F.get(c["s"], F.lit(1) + c["b"].isNotNull().cast("int") + c["a"].isNotNull().cast("int"))
    fits = lambda alone, near: F.filter(cands, lambda c: (key(c, F.get(c["s"], F.lit(0))) <= alone) | (key(c, least(c)) <= near))
    return T.let(first(0), lambda alone: T.let(first(1), lambda near: fits(alone, near)))


def packed(cands: Column, n_words: int) -> Column:
    """A word's candidates as JSON, with all that the fold asks of them; without those that cannot win."""
    one = lambda c: F.struct(c["cand"].alias("c"), F.round(c["dist"], 2).alias("d"), c["type"].alias("t"), c["gen"].alias("g"), c["ord"].alias("o"), c["before"].alias("b"), c["after"].alias("a"), _scores(c, n_words).alias("s"))
    return F.to_json(T.let(F.transform(cands, one), contenders))


@lru_cache(100_000)
def _unpacked(cands: str) -> list[tuple]:
    return [(x["c"], x["d"], x["t"], x["g"], x["o"], x.get("b"), x.get("a"), x["s"]) for x in json.loads(cands)]


def fold(text: str, found: list[dict], words: re.Pattern) -> tuple[str, int, list[dict]]:
    """(corrected, words, corrections) of a text, in one pass from left to right.

    ``found``: what the text has of the dictionary (key, cands): a word with its candidates,
    or two words with a blank between that are merged, with the candidates of both as one.
    """
    parts = words.split(text)  # other, word, other, word, ..., other
    ends = list(accumulate(map(len, parts)))
    places, begins = list(range(1, len(parts), 2)), {}
    pairs = {x["key"]: x["cands"] for x in found if " " in x["key"]}
    known = {x["key"]: x["cands"] for x in found if " " not in x["key"]}
    out = []
    if pairs:
        firsts, kept, skip = {k.partition(" ")[0] for k in pairs}, [], False
        for j in places:
            if skip:
                skip = False
                continue
            kept.append(j)
            if parts[j] in firsts and j + 2 < len(parts) and parts[j + 1] == " " and (pair := f"{parts[j]} {parts[j + 2]}") in pairs:
                begins[j], skip = ends[j - 1], True
                joined = parts[j] + parts[j + 2]
                out.append({"original": pair, "correction": joined, "edit_distance": 0.5, "type": "ocr_repair", "start": ends[j - 1], "end": ends[j + 2]})
                parts[j], parts[j + 1], parts[j + 2] = joined, "", ""
                if pairs[pair] is not None:
                    known[joined] = pairs[pair]
        places = kept
    if known:
        old = [parts[j] for j in places]
        for k, j in enumerate(places):
            if (cands := known.get(old[k])) is None:
                continue
            prev = parts[places[k - 1]] if k else None  # as it was corrected
            nxt = old[k + 1] if k + 1 < len(old) else None
            alone = prev is None and nxt is None

            def key(x):
                hits = 0 if alone else 1 + (prev is not None and prev == x[5]) + (nxt is not None and nxt == x[6])
                return x[7][hits], x[3], x[4], x[0], x[2]

            best = min(_unpacked(cands), key=key)
            if best[0] != old[k]:
                end = ends[j + 2] if j in begins else ends[j]
                out.append({"original": old[k], "correction": best[0], "edit_distance": best[1], "type": best[2], "start": ends[j - 1], "end": end})
                parts[j] = best[0]
    return "".join(parts), len(places), out


FOLDED = pa.struct([("corrected", pa.string()), ("words", pa.int32()), ("corrections", pa.list_(pa.struct([("original", pa.string()), ("correction", pa.string()), ("edit_distance", pa.float64()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def folded(text: Column, found: Column, p: ScriptProfile) -> Column:
    """struct<corrected,words,corrections> of texts by ``fold``; a null text stays null, without words."""
    pattern = f"([{p.word}]+)"

    def run(texts: pa.Array, founds: pa.Array) -> pa.Array:
        words = re.compile(pattern)
        rows = ((None, 0, []) if t is None else fold(t, f or [], words) for t, f in zip((x.as_py() for x in texts), (x.as_py() for x in founds)))
        return pa.array([dict(zip(("corrected", "words", "corrections"), r)) for r in rows], FOLDED)

    run.__annotations__ = {"texts": pa.Array, "founds": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"struct<corrected:string,words:int,corrections:{CORRECTION}>")(text, found)


class Corrected:
    """Corrected texts: the input's columns beside corrected, corrections and counts.

    The texts and what was found for them are staged; the fold runs where the result is used, so
    whoever reads a result more than once should write it.  Corrections alone are folded a portion of
    the texts after the other and staged, so that few texts are dealt out at a time.
    """

    def __init__(self, base: DataFrame, found: DataFrame, columns: list[str], id_col: str, text_col: str, p: ScriptProfile):
        self.base, self.found, self.columns, self.id_col, self.text_col, self.p = base, found, columns, id_col, text_col, p

    def _done(self, base: DataFrame, found: DataFrame, how: str) -> DataFrame:
        return base.join(found, "__row", how).withColumn("__done", folded(T.normalise(F.col(self.text_col), self.p), F.col("__found"), self.p))

    @property
    def table(self) -> DataFrame:
        return self._done(self.base, self.found, "left")

    def texts(self, keep: list[str] | None = None) -> DataFrame:
        """One row per text: original, corrected, has_errors, total_words, total_corrections, accuracy_rate, corrections.

        ``keep``: columns of the input to have instead of the id and the original.
        """
        first = [self.id_col, F.col(self.text_col).alias("original")] if keep is None else keep
        n, total = F.col("__done.words"), F.size("__done.corrections")
        return self.table.select(
            *first, F.col("__done.corrected").alias("corrected"), (total > 0).alias("has_errors"), n.alias("total_words"), total.alias("total_corrections"),
            F.round((1.0 - total / F.greatest(n, F.lit(1))) * 100, 1).alias("accuracy_rate"), F.col("__done.corrections").alias("corrections"),
        )

    @cached_property
    def numbered(self) -> DataFrame:
        """(id, row, original, correction, edit_distance, type, start, end): a row per correction, numbered in each text from 1."""
        n = max(1, min(TEXT_PORTIONS, -(-held(self.base) // TEXTS)))
        parts = [self._portion(i, n) for i in range(n)]
        return reduce(DataFrame.unionByName, parts)

    def _portion(self, i: int, n: int) -> DataFrame:
        free(self.base.sparkSession)
        some = lambda df: df.filter(F.pmod(F.xxhash64("__row"), F.lit(n)) == i) if n > 1 else df
        # A text for which nothing was found has no corrections.
        done = self._done(some(self.base.select("__row", self.id_col, self.text_col)), some(self.found), "inner")
        each = done.select(self.id_col, F.posexplode("__done.corrections").alias("__i", "c"))
        return stage(each.select(self.id_col, (F.col("__i") + 1).alias("row"), "c.*"))

    @property
    def corrections(self) -> DataFrame:
        """(id, original, correction, edit_distance, type, start, end): a row per correction."""
        return self.numbered.drop("row")


def sieved(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key may be one of ``keys``: all that are, and few others.

    A bit for each key's hash, in a bounded table that is broadcast however many keys there are:
    what cannot be found is not dealt out.
    """
    slots = F.lit(max(1, min(SIEVE, keys.count() // 4)))
    at = lambda: [F.pmod(F.xxhash64("key"), slots).alias("__slot"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(64)).cast("int").alias("__bit")]
    bits = keys.select(*at()).groupBy("__slot").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    tried = hits.select(*hits.columns, *at()).join(F.broadcast(stage(bits)), "__slot")
    return tried.filter(F.expr("getbit(__bits, __bit) = 1")).select(*hits.columns)


def correct(docs: DataFrame, lex: Lexicon, p: ScriptProfile, *, id_col="doc_id", text_col="text") -> Corrected:
    """Rows are texts of their own: equal or null ids are not mixed up; a null text stays null, without words."""
    ship(docs.sparkSession)
    with scope() as s:
        base = s.keep(stage(docs.withColumn("__row", F.monotonically_increasing_id())))
        text = T.normalise(F.col(text_col), p)
        pairs = base.select(F.explode(F.array_distinct(heal.starts(text, p))).alias("key")).filter(F.contains("key", F.lit(" ")))
        good = stage(heal.judged(pairs.select(F.substring_index("key", " ", 1).alias("w1"), F.substring_index("key", " ", -1).alias("w2")), lex, p))
        good = good.select(F.concat_ws(" ", "w1", "w2").alias("key"), F.concat("w1", "w2").alias("word"))
        del pairs
        free(docs.sparkSession)
        words = base.select(F.explode(F.array_distinct(T.words(text, p))).alias("word")).unionByName(good.select("word")).distinct()
        known = stage(per_word(words, lex, p).select("word", packed(F.col("cands"), lex.size).alias("cands")))
        # The dictionary of each text: its words with candidates, and its pairs to merge.
        keys = stage(known.select(F.col("word").alias("key"), "cands").unionByName(good.join(known, "word", "left").select("key", "cands")))
        free(docs.sparkSession)
        each = F.array_distinct(F.concat(T.words(text, p), F.filter(heal.starts(text, p), lambda x: F.contains(x, F.lit(" ")))))
        hits = sieved(base.select("__row", F.explode(each).alias("key")), keys).join(small(keys), "key")
        found = s.keep(stage(hits.groupBy("__row").agg(F.collect_list(F.struct("key", "cands")).alias("__found"))))
    free(docs.sparkSession)
    return Corrected(base, found, docs.columns, id_col, text_col, p)


def summary(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("original").alias("originals"), F.round(F.avg("edit_distance"), 4).alias("mean_distance"))


def spans(numbered: DataFrame, *, id_col="doc_id") -> DataFrame:
    """(id, row, start, end, original, correction, class, label) of numbered corrections."""
    return numbered.select(id_col, "row", "start", "end", "original", "correction", T.diff_class(F.col("type")).alias("class"), T.type_label(F.col("type")).alias("label"))


def diff_spans(texts: DataFrame, *, id_col="doc_id") -> DataFrame:
    """(id, row, start, end, original, correction, class, label): a row per correction, numbered as in a table."""
    e = texts.select(id_col, F.posexplode("corrections").alias("__i", "c"))
    return spans(e.select(id_col, (F.col("__i") + 1).alias("row"), "c.*"), id_col=id_col)


def highlight(texts: DataFrame, *, id_col="doc_id") -> DataFrame:
    """(id, html): the corrected text with every occurrence of a corrected form marked, longest form first.

    The marks follow the text, not offsets; the first correction of a form gives its class.
    """
    marked = F.regexp_replace
    forms = F.array_distinct(F.transform("corrections", lambda c: T.escape_html(c["correction"])))
    quoted = F.transform(forms, lambda s: marked(s, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    alt = F.array_join(F.transform(F.array_sort(F.transform(quoted, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"]), "|")
    safe = T.escape_html(F.col("corrected"))
    out = texts.select(id_col, "corrections", safe.alias("safe"), alt.alias("alt"))
    some = F.size("corrections") > 0
    hits = F.when(some, F.regexp_extract_all("safe", F.col("alt"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(some, F.split("safe", F.col("alt"), -1)).otherwise(F.array(F.col("safe")))
    kind = lambda v: F.element_at(F.filter("corrections", lambda c: T.escape_html(c["correction"]) == v), 1)["type"]
    mark = lambda v: F.concat(F.lit('<mark class="'), T.diff_class(kind(v)), F.lit('">'), v, F.lit("</mark>"))
    pieces = F.zip_with(gaps, F.transform(hits, mark), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return out.select(id_col, F.array_join(pieces, "").alias("html"))
