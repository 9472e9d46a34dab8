"""Toxicity by noisy-channel deobfuscation.

(1) A character trigram model is counted over every text of the corpus: partitions
send their counts of 28^3 trigrams, whose sum is a table of fixed size.  (2) Spans that
may hide a word (tokens with a letter and a digit or sign, a letter three times or more, single
letters parted by one or more separators) become lattices: a sign stands for the letters it
resembles or for itself, a repeated letter for one or more, a separator for nothing or
a word's end.  Viterbi decoding under the character model, with the ``READINGS`` best texts
in each state, gives the best readings of each whole span, exactly.  (3) Words of the text and of its readings are looked up in a
lexicon of word weights, and a Bernoulli naive Bayes model gives the score.

The lexicon is learned from labelled rows: about ``SAMPLE`` ids at most, those below a
threshold of their hash; at most ``LEXICON`` words whose share among toxic texts is
significantly above that among others, the most significant first.

Edge cases: null and empty texts hold no words and get the score of that; null labels
and labels of unknown ids are ignored, a doc_id labelled twice counts as toxic if one
label says so; without labels of both kinds every score is 0; repeated rows get equal
scores; very long texts are scanned whole, span by span, and spans of any length are read
whole; extra columns are kept, whatever their names, but for those named score or hits.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, discard, fresh, stage, table, without

SAMPLE, LEXICON, FOLDS, MIN_DOCS, MIN_Z, MIN_LIFT = 20_000, 512, 5, 5, 5.0, 8.0
READINGS, CACHE = 4, 50_000
EDGE, ALIEN, N_SYM = 26, 27, 28  # symbols after a-z: word edge, any other letter

# Letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h",
}
#: Channel costs in nats: sign read as a letter, sign read as itself, letter of a run dropped, separator dropped, separator kept.
SIGN, LITERAL, DROP, JOIN, PART = 1.0, 6.0, 0.7, 0.4, 1.5

_S = re.escape("".join(LOOKS))
WORDS = re.compile(r"[^\W\d_]+")
#: Tokens that hold a letter and a sign are looked at.
_SIGNED, _LETTER = re.compile(rf"[{_S}]"), re.compile(r"[^\W\d_]")
#: Marks around a token that stand for no letter, and signs that may be such marks as well.
_OUTER, _MAYBE = ".,;:?\"'`)[]{}<>«»“”„‘’…", "!|+(*#"
_RUN = re.compile(r"([^\W\d_])\1\1")
SEPARATORS = " \t._*-/\\|,~"
_GAP = re.compile(rf"([{re.escape(SEPARATORS)}])[{re.escape(SEPARATORS)}]+")
_SPACED = re.compile(rf"(?<![^\W_])[^\W_](?:[{re.escape(SEPARATORS)}]+[^\W_]){{2,}}(?![^\W_])")
_TOKEN_END = re.compile(r"\s|$")


def symbol(c: str) -> int:
    o = ord(c) - 97
    return o if 0 <= o < 26 else ALIEN if c.isalpha() else EDGE


_BYTE = np.full(256, EDGE, np.int64)
_BYTE[97:123] = _BYTE[65:91] = np.arange(26)
_BYTE[0x80:] = -1  # continuation bytes go; lead bytes stand for the letter
_BYTE[0xC0:] = ALIEN


def trigram_counts(text: str) -> np.ndarray:
    """Counts of symbol trigrams of a text, with edges around it."""
    s = _BYTE[np.frombuffer(f"  {text} ".encode(), np.uint8)]
    s = s[s >= 0]
    return np.bincount(s[:-2] * (N_SYM * N_SYM) + s[1:-1] * N_SYM + s[2:], minlength=N_SYM**3)


def corpus_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Trigram counts of all texts: one partial table per task, summed by Spark."""

    def run(batches):
        total = np.zeros(N_SYM**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for t in batch.slice(at, 256).column(0).to_pylist():
                    if t:
                        total += trigram_counts(t)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["k", "n"])

    out = np.zeros(N_SYM**3)
    for k, n in arrow_map(docs.select(text_col), run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n  # at most 28^3 rows
    return out


def language_model(counts: np.ndarray) -> list[float]:
    """log P(c | a, b), trigrams smoothed by bigrams and those by letters."""
    c3 = counts.reshape(N_SYM, N_SYM, N_SYM)
    c2 = c3.sum(0)
    c1 = (c2.sum(0) + 1) / (c2.sum() + N_SYM)
    p2 = (c2 + 5 * c1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)
    return np.log(p3).ravel().tolist()


_PRIME, _BASE = (1 << 61) - 1, 1_000_003
#: Readings are kept as chains of letters; where all are in one state, chains this long become strings.
CHAIN = 4096


def _moves(c: str, last: str, spaced: bool):
    """(cost, letter emitted or "", last source letter after it) of every way to read a character."""
    if c.isalpha():
        yield 0.0, c, c
        if c == last:
            yield DROP, "", c
    elif spaced and c in SEPARATORS:
        yield JOIN, "", last
        yield PART, " ", ""
    else:
        for x in LOOKS.get(c, ""):
            yield SIGN, x, x
            if x == last:
                yield SIGN + DROP, "", x
        yield LITERAL, " ", ""


def _text(node) -> str:
    out = []
    while node is not None:
        node, part = node
        out.append(part)
    return "".join(reversed(out))


def _best(hyps: list[tuple], k: int) -> list[tuple]:
    """The k cheapest of different texts."""
    if len(hyps) == 1:
        return hyps
    hyps.sort(key=lambda h: h[:2])
    seen, out = set(), []
    for h in hyps:
        if h[1] not in seen:
            seen.add(h[1])
            out.append(h)
            if len(out) == k:
                break
    return out


def ranked(span: str, lm: list[float], spaced: bool = False, k: int = READINGS) -> list[tuple[float, str]]:
    """The k best readings of a span with their costs, by Viterbi.

    A state is the last two symbols and the last source letter, all that later costs
    depend on; each holds its k best texts, so that the k best of all are exact.
    """
    n2 = N_SYM * N_SYM
    # (cost, fingerprint of the text, chain of its parts) by state
    states: dict[tuple, list[tuple]] = {(EDGE, EDGE, ""): [(0.0, 0, None)]}
    steps = 0
    for c in span:
        new: dict[tuple, list[tuple]] = {}
        for (a, b, last), hyps in states.items():
            for add, emit, then in _moves(c, last, spaced):
                if emit:
                    s, o = symbol(emit), ord(emit)
                    add -= lm[a * n2 + b * N_SYM + s]
                    new.setdefault((b, s, then), []).extend([(cost + add, (h * _BASE + o) % _PRIME, (node, emit)) for cost, h, node in hyps])
                else:
                    new.setdefault((a, b, then), []).extend([(cost + add, h, node) for cost, h, node in hyps])
        states = {key: _best(hyps, k) for key, hyps in new.items()}
        steps += 1
        if steps >= CHAIN and len(states) == 1:
            ((key, hyps),) = states.items()
            states, steps = {key: [(cost, h, (None, _text(node))) for cost, h, node in hyps]}, 0
    done = [(cost - lm[a * n2 + b * N_SYM + EDGE], h, node) for (a, b, _), hyps in states.items() for cost, h, node in hyps]
    return [(cost, _text(node)) for cost, _, node in _best(done, k)]


def decode(span: str, lm: list[float], spaced: bool = False) -> list[str]:
    """The best readings of a span, each a string of words."""
    return [text for _, text in ranked(span, lm, spaced)]


class Restorer:
    """Words of a text, with the words of its spans' readings."""

    def __init__(self, lm: list[float]):
        self.lm, self.known = lm, {}

    def _read(self, span: str, spaced: bool) -> tuple[str, ...]:
        got = self.known.get((span, spaced))
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            got = tuple({w for r in decode(span, self.lm, spaced) for w in WORDS.findall(r)})
            if len(span) <= 64:  # longer ones hardly ever come again
                self.known[span, spaced] = got
        return got

    def words(self, text: str) -> set[str]:
        low = text.lower()
        out = set(WORDS.findall(low))
        for find in (_SIGNED, _RUN):
            end = 0
            for m in find.finditer(low):
                if m.start() < end:
                    continue
                a = m.start()
                while a > end and not low[a - 1].isspace():
                    a -= 1
                end = _TOKEN_END.search(low, m.end()).start()
                token = low[a:end].strip(_OUTER)
                if not _LETTER.search(token):
                    continue
                for span in {token, token.strip(_OUTER + _MAYBE)}:
                    out.update(self._read(span, False))
        for m in _SPACED.finditer(low):
            out.update(self._read(_GAP.sub(r"\1", m[0]), True))
        return out


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % FOLDS == 0


def learn(docs: DataFrame, labels: DataFrame, lm: list[float], *, id_col="doc_id", text_col="text", only_train=True, sample=SAMPLE):
    """(log prior odds, {word: (weight if there, weight if not)}) from a bounded sample of labels."""
    lab = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_y")).dropna()
    lab = lab.filter(~held_out(F.col("_id"))) if only_train else lab
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"))
    if (n := lab.count()) > sample:  # by hash, so that no task ranks all ids
        lab = lab.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(lab), "_id")

    def run(batches):
        r = Restorer(lm)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                word, y = [], []
                for t, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    # "" counts the texts themselves
                    got = [w for w in r.words(t or "") if len(w) > 2] + [""]
                    word += got
                    y += [v] * len(got)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(y, pa.int32())], names=["w", "y"])

    seen = arrow_map(rows.select("_t", "_y"), run, "w string, y int")
    by_word = stage(seen.groupBy("w").agg(F.sum(F.col("y").cast("long")).alias("t"), F.sum((1 - F.col("y")).cast("long")).alias("c")), "words")
    texts = by_word.filter("w = ''").first()
    if texts is None or not texts.t or not texts.c:
        discard(by_word)
        return None
    nt, nc = texts.t, texts.c
    t, c = F.col("t"), F.col("c")
    p = (t + c) / (nt + nc)
    z = (t / nt - c / nc) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / nt + 1 / nc))
    qt, qc = (t + 0.1) / (nt + 0.2), (c + 0.1) / (nc + 0.2)
    # Every word is tested before any is left out; those that pass are few and all come to the driver.
    telling = by_word.filter((F.col("w") != "") & (t >= MIN_DOCS) & (z >= MIN_Z) & (qt >= MIN_LIFT * qc))
    got = telling.select("w", z.alias("z"), qt.alias("qt"), qc.alias("qc")).collect()
    discard(by_word)
    top = sorted(got, key=lambda r: (-r.z, r.w))[:LEXICON]
    return math.log(nt / nc), {r.w: (math.log(r.qt / r.qc), math.log((1 - r.qt) / (1 - r.qc))) for r in top}


def score(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", only_train=True, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns in ``carry``, all by default) with score and hits, one row for each of its rows.

    hits: the lexicon's words found, also as restored.  Columns named score or hits are replaced.
    """
    lm = language_model(corpus_counts(docs, text_col))
    model = learn(docs, labels, lm, id_col=id_col, text_col=text_col, only_train=only_train)
    prior, lexicon = model or (-math.inf, {})
    rest = prior + sum(b for _, b in lexicon.values()) if model else 0.0
    keep = without(docs.columns if carry is None else carry, ["score", "hits"])

    def run(batches):
        r, names = Restorer(lm), lexicon.keys()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hits = [sorted(r.words(t) & names) if t else [] for t in part.column(len(keep)).to_pylist()]
                logit = [rest + sum(lexicon[w][0] - lexicon[w][1] for w in h) for h in hits]
                p = [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) if model else 0.0 for x in logit]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], pa.array(p, pa.float64()), pa.array(hits, pa.list_(pa.string()))], names=[*keep, "score", "hits"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType()))])
    return arrow_map(docs.select(*keep, F.col(text_col).alias(fresh(keep, "text"))), run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **params) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold.

    Columns named score or hits, which ``score`` would replace, stay the input's: they are
    carried under other names meanwhile.
    """
    aside = {c: fresh(docs.columns, f"{c}_") for c in docs.columns if c.lower() in ("score", "hits")}
    out = score(docs.withColumnsRenamed(aside), labels, **params).filter(F.col("score") < threshold)
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def op10_toxicity(spark, sf_dir) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
