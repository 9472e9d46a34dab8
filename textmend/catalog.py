"""The queries of the text-repair operators on the driver's tables, and SQL that gives the same rows.

The tables hold Latin text, so most queries use the ``LATIN`` profile with a lexicon of
words from the documents themselves.  Rules that belong to Kannada run over the same
texts bridged to its letters, a character for a character.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import candidates as C
from .operators import correct, heal, layout, lexicon, morph
from .plans.document import Engine
from .script import BREAKS, KANNADA, LATIN, SPACE
from .staging import ship

P = LATIN
MIN_DOCS = 3
_KN = "".join(chr(c) for c in [*range(0x0C95, 0x0CA9), *range(0x0CAA, 0x0CB0)])  # 26 letters
_KN_DIGITS = "".join(chr(0x0CE6 + i) for i in range(10))
_LA = "abcdefghijklmnopqrstuvwxyz0123456789"


def table(spark, sf_dir, name) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A table of one file is one task or few, whatever the cores; larger ones are split by the reader.
    return df.repartition(spark.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def words(spark, sf_dir) -> DataFrame:
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{P.word}]+"), F.lit(0)))
    return docs(spark, sf_dir).select(w.alias("word")).distinct()


def lex(spark, sf_dir) -> lexicon.Lexicon:
    return lexicon.Lexicon(lexicon.from_documents(docs(spark, sf_dir), P, min_docs=MIN_DOCS))


def tokenize_documents(spark, sf_dir):
    out = correct.tokenize(docs(spark, sf_dir), P, normalise=False)
    return out.select("doc_id", "pos", "type", "value", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def token_type_counts(spark, sf_dir):
    toks = T.tokens(F.col("text"), P)
    n = lambda k: F.size(F.filter("t", lambda x: x["type"] == k)).cast("long").alias(f"n_{k}")
    return docs(spark, sf_dir).withColumn("t", toks).select("doc_id", n("word"), n("number"), n("other"))


def reconstruct_roundtrip(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("back", T.reconstruct(T.tokens(F.col("text"), P)))
    return d.select("doc_id", F.md5("back").alias("digest"), (F.col("back") == F.col("text")).alias("same"))


def normalize_bridge(spark, sf_dir):
    bridged = F.translate(F.lower("text"), _LA, _KN + _KN_DIGITS)
    d = docs(spark, sf_dir).withColumn("b", bridged).withColumn("n", T.normalise(F.col("b"), KANNADA))
    return d.select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("long").alias("chars"), (F.col("n") != F.col("b")).alias("changed"), T.script_length(F.col("n"), KANNADA).cast("long").alias("script_chars"))


def strip_splitlines(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_lines(T.strip(F.col("text")))).alias("line_no", "line"))
    return d.withColumn("line", T.strip(F.col("line"))).filter("line <> ''")


def lexicon_from_documents(spark, sf_dir):
    return lex(spark, sf_dir).table.select("word", "ord", F.col("before").alias("word_before"), F.col("after").alias("word_after"))


AFFIXES = [("1", "", "s"), ("1", "e", "ing"), ("2", "y", "ies"), ("2", "", "ed"), ("3", "", "0")]


def _flagged(words_: DataFrame) -> DataFrame:
    n = F.length("word")
    return words_.select(F.col("word").alias("base"), F.array((n % 3 + 1).cast("string"), (n % 2 + 3).cast("string")).alias("flags"))


def affix_expand(spark, sf_dir):
    aff = lexicon.literal_table(spark, AFFIXES, ["flag", "strip", "add"])
    return lexicon.expand(_flagged(lexicon.from_documents(docs(spark, sf_dir), P, min_docs=MIN_DOCS)), aff, P)


def unigram_bigram(spark, sf_dir):
    return lexicon.bigrams(lex(spark, sf_dir).table)


def known_words(spark, sf_dir):
    return lexicon.known(words(spark, sf_dir), lex(spark, sf_dir))


def unknown_words(spark, sf_dir):
    return lexicon.unknown(words(spark, sf_dir), lex(spark, sf_dir))


def longest_suffix(spark, sf_dir):
    m = morph.suffix_matches(words(spark, sf_dir), P)
    return m.groupBy("word").agg(F.min(F.struct("rank", "suffix", "root")).alias("b")).select("word", "b.suffix", "b.root")


def decompose_words(spark, sf_dir):
    return morph.decompose(words(spark, sf_dir), lex(spark, sf_dir), P)


def sandhi_join(spark, sf_dir):
    suf = lexicon.literal_table(spark, [(s,) for s in P.suffixes], ["suffix"])
    known_ = lex(spark, sf_dir).words("root")
    # Every word with every suffix of a short fixed list: the list is the profile's, so this is a projection.
    return known_.select("root", F.explode(F.array(*[F.lit(s) for s in P.suffixes])).alias("suffix")).join(F.broadcast(suf), "suffix").select("root", "suffix", T.join_suffix(F.col("root"), F.col("suffix"), P).alias("joined"))


def compound_split(spark, sf_dir):
    return morph.compounds(words(spark, sf_dir), lex(spark, sf_dir), P)


def valid_words(spark, sf_dir):
    return morph.valid(words(spark, sf_dir), lex(spark, sf_dir), P)


def heal_pairs(spark, sf_dir):
    toks = docs(spark, sf_dir).select("doc_id", T.tokens(T.normalise(F.col("text"), P), P).alias("toks"))
    out = heal.pairs(toks, lex(spark, sf_dir), P)
    return out.select("doc_id", "pos", "w1", "w2", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def _bad(spark, sf_dir) -> DataFrame:
    return C.prepared(lexicon.unknown(words(spark, sf_dir), lex(spark, sf_dir)), P)


def _raws(gen):
    def run(spark, sf_dir):
        return gen(_bad(spark, sf_dir), P).select("word", F.col("raw").alias("cand"), "cost", "type", F.col("ord").cast("long").alias("ord"))

    return run


def _hurt(col):
    """Sound suffixes as a scanner breaks them."""
    for bad, good in P.suffix_norm:
        col = F.replace(col, F.lit(good), F.lit(bad))
    return col


def _altered(spark, sf_dir, change) -> DataFrame:
    """Words of the documents after a change, those that it changes."""
    w = words(spark, sf_dir).select("word", change.alias("w2")).filter("word <> w2").select(F.col("w2").alias("word")).distinct()
    return C.prepared(w, P)


def _raw_rows(df) -> DataFrame:
    return df.select("word", F.col("raw").alias("cand"), "cost", "type", F.col("ord").cast("long").alias("ord"))


def gen_suffix_norm(spark, sf_dir):
    return _raw_rows(C.gen_suffix_norm(_altered(spark, sf_dir, _hurt(F.col("word"))), P))


def gen_normalised(spark, sf_dir):
    return _raw_rows(C.gen_normalised(_altered(spark, sf_dir, F.replace(F.replace("word", F.lit("fi"), F.lit("ﬁ")), F.lit("fl"), F.lit("ﬂ"))), P))


def gen_nasal(spark, sf_dir):
    marked = F.when(F.length("word") > 3, F.concat(T.substr("word", 1, 2), F.lit(P.nasal), T.substr("word", 3, F.length("word")))).otherwise(F.col("word"))
    return _raw_rows(C.gen_nasal(_altered(spark, sf_dir, marked), P))


def unigrams(spark, sf_dir):
    return lexicon.unigrams(docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{P.word}]+"), F.lit(0))).alias("word")))


def resolve_words(spark, sf_dir):
    return morph.resolve(words(spark, sf_dir), lex(spark, sf_dir), P)


def suggest_words(spark, sf_dir):
    out = correct.suggest(words(spark, sf_dir), lex(spark, sf_dir), P)
    return out.select("word", "correction", F.round("edit_distance", 6).alias("edit_distance"), "type")


def candidates_raw(spark, sf_dir):
    """How many strings each generator makes of the words that are not valid, and which (as a sum of hashes would: by least and greatest)."""
    bad = morph.valid(words(spark, sf_dir).filter(F.length("word") > 1), lex(spark, sf_dir), P).filter("NOT valid").select("word")
    return C.raw(bad, P).groupBy("gen").agg(F.count("*").alias("n"), F.min("raw").alias("least"), F.max("raw").alias("greatest"), F.round(F.sum("cost"), 3).alias("cost"))


def candidate_best(spark, sf_dir):
    lx = lex(spark, sf_dir)
    return correct.candidates_of(words(spark, sf_dir), lx, P).select("word", "cand", "cost", "type", "gen", F.col("ord").cast("long").alias("ord"), "seen")


class TextPdf:
    """A stand-in for a PDF reader: form feeds part pages, NUL marks a broken file, SOH pages without a text layer."""

    def info(self, content: bytes):
        if content.startswith(b"\0"):
            raise ValueError("unreadable")
        return content.count(b"\f") + 1, {"producer": "text"}

    def blocks(self, content: bytes):
        if not content.startswith(b"\1"):
            for n, page in enumerate(content.decode().split("\f"), 1):
                if page:
                    yield dict(page_num=n, page_width=600.0, seq=0, x0=10.0, y0=0.0, x1=590.0, y1=800.0, text=page, block_type=0)

    def pages(self, content: bytes, dpi, first, last):
        yield from enumerate(content.lstrip(b"\1").split(b"\f"), 1)


class TextOcr:
    """A stand-in for text recognition: ten words of letters and digits a line."""

    def languages(self):
        return ["eng"]

    def boxes(self, image: bytes, lang, psm=3, oem=3):
        for i, w in enumerate(re.findall("[A-Za-z0-9]+", image.decode())):
            yield dict(seq=i, block_num=0, par_num=1, line_num=i // 10, left=60 * (i % 10), top=12 * (i // 10), width=50, height=10, conf=90.0, text=w, page_width=720)


def route_documents(spark, sf_dir):
    """Every document as a PDF: with a text layer, blank, short, over the page cap, unreadable, or scanned, by its id; and what came of it."""
    ship(spark)
    clean = F.translate("text", "\f\0\x01", "")
    body = F.array(clean, F.lit("\f"), T.substr(clean, 1, 30), F.repeat(F.lit("\f"), 499 + F.col("doc_id").cast("int") % 4), F.concat(F.lit("\0"), clean), F.concat(F.lit("\1"), clean))
    path = F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    files = docs(spark, sf_dir).select(path.alias("path"), F.encode(F.element_at(body, (F.col("doc_id") % 6 + 1).cast("int")), "UTF-8").alias("content"))
    got = Engine(lexicon.Lexicon(spark.sql("SELECT 'a' AS word")), P, TextOcr(), TextPdf()).intake(files)
    lines, pages = got.lines.groupBy("doc_id").agg(F.count("*").alias("n_lines")), got.pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    out = got.documents.join(lines, "doc_id", "left").join(pages, "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.regexp_extract("doc_id", "([0-9]+)", 1).cast("long").alias("doc_id"), "route", F.col("page_count").cast("long").alias("page_count"), n("total_chars"), n("script_chars"), n("n_lines"), n("n_pages"), "error")


def lm_score(spark, sf_dir):
    lx = lex(spark, sf_dir)
    t = lx.table.select("word", "before", "after")
    lm = C.lm_score(F.lit(True), F.col("before"), F.col("after"), F.col("before"), F.lit("zz"), lx.size)
    return t.select("word", F.round(lm, 6).alias("lm"), F.round(C.bonus(lm, F.col("before"), F.lit("zz")), 6).alias("bonus"))


def weighted_distance(spark, sf_dir):
    t = lex(spark, sf_dir).table.filter("after IS NOT NULL").select("word", "after")
    return t.select("word", F.col("after").alias("other"), F.round(T.weighted_distance(F.col("word"), F.col("after"), P), 6).alias("distance"))


def correct_documents(spark, sf_dir):
    out = correct.correct(docs(spark, sf_dir), lex(spark, sf_dir), P).texts()
    each = F.transform("corrections", lambda c: F.concat_ws("|", c["original"], c["correction"], c["edit_distance"].cast("string"), c["type"], c["start"].cast("string"), c["end"].cast("string")))
    return out.select("doc_id", F.md5("corrected").alias("corrected_md5"), "has_errors", F.col("total_words").cast("long").alias("total_words"), F.col("total_corrections").cast("long").alias("total_corrections"), "accuracy_rate", F.array_join(each, ";").alias("corrections"))


def correction_summary(spark, sf_dir):
    return correct.summary(correct.correct(docs(spark, sf_dir), lex(spark, sf_dir), P).corrections)


def diff_spans(spark, sf_dir):
    out = correct.spans(correct.correct(docs(spark, sf_dir), lex(spark, sf_dir), P).numbered)
    return out.select("doc_id", "row", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "original", "correction", "class", "label")


def boxes(spark, sf_dir) -> DataFrame:
    """Word boxes computed from token places, as an OCR engine might give them."""
    t = correct.tokenize(docs(spark, sf_dir), P, normalise=False)
    pos = F.col("pos")
    row = F.floor(pos / 12)
    return t.select(
        "doc_id", (F.floor(pos / 600) + 1).cast("int").alias("page_num"), pos.alias("seq"), F.floor(pos / 120).cast("int").alias("block_num"), F.lit(1).alias("par_num"), row.cast("int").alias("line_num"),
        (60 * (pos % 12)).alias("left"), (12 * row + pos % 5).cast("int").alias("top"), F.lit(50).alias("width"), F.lit(10).alias("height"), (pos * 37 % 101 - 5).alias("conf"), F.col("value").alias("text"), F.lit(720).alias("page_width"),
    )


def ocr_line_assembly(spark, sf_dir):
    return layout.ocr_lines(boxes(spark, sf_dir)).withColumn("text", F.md5("text"))


def blocks(spark, sf_dir) -> DataFrame:
    """Text blocks: paragraphs of three lines, placed by their number."""
    d = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"\.\n", -1)).alias("seq", "text"))
    s = F.col("seq")
    return d.select("doc_id", (F.floor(s / 20) + 1).cast("int").alias("page_num"), F.lit(600).alias("page_width"), "seq", (s * 53 % 400).alias("x0"), (s * 12).alias("y0"), (s * 53 % 400 + 100 + s * 31 % 300).alias("x1"), (s * 12 + 10).alias("y1"), "text", F.when(s % 11 == 10, 1).otherwise(0).alias("block_type"))


def pdf_block_lines(spark, sf_dir):
    return layout.block_lines(blocks(spark, sf_dir)).withColumn("text", F.md5("text"))


def _pages(spark, sf_dir) -> DataFrame:
    return layout.page_texts(layout.block_lines(blocks(spark, sf_dir)))


def page_stats_searchable(spark, sf_dir):
    return layout.page_stats(_pages(spark, sf_dir), P)


def page_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page_num", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


def full_text(spark, sf_dir):
    return layout.full_texts(_pages(spark, sf_dir)).select("doc_id", "pages", F.md5("text").alias("text_md5"))


def page_runs(spark, sf_dir):
    return layout.page_runs(_lines(spark, sf_dir)).select("doc_id", "line_ord", "page_num", "run")


def _lines(spark, sf_dir) -> DataFrame:
    lines = layout.block_lines(blocks(spark, sf_dir))
    w = Window.partitionBy("doc_id").orderBy("page_num", "line_ord")
    return lines.withColumn("line_ord", F.row_number().over(w))


def progress_events(spark, sf_dir):
    return layout.progress(_pages(spark, sf_dir))


def ext_filter(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("u"))
    name = F.concat(F.regexp_extract("u", "[^/]*$", 0), F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".png", "", ".Jpeg", ".txt")]), (F.col("page_id") % 5 + 1).cast("int")))
    return u.select("page_id", name.alias("name")).select("page_id", "name", T.file_extension(F.col("name")).alias("ext"), T.is_pdf(F.col("name")).alias("pdf"), T.is_image(F.col("name")).alias("image"))


def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_filename(F.concat("url", F.lit(".TXT"))).alias("name"))


def latest_session_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("event_type", key).alias("last_type"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_documents, token_type_counts, reconstruct_roundtrip, normalize_bridge, strip_splitlines, lexicon_from_documents, affix_expand, unigram_bigram, known_words, unknown_words,
        longest_suffix, decompose_words, sandhi_join, compound_split, valid_words, heal_pairs, candidate_best, lm_score, weighted_distance, correct_documents, correction_summary, diff_spans,
        ocr_line_assembly, route_documents, gen_suffix_norm, gen_normalised, gen_nasal, unigrams, resolve_words, suggest_words, candidates_raw, pdf_block_lines, page_stats_searchable, page_text, full_text, page_runs, progress_events, ext_filter, safe_filename, latest_session_state,
    )
} | {
    "gen_confusion": _raws(C.gen_confusion), "gen_single_confusion": _raws(lambda w, p: C.gen_confusion(w, p, (1,), 5)), "gen_vowel_flip": _raws(C.gen_vowel_flip), 
    "gen_stem_confusion": _raws(C.gen_stem_confusion), "gen_virama": _raws(C.gen_virama), "gen_delete": _raws(C.gen_delete), "gen_append": _raws(C.gen_append),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _decomposed(src: str, x: str) -> str:
    """CTEs that end in {x}deco: word, root and suffix of the words of ``src`` that are known or have a known stem."""
    return f"""{x}sfx AS MATERIALIZED (SELECT word, left(word, length(word) - length(suffix)) AS root, suffix, rank FROM {src} JOIN sufs ON ends_with(word, suffix) AND length(word) > length(suffix)),
{x}stems AS (SELECT word, suffix, rank, unnest(range(4)) AS r, unnest([root,
    CASE WHEN root || 'e' NOT IN ('mr', 'dr', 'st') THEN root || 'e' END,
    CASE WHEN length(root) >= 3 AND ends_with(root, 'at') THEN root || 'e' END,
    CASE WHEN NOT (length(root) >= 3 AND ends_with(root, 'at')) AND length(root) > 3 THEN left(root, length(root) - 1) || 'y' END]) AS stem FROM {x}sfx ANTI JOIN lexw USING (word)),
{x}deco AS MATERIALIZED (SELECT word, word AS root, '' AS suffix FROM {src} SEMI JOIN lexw USING (word) UNION ALL
    SELECT word, arg_min(stem, (rank, r)), arg_min(suffix, (rank, r)) FROM {x}stems SEMI JOIN (SELECT word AS stem FROM lexw) USING (stem) GROUP BY word)"""


def _compounds(src: str, x: str) -> str:
    """CTEs that end in {x}comp: the words of ``src`` that are compounds."""
    return f"""{x}cuts AS (SELECT word, left(word, i) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(2, length(word) - 2)) AS i FROM {src} WHERE length(word) >= 5)),
{x}tails AS MATERIALIZED (SELECT word, a FROM {x}cuts SEMI JOIN (SELECT word AS b FROM lexw) USING (b) WHERE a NOT IN (SELECT suffix FROM sufs) AND b NOT IN (SELECT suffix FROM sufs)),
{x}comp AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT word, substr(word, length(p) + 1) AS b FROM {src}, (VALUES {_values([(q,) for q in P.prefixes])}) AS x(p) WHERE starts_with(word, p) AND length(word) >= 4 AND length(word) > length(p) + 1) SEMI JOIN (SELECT word AS b FROM lexw) USING (b)
    UNION SELECT word FROM {x}tails SEMI JOIN (SELECT word AS a FROM lexw UNION SELECT left(word, length(word) - 1) FROM lexw WHERE ends_with(word, 's')) USING (a))"""


_TOK = T.token_pattern(P)
_STRIP = lambda c: f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
_WORDS = f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[{P.word}]+'))) AS word FROM documents"
#: Common tables: distinct words of all documents, the lexicon, its order.
_BASE = f"""
dw AS MATERIALIZED ({_WORDS}), words AS MATERIALIZED (SELECT DISTINCT word FROM dw),
lexw AS MATERIALIZED (SELECT word FROM dw WHERE regexp_matches(word, '^[{P.block}]+$') GROUP BY word HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
lex AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY word) - 1 AS ord, lag(word) OVER (ORDER BY word) AS before, lead(word) OVER (ORDER BY word) AS after FROM lexw),
sufs(suffix, rank) AS (VALUES {_values([(s, i) for i, s in enumerate(P.ranked_suffixes)])}),
unk AS MATERIALIZED (SELECT word FROM words WHERE word NOT IN (SELECT word FROM lexw)),
tok0 AS (SELECT doc_id, regexp_extract_all(text, {_q(_TOK)}) AS v FROM documents),
tok1 AS (SELECT doc_id, unnest(v) AS value, unnest(range(len(v))) AS pos FROM tok0),
tok AS MATERIALIZED (SELECT doc_id, pos::INT AS pos, CASE WHEN regexp_matches(value, '^[{P.digit}]') THEN 'number' WHEN regexp_matches(value, '^[{P.word}]') THEN 'word' ELSE 'other' END AS type, value,
    coalesce(sum(length(value)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_at FROM tok1),
blk0 AS (SELECT doc_id, string_split_regex(text, '\\.\\n') AS ps FROM documents),
blk1 AS (SELECT doc_id, unnest(ps) AS text, unnest(range(len(ps)))::INT AS seq FROM blk0),
blk AS (SELECT doc_id, seq // 20 + 1 AS page_num, seq, seq * 53 % 400 AS x0, seq * 12 AS y0, seq * 53 % 400 + 100 + seq * 31 % 300 AS x1, text FROM blk1 WHERE seq % 11 <> 10),
bl0 AS (SELECT *, string_split_regex({_STRIP("text")}, {_q(BREAKS)}) AS ls FROM blk), bl1 AS (SELECT *, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM bl0),
bl AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY seq, i) AS line_ord, {_STRIP("line")} AS text,
    CASE WHEN x1 - x0 < 0.6 * 600 AND abs(x0 + (x1 - x0) / 2.0 - 300.0) < 60 THEN 'C' WHEN x0 > 0.55 * 600 THEN 'R' ELSE 'L' END AS alignment,
    y0 AS top, x0 AS "left", x1 - x0 AS width, 10 AS height FROM bl1 WHERE {_STRIP("line")} <> ''),
pg AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY line_ord) AS text FROM bl GROUP BY ALL),
{_decomposed("words", "")},
{_compounds("words", "")},
conf(src, dst, cost, seq) AS (VALUES {_values(P.directed)})
"""


def _gen(sizes, src="unk") -> str:
    return f"""SELECT word, left(word, i - 1) || dst || substr(word, i + k) AS cand, cost::DOUBLE AS cost, 'ocr_repair' AS type, ((9 - k) * 1000000 + i * 1000 + seq)::BIGINT AS ord
    FROM (SELECT word, k, unnest(range(1, length(word) - k + 2)) AS i FROM {src}, (SELECT unnest({list(sizes)}) AS k) WHERE length(word) >= k) JOIN conf ON substr(word, i, k) = src"""


_FLIP_SRC, _FLIP_DST = "".join(a + b for a, b in P.vowel_flips), "".join(b + a for a, b in P.vowel_flips)
_JOIN = lambda root, suf: f"CASE WHEN ends_with({root}, 'e') AND left({suf}, 1) IN ('i', 'e', 'a') THEN left({root}, length({root}) - 1) || {suf} ELSE {root} || {suf} END"
_NORMS = f"(VALUES {_values([(i, b, g) for i, (b, g) in enumerate(P.suffix_norm)])}) AS n(i, bad, good)"
_HURT = "word"
for _broken, _sound in P.suffix_norm:
    _HURT = f"replace({_HURT}, {_q(_sound)}, {_q(_broken)})"


def _valid(src: str, x: str) -> str:
    broken = " OR ".join(f"contains(w.word, {_q(b)})" for b, _ in P.suffix_norm)
    return f"""SELECT w.word, CASE WHEN d.suffix = '' THEN true WHEN {broken} THEN false
        WHEN d.suffix IS NOT NULL THEN NOT (length(w.word) <= 4 AND d.suffix IN ('s', 'ed')) ELSE c.word IS NOT NULL END AS valid FROM {src} w LEFT JOIN {x}deco d USING (word) LEFT JOIN {x}comp c USING (word)"""


def _flip(src: str) -> str:
    return f"SELECT word, left(word, i - 1) || translate(substr(word, i, 1), {_q(_FLIP_SRC)}, {_q(_FLIP_DST)}) || substr(word, i + 1) AS cand, 0.25::DOUBLE AS cost, 'word_correction' AS type, i::BIGINT AS ord FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {src}) WHERE contains({_q(_FLIP_SRC)}, substr(word, i, 1))"


def _virama(src: str) -> str:
    c = _q(P.consonants)
    return f"""SELECT word, left(word, i) || '\'\'' || substr(word, i + 1) || e AS cand, CASE WHEN k = 0 THEN 0.3 ELSE 0.4 END::DOUBLE AS cost, 'ocr_repair' AS type, (i * 100 + k)::BIGINT AS ord
        FROM (SELECT word, unnest(range(1, length(word))) AS i FROM {src} WHERE length(word) > 1), (VALUES (0, ''), (1, 's')) AS x(k, e) WHERE contains({c}, substr(word, i, 1)) AND contains({c}, substr(word, i + 1, 1))"""


def _delete(src: str) -> str:
    return f"SELECT word, left(word, i - 1) || substr(word, i + 1) AS cand, 0.4::DOUBLE AS cost, 'word_correction' AS type, i::BIGINT AS ord FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM {src} WHERE length(word) >= 3)"


def _append(src: str) -> str:
    return f"SELECT word, word || c AS cand, 0.35::DOUBLE AS cost, 'word_correction' AS type, k::BIGINT AS ord FROM {src}, (VALUES {_values(list(enumerate(sorted(P.consonants))))}) AS x(k, c) WHERE length(word) >= 3"


def _stem_confusion(src: str, sfx: str, second: bool) -> str:
    linked = f", {_JOIN('(stem || ' + _q(P.link_vowel) + ')', 'suffix')} AS second" if second else ""
    return f"""SELECT word, {_JOIN('stem', 'suffix')} AS cand, cost::DOUBLE AS cost, 'ocr_repair' AS type, ((9 - k) * 1000000 + i * 1000 + seq)::BIGINT AS ord{linked} FROM (
        SELECT word, suffix, k, i, cost, seq, left(root, i - 1) || dst || substr(root, i + k) AS stem FROM (
            SELECT word, root, suffix, k, unnest(range(1, length(root) - k + 2)) AS i FROM (SELECT word, arg_min(root, rank) AS root, arg_min(suffix, rank) AS suffix FROM {sfx} SEMI JOIN {src} USING (word) WHERE length(root) >= 2 GROUP BY word), (SELECT unnest([3, 2, 1]) AS k) WHERE length(root) >= k)
        JOIN conf ON substr(root, i, k) = src)"""


def _distance(a: str, b: str, limit: float = 4.0) -> str:
    """The weighted distance by dynamic programming over lists, row by row; an empty row means over the limit."""
    costs = ", ".join(f"{_q(x + y)}: {c}" for x, y, c, _ in P.directed if len(x) == len(y) == 1)
    sub = f"CASE WHEN substr({a}, r[1]::INT, 1) = substr({b}, c[1]::INT, 1) THEN 0 ELSE coalesce(MAP {{{costs}}}[substr({a}, r[1]::INT, 1) || substr({b}, c[1]::INT, 1)], 1) END"
    cells = f"list_prepend([prev[1] + 1], list_transform(range(1, length({b}) + 1), lambda j: [j::DOUBLE]))"
    new = f"list_reduce({cells}, lambda acc, c: list_append(acc, least(acc[len(acc)] + 1, prev[c[1]::INT + 1] + 1, prev[c[1]::INT] + {sub})))"
    row = f"CASE WHEN len(prev) = 0 THEN prev ELSE list_transform([{new}], lambda n: CASE WHEN list_min(n) > {limit} THEN []::DOUBLE[] ELSE n END)[1] END"
    rows = f"list_prepend(list_transform(range(0, length({b}) + 1), lambda j: j::DOUBLE), list_transform(range(1, length({a}) + 1), lambda i: [i::DOUBLE]))"
    last = f"list_transform([list_reduce({rows}, lambda prev, r: {row})], lambda n: CASE WHEN len(n) = 0 THEN {limit + 1} ELSE n[len(n)] END)[1]"
    return f"CASE WHEN {a} = {b} THEN 0 WHEN abs(length({a}) - length({b})) > {limit} THEN {limit + 1} ELSE {last} END"


def _union(src: str, sfx: str) -> str:
    """All raw candidates of ``src``: word, gen, ord, cost, type, raw, second, fixed."""
    row = lambda gen, q: f"SELECT word, {gen} AS gen, ord, cost, type, cand AS raw, NULL AS second, NULL AS fixed FROM ({q})"
    stem = f"CASE WHEN ends_with(word, bad) AND length(word) > length(bad) THEN left(word, length(word) - length(bad)) || {_q(P.link_vowel)} END"
    mend = f"SELECT word, 4 AS gen, i::BIGINT AS ord, 0.2::DOUBLE AS cost, 'word_correction' AS type, replace(word, bad, good) AS raw, stem AS second, CASE WHEN stem IS NOT NULL THEN {_JOIN('stem', 'good')} END AS fixed FROM (SELECT *, {stem} AS stem FROM {src}, {_NORMS} WHERE contains(word, bad))"
    nasal = f"SELECT word, replace(word, {_q(P.nasal)}, '') AS cand, 0.35::DOUBLE AS cost, 'ocr_repair' AS type, 0::BIGINT AS ord FROM {src} WHERE contains(word, {_q(P.nasal)})"
    stems = f"SELECT word, 7 AS gen, ord, cost, type, cand AS raw, second, NULL AS fixed FROM ({_stem_confusion(src, sfx, True)})"
    return " UNION ALL ".join([row(3, _gen((5, 4, 3, 2), src)), mend, row(5, _gen((1,), src)), row(6, _flip(src)), stems, row(8, _virama(src)), row(9, nasal), row(10, _delete(src)), row(11, _append(src))])


_BODY = {
    "tokenize_documents": "SELECT doc_id, pos, type, value, start_at, (start_at + length(value))::INT AS end_at FROM tok",
    "token_type_counts": "SELECT d.doc_id, " + ", ".join(f"count(*) FILTER (type = '{k}') AS n_{k}" for k in ("word", "number", "other")) + " FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id",
    "reconstruct_roundtrip": "SELECT doc_id, md5(array_to_string(v, '')) AS digest, array_to_string(v, '') = text AS same FROM tok0 JOIN documents USING (doc_id)",
    "strip_splitlines": f"SELECT doc_id, line_no, {_STRIP('line')} AS line FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INT AS line_no FROM (SELECT doc_id, string_split_regex({_STRIP('text')}, {_q(BREAKS)}) AS ls FROM documents)) WHERE {_STRIP('line')} <> ''",
    "lexicon_from_documents": "SELECT word, ord, before AS word_before, after AS word_after FROM lex",
    "affix_expand": f"""SELECT DISTINCT word FROM (SELECT word FROM lexw UNION ALL SELECT CASE WHEN strip = '' THEN word || ad WHEN ends_with(word, strip) THEN left(word, length(word) - length(strip)) || ad END
        FROM (SELECT word, unnest([(length(word) % 3 + 1)::VARCHAR, (length(word) % 2 + 3)::VARCHAR]) AS flag FROM lexw) JOIN (VALUES {_values(AFFIXES)}) AS a(flag, strip, ad) USING (flag)) WHERE regexp_matches(word, '^[{P.block}]+$')""",
    "unigram_bigram": "SELECT word AS w1, after AS w2, count(*) AS n FROM lex WHERE after IS NOT NULL GROUP BY 1, 2",
    "known_words": "SELECT word FROM words WHERE word IN (SELECT word FROM lexw)",
    "unknown_words": "SELECT word FROM unk",
    "longest_suffix": "SELECT word, arg_min(suffix, rank) AS suffix, arg_min(root, rank) AS root FROM sfx GROUP BY word",
    "decompose_words": "SELECT * FROM deco",
    "sandhi_join": f"SELECT word AS root, suffix, {_JOIN('word', 'suffix')} AS joined FROM lexw, sufs",
    "compound_split": "SELECT word FROM comp",
    "valid_words": _valid("words", ""),
    "gen_confusion": _gen((5, 4, 3, 2)),
    "gen_single_confusion": _gen((1,)),
    "gen_vowel_flip": _flip("unk"),
    "gen_suffix_norm": f"SELECT word, replace(word, bad, good) AS cand, 0.2::DOUBLE AS cost, 'word_correction' AS type, i::BIGINT AS ord FROM (SELECT DISTINCT {_HURT} AS word FROM words WHERE {_HURT} <> word), {_NORMS} WHERE contains(word, bad)",
    "gen_normalised": "SELECT w2 AS word, word AS cand, 0.2::DOUBLE AS cost, 'ocr_repair' AS type, 0::BIGINT AS ord FROM (SELECT word, replace(replace(word, 'fi', 'ﬁ'), 'fl', 'ﬂ') AS w2 FROM words) WHERE word <> w2",
    "gen_nasal": f"SELECT left(word, 2) || {_q(P.nasal)} || substr(word, 3) AS word, word AS cand, 0.35::DOUBLE AS cost, 'ocr_repair' AS type, 0::BIGINT AS ord FROM words WHERE length(word) > 3",
    "unigrams": f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[{P.word}]+')) AS word FROM documents) GROUP BY word",
    "resolve_words": f"SELECT word, CASE WHEN suffix = '' THEN root ELSE {_JOIN('root', 'suffix')} END AS form FROM deco UNION ALL SELECT word, word FROM comp ANTI JOIN deco USING (word)",
    "gen_stem_confusion": _stem_confusion("unk", "sfx", False),
    "gen_virama": _virama("unk"),
    "gen_delete": _delete("unk"),
    "gen_append": _append("unk"),
    "weighted_distance": f"SELECT word, other, round({_distance('word', 'other')}, 6) AS distance FROM (SELECT word, after AS other FROM lex WHERE after IS NOT NULL)",
    "lm_score": "SELECT word, round(lm, 6) AS lm, round(greatest(0, least(0.3, (lm + 10) / 20)), 6) AS bonus FROM (SELECT word, ln(1.0 / (SELECT count(*) FROM lexw)) + CASE WHEN before IS NOT NULL THEN 1.5 ELSE 0 END + CASE WHEN after = 'zz' THEN 1.5 ELSE 0 END AS lm FROM lex)",
    "ocr_line_assembly": f"""SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY round_even(top / 12.0, 0), "left", block_num, line_num)::INT AS line_ord, md5(text) AS text,
        CASE WHEN width < 0.7 * 720 AND abs("left" + width / 2.0 - 360) < 72 THEN 'C' WHEN "left" > 0.55 * 720 THEN 'R' ELSE 'L' END AS alignment, top, "left", width, height FROM (
        SELECT doc_id, (pos // 600 + 1)::INT AS page_num, (pos // 120)::INT AS block_num, (pos // 12)::INT AS line_num, string_agg({_STRIP('value')}, ' ' ORDER BY pos) AS text, (min(60 * (pos % 12)))::INT AS "left", min(12 * (pos // 12) + pos % 5)::INT AS top,
        (max(60 * (pos % 12)) + 50 - min(60 * (pos % 12)))::INT AS width, (max(12 * (pos // 12) + pos % 5) + 10 - min(12 * (pos // 12) + pos % 5))::INT AS height FROM tok WHERE {_STRIP('value')} <> '' AND pos * 37 % 101 - 5 >= 0 GROUP BY 1, 2, 3, 4)""",
    "pdf_block_lines": 'SELECT doc_id, page_num, line_ord::INT AS line_ord, md5(text) AS text, alignment, top, "left", width, height FROM bl',
    "page_stats_searchable": f"""SELECT *, (total_chars > 50 AND script_chars > 0.05 * total_chars) OR total_chars > 200 AS is_searchable FROM (SELECT doc_id, count(*) AS page_count, sum(length({_STRIP('text')}))::BIGINT AS total_chars, sum(length(regexp_replace(text, '[^{P.block}]', '', 'g')))::BIGINT AS script_chars FROM pg GROUP BY doc_id)""",
    "page_text": "SELECT doc_id, page_num, md5(text) AS text_md5, length(text) AS chars FROM pg",
    "full_text": "SELECT doc_id, count(*) AS pages, md5(string_agg(text, chr(10) || chr(10) ORDER BY page_num)) AS text_md5 FROM pg GROUP BY doc_id",
    "page_runs": "SELECT doc_id, row_number() OVER w AS line_ord, page_num, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_num) AS run FROM bl WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, line_ord)",
    "progress_events": "SELECT doc_id, page_num, 'ocr' AS stage, pct::INT AS percent, greatest(35, least(pct, 85))::INT AS bar FROM (SELECT doc_id, page_num, floor(15 + (row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1)::DOUBLE / count(*) OVER (PARTITION BY doc_id) * 70) AS pct FROM pg)",
    "heal_pairs": f"""SELECT doc_id, pos, w1, w2, start_at, end_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, isle ORDER BY pos) AS turn FROM (SELECT *, pos - 2 * row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS isle FROM (
        SELECT doc_id, pos, value AS w1, w2, start_at, (s2 + length(w2))::INT AS end_at FROM (SELECT *, lead(value, 1) OVER w AS gap, lead(type, 2) OVER w AS t2, lead(value, 2) OVER w AS w2, lead(start_at, 2) OVER w AS s2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
        WHERE type = 'word' AND gap = ' ' AND t2 = 'word' AND value NOT IN ('the', 'of', 'and') AND w2 NOT IN ('the', 'of', 'and')) p
        WHERE w2 IN (SELECT suffix FROM sufs) OR starts_with(w2, 'self') OR starts_with(w2, 'selves') OR w1 || w2 IN (SELECT word FROM lexw)
        OR (w1 NOT IN (SELECT word FROM lexw) AND w1 || w2 IN (SELECT word FROM jdeco)))) WHERE turn % 2 = 1""",
}
_JD = f"""
jw AS (SELECT DISTINCT value || w2 AS word FROM (SELECT value, type, lead(value, 1) OVER w AS gap, lead(type, 2) OVER w AS t2, lead(value, 2) OVER w AS w2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE type = 'word' AND gap = ' ' AND t2 = 'word'),
jsfx AS (SELECT word, left(word, length(word) - length(suffix)) AS root FROM jw JOIN sufs ON ends_with(word, suffix) AND length(word) > length(suffix)),
jdeco AS (SELECT DISTINCT word FROM (SELECT word, unnest([root, CASE WHEN root || 'e' NOT IN ('mr', 'dr', 'st') THEN root || 'e' END, CASE WHEN length(root) >= 3 AND ends_with(root, 'at') THEN root || 'e' END,
    CASE WHEN NOT (length(root) >= 3 AND ends_with(root, 'at')) AND length(root) > 3 THEN left(root, length(root) - 1) || 'y' END]) AS stem FROM jsfx) WHERE stem IN (SELECT word FROM lexw))
"""


def _candidates(src: str, x: str) -> str:
    """CTEs from the words of ``src`` that are not valid (bad) to their candidates (cands), as the correction takes them."""
    return f"""
{_decomposed(src, x)}, {_compounds(src, x)},
ok AS MATERIALIZED ({_valid(src, x)}), bad AS MATERIALIZED (SELECT word FROM ok WHERE NOT valid AND length(word) > 1),
raws AS MATERIALIZED ({_union("bad", x + "sfx")}),
asked AS MATERIALIZED (SELECT DISTINCT raw AS word FROM raws UNION SELECT second FROM raws WHERE second IS NOT NULL),
{_decomposed("asked", "r")}, {_compounds("asked", "r")},
forms AS MATERIALIZED (SELECT word, CASE WHEN suffix = '' THEN root ELSE {_JOIN('root', 'suffix')} END AS form FROM rdeco UNION ALL SELECT word, word FROM rcomp ANTI JOIN rdeco USING (word)),
found AS (SELECT r.word, gen, ord, cost, type, coalesce(a.form, CASE WHEN fixed IS NOT NULL THEN CASE WHEN d.word IS NOT NULL THEN fixed END ELSE b.form END) AS cand
    FROM raws r LEFT JOIN forms a ON a.word = r.raw LEFT JOIN forms b ON b.word = r.second LEFT JOIN rdeco d ON d.word = r.second),
best AS MATERIALIZED (SELECT word, cand, min(cost) AS cost, arg_min(type, (cost, gen, ord)) AS type, min({{'g': gen, 'o': ord}}) AS place FROM found WHERE cand <> '' GROUP BY word, cand),
cands AS MATERIALIZED (SELECT b.word, cand, cost, type, place.g AS gen, place.o AS ord, l.word IS NOT NULL AS seen, l.before, l.after FROM best b LEFT JOIN lex l ON l.word = b.cand)
"""


_SCORE = lambda prev, nxt: f"""round(cost - CASE WHEN {prev} IS NOT NULL OR {nxt} IS NOT NULL THEN greatest(0, least(0.3, (ln(CASE WHEN seen THEN 2.0 ELSE 1.0 END / (2.0 * (SELECT count(*) FROM lexw)))
    + CASE WHEN {prev} = before THEN 1.5 ELSE 0 END + CASE WHEN {nxt} = after THEN 1.5 ELSE 0 END + 10) / 20)) ELSE 0 END, 3)"""  # noqa: E731
_PICK = lambda prev, nxt: f"arg_min({{'cand': cand, 'type': type}}, ({_SCORE(prev, nxt)}, gen, ord, cand))"
#: Correction: healed tokens, words in order, choices along chains of words that have candidates, one more link a round.
_HEALED = f"""
heal AS MATERIALIZED ({_BODY["heal_pairs"]}),
mtok AS MATERIALIZED (SELECT t.doc_id, t.pos, t.type, coalesce(h.w1 || h.w2, t.value) AS value, t.start_at, coalesce(h.end_at, t.start_at + length(t.value)) AS end_at
    FROM tok t LEFT JOIN heal h USING (doc_id, pos) WHERE NOT EXISTS (SELECT 1 FROM heal g WHERE g.doc_id = t.doc_id AND (g.pos + 1 = t.pos OR g.pos + 2 = t.pos))),
mw AS MATERIALIZED (SELECT DISTINCT value AS word FROM mtok WHERE type = 'word')
"""
_FIX = f"""
wtok AS MATERIALIZED (SELECT *, row_number() OVER w AS k, lag(value) OVER w AS prev, lead(value) OVER w AS nxt FROM mtok WHERE type = 'word' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
hot AS MATERIALIZED (SELECT doc_id, k, pos, value, prev, nxt FROM wtok SEMI JOIN (SELECT DISTINCT word AS value FROM cands) USING (value)),
link AS MATERIALIZED (SELECT h.*, p.k IS NULL AS first FROM hot h LEFT JOIN hot p ON p.doc_id = h.doc_id AND p.k + 1 = h.k),
head AS (SELECT doc_id, k, pos, value, {_PICK('prev', 'nxt')} AS c FROM link JOIN cands ON word = value WHERE first GROUP BY doc_id, k, pos, value),
rec AS (SELECT doc_id, k, pos, value, c.cand AS cand, c.type AS type FROM head UNION ALL
    SELECT doc_id, k, pos, value, c.cand, c.type FROM (SELECT l.doc_id, l.k, l.pos, l.value, (SELECT {_PICK('r.cand', 'l.nxt')} FROM cands WHERE cands.word = l.value) AS c FROM rec r JOIN link l ON l.doc_id = r.doc_id AND l.k = r.k + 1)),
won AS MATERIALIZED (SELECT doc_id, pos, value, cand, type FROM rec WHERE cand <> value),
dist AS MATERIALIZED (SELECT value, cand, round({_distance('value', 'cand')}, 2) AS d FROM (SELECT DISTINCT value, cand FROM won)),
fixes AS MATERIALIZED (SELECT doc_id, 0 AS kind, w1 || ' ' || w2 AS original, w1 || w2 AS correction, 0.5::DOUBLE AS edit_distance, 'ocr_repair' AS type, start_at, end_at FROM heal
    UNION ALL SELECT doc_id, 1, value, cand, d::DOUBLE, won.type, start_at, end_at FROM won JOIN dist USING (value, cand) JOIN mtok USING (doc_id, pos, value)),
built AS (SELECT doc_id, string_agg(coalesce(cand, m.value), '' ORDER BY pos) AS corrected, count(*) FILTER (m.type = 'word') AS total_words FROM mtok m LEFT JOIN won USING (doc_id, pos) GROUP BY doc_id),
sums AS (SELECT doc_id, count(*) AS n, string_agg(concat_ws('|', original, correction, edit_distance::VARCHAR, type, start_at, end_at), ';' ORDER BY kind, start_at) AS cs FROM fixes GROUP BY doc_id)
"""
_JUDGED = {
    "candidates_raw": "SELECT gen, count(*) AS n, min(raw) AS least, max(raw) AS greatest, round(sum(cost), 3) AS cost FROM raws GROUP BY gen",
    "candidate_best": "SELECT word, cand, cost, type, gen, ord, seen FROM cands",
    "suggest_words": f"""SELECT w.word, coalesce(c.cand, w.word) AS correction, round(CASE WHEN c.cand IS NULL THEN 0 ELSE {_distance('w.word', 'c.cand')} END, 6) AS edit_distance, coalesce(c.type, 'none') AS type
        FROM words w LEFT JOIN (SELECT word, c.cand AS cand, c.type AS type FROM (SELECT word, {_PICK('NULL', 'NULL')} AS c FROM cands GROUP BY word) WHERE c.cand <> word) c USING (word)""",
}
_MENDED = {
    "correct_documents": """SELECT d.doc_id, md5(coalesce(corrected, text)) AS corrected_md5, coalesce(n, 0) > 0 AS has_errors, coalesce(total_words, 0) AS total_words, coalesce(n, 0) AS total_corrections,
        round((1.0::DOUBLE - coalesce(n, 0)::DOUBLE / greatest(coalesce(total_words, 0), 1)) * 100, 1) AS accuracy_rate, coalesce(cs, '') AS corrections FROM documents d LEFT JOIN built USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "correction_summary": "SELECT type, count(*) AS n, count(DISTINCT original) AS originals, round(avg(edit_distance), 4) AS mean_distance FROM fixes GROUP BY type",
    "diff_spans": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY kind, start_at)::INT AS row, start_at, end_at, original, correction, CASE type WHEN 'hybrid' THEN 'diff-yellow' WHEN 'ocr_repair' THEN 'diff-blue' ELSE 'diff-green' END AS class,
        CASE type WHEN 'hybrid' THEN 'Dual (OCR + Word)' WHEN 'ocr_repair' THEN 'OCR Glyph Repair' ELSE 'Word Correction' END AS label FROM fixes""",
}
SQL = {k: f"WITH {_BASE}{',' + _JD if k == 'heal_pairs' else ''} {v}" for k, v in _BODY.items()}
SQL |= {k: f"WITH {_BASE},{_candidates('words', 'v')} {v}" for k, v in _JUDGED.items()}
SQL |= {k: f"WITH RECURSIVE {_BASE},{_JD},{_HEALED},{_candidates('mw', 'v')},{_FIX} {v}" for k, v in _MENDED.items()}
_KN_RULES = "regexp_replace(regexp_replace(regexp_replace(b, '[೦ಂ]+', 'ಂ', 'g'), 'ಎ[ಿೀ]', 'ಅ', 'g'), '([ಅ-ಹ][ಾ-ೖ]?)೯', 'ರ್\\1', 'g')"
SQL |= {
    "normalize_bridge": f"SELECT doc_id, md5(n) AS digest, length(n) AS chars, n <> b AS changed, length(regexp_replace(n, '[^{KANNADA.block}]', '', 'g')) AS script_chars FROM (SELECT *, {_KN_RULES} AS n FROM (SELECT doc_id, translate(lower(text), '{_LA}', '{_KN + _KN_DIGITS}') AS b FROM documents))",
    "ext_filter": f"""SELECT page_id, name, ext, ext = '.pdf' AS pdf, ext IN ({", ".join(_q(x) for x in T.IMAGES)}) AS image FROM (SELECT *, lower(regexp_extract(name, '\\.[^./\\\\]+$')) AS ext FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') || ['.PDF', '.png', '', '.Jpeg', '.txt'][page_id % 5 + 1] AS name FROM pages))""",
    "safe_filename": """SELECT page_id, CASE WHEN b = '' THEN 'document' ELSE b END || '.txt' AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[/\\\\:*?"<>|\\x00]', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g') AS b FROM pages)""",
    "route_documents": f"""WITH d AS (SELECT doc_id, doc_id % 6 AS kind, replace(replace(replace(text, chr(12), ''), chr(0), ''), chr(1), '') AS text FROM documents),
        s AS (SELECT doc_id, kind, CASE kind WHEN 3 THEN 500 + doc_id % 4 WHEN 1 THEN 2 WHEN 4 THEN NULL ELSE 1 END AS page_count, CASE WHEN kind = 0 OR kind = 5 THEN text WHEN kind = 2 THEN left(text, 30) ELSE '' END AS body FROM d),
        c AS (SELECT *, CASE WHEN kind IN (0, 2) THEN length({_STRIP('body')}) ELSE 0 END AS total_chars, CASE WHEN kind IN (0, 2) THEN length(regexp_replace(body, '[^{P.block}]', '', 'g')) ELSE 0 END AS script_chars FROM s),
        r AS (SELECT *, CASE WHEN kind = 4 OR page_count > 500 THEN 'rejected' WHEN (total_chars > 50 AND script_chars > 0.05 * total_chars) OR total_chars > 200 THEN 'digital' ELSE 'scanned' END AS route FROM c),
        l AS (SELECT *, CASE route WHEN 'digital' THEN len(list_filter(string_split_regex({_STRIP('body')}, {_q(BREAKS)}), lambda x: {_STRIP('x')} <> '')) WHEN 'scanned' THEN ceil(len(regexp_extract_all(body, '[A-Za-z0-9]+')) / 10) ELSE 0 END AS n_lines FROM r)
        SELECT doc_id, route, page_count, total_chars, script_chars, n_lines::BIGINT AS n_lines, CASE route WHEN 'rejected' THEN 0 WHEN 'digital' THEN (n_lines > 0)::INT ELSE page_count END::BIGINT AS n_pages,
            CASE WHEN kind = 4 THEN 'ValueError: unreadable' WHEN page_count > 500 THEN 'PDF has ' || page_count || ' pages; the limit is 500' END AS error FROM l""",
    "latest_session_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts, count(*) AS n_events FROM events GROUP BY user_id",
}
