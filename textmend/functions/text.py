"""Text functions as Columns: normalisation, tokens, white space, weighted distance.

All are null-preserving and stay on the JVM.  Lengths and offsets count code points.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..script import BREAKS, SPACE, ScriptProfile

TOKEN = "array<struct<pos:int,type:string,value:string,start:int,end:int>>"
BLOCK = 16


def substr(col, start, length) -> Column:
    """``substring`` with Column or int positions, from 1."""
    return F.call_function("substring", _c(col), _c(start), _c(length))


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def strip(col: Column) -> Column:
    """Python's ``str.strip``: all Unicode white space, both ends."""
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def split_lines(col: Column) -> Column:
    """Python's ``str.splitlines``: no empty last line after a final break."""
    parts = F.split(col, BREAKS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def normalise(col: Column, p: ScriptProfile) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), p.normalise, col)


def repair(col: Column, p: ScriptProfile) -> Column:
    """struct<value, type>: the normalised word and whether that changed it."""
    n = normalise(col, p)
    return F.struct(n.alias("value"), F.when(n != col, "ocr_repair").otherwise("none").alias("type"))


def is_word(col: Column, p: ScriptProfile) -> Column:
    return col.rlike(f"^[{p.block}]+$")


def script_length(col: Column, p: ScriptProfile) -> Column:
    """Characters of the profile's script."""
    return F.length(F.regexp_replace(col, f"[^{p.block}]", ""))


def token_pattern(p: ScriptProfile) -> str:
    """Runs of digits, of word characters, of all else; every character falls in one of them."""
    return f"[{p.digit}]+|[{p.word}]+|[^{p.digit}{p.word}]+"


def tokens(col: Column, p: ScriptProfile) -> Column:
    """Tokens with offsets, as an array; joined values give the text again."""
    return F.when(col.isNotNull(), let(F.regexp_extract_all(col, F.lit(token_pattern(p)), F.lit(0)), lambda raw: _located(raw, p)))


def words(col: Column, p: ScriptProfile) -> Column:
    """The values of the word tokens alone, as an array."""
    return F.regexp_extract_all(col, F.lit(f"[{p.word}]+"), F.lit(0))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, also where ``f`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _total(nums: Column) -> Column:
    return F.aggregate(nums, F.lit(0), lambda a, x: a + x)


def _blocks(n: Column) -> Column:
    """0 .. the number of blocks of ``BLOCK`` - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def running(nums: Column, f) -> Column:
    """``f(before)``, where ``before(i)`` is the sum of the first i elements of an array of ints.

    Sums are kept of blocks and of blocks of blocks, so that a sum adds few numbers
    however long the array is, and nothing is appended element by element.
    """
    part = lambda arr, i: F.slice(arr, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)
    at = lambda arr, i: F.get(arr, (i / BLOCK).cast("int"))
    sums = lambda arr: F.transform(_blocks(F.size(arr)), lambda b: _total(F.slice(arr, b * BLOCK + 1, BLOCK)))

    def based(one, two):
        # Sums before each block of blocks, then before each block.
        far = F.transform(_blocks(F.size(one)), lambda b: _total(F.slice(two, F.lit(1), b)))
        near = lambda far: F.transform(_blocks(F.size(nums)), lambda b: at(far, b) + _total(part(one, b)))
        return let(far, lambda far: let(near(far), lambda base: f(lambda i: at(base, i) + _total(part(nums, i)))))

    return let(sums(nums), lambda one: let(sums(one), lambda two: based(one, two)))


def _located(raw: Column, p: ScriptProfile) -> Column:
    kind = lambda v: F.when(v.rlike(f"^[{p.digit}]"), "number").when(v.rlike(f"^[{p.word}]"), "word").otherwise("other")

    def placed(before):
        return F.transform(raw, lambda v, i: let(before(i), lambda s: F.struct(i.alias("pos"), kind(v).alias("type"), v.alias("value"), s.alias("start"), (s + F.length(v)).alias("end"))))

    return let(F.transform(raw, lambda v: F.length(v)), lambda lens: running(lens, placed))


def spliced(arr: Column, at: Column, width: int, put) -> Column:
    """``arr`` with ``width`` elements from each place of ``at`` (ascending, without overlap) replaced by ``put(place)``."""

    def one(arr, at):
        begin = lambda j: F.when(j > 0, F.get(at, j - 1) + width).otherwise(0)
        head = F.flatten(F.transform(at, lambda i, j: F.concat(F.slice(arr, begin(j) + 1, i - begin(j)), F.array(put(i, j)))))
        return F.concat(head, F.slice(arr, F.element_at(at, -1) + width + 1, F.size(arr)))

    return let(arr, lambda x: let(at, lambda y: one(x, y)))


def reconstruct(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: t["value"]), "")


def cost_map(p: ScriptProfile) -> Column:
    single = [(a + b, c) for a, b, c, _ in p.directed if len(a) == len(b) == 1]
    return F.create_map(*[F.lit(x) for kv in single for x in kv]) if single else F.create_map(F.lit(""), F.lit(1.0))


def chars(col: Column) -> Column:
    n = F.length(col)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: substr(col, i, 1))).otherwise(F.array().cast("array<string>"))


def weighted_distance(a: Column, b: Column, p: ScriptProfile, limit: float = 4.0) -> Column:
    """Edit distance whose substitutions cost what the confusion table says (else 1).

    ``limit`` + 1 if lengths differ by more than ``limit`` or a whole row of the table is
    above it; results above the limit are otherwise kept.
    """
    costs, cb = cost_map(p), chars(b)
    n = F.length(b)
    row0 = F.transform(F.sequence(F.lit(0), n), lambda i: i.cast("double"))

    def cell(ca, row):
        def f(acc, j):
            other = F.element_at(cb, j)
            sub = F.when(ca == other, 0.0).otherwise(F.coalesce(F.try_element_at(costs, F.concat(ca, other)), F.lit(1.0)))
            best = F.least(F.element_at(acc, -1) + 1.0, F.element_at(row, j + 1) + 1.0, F.element_at(row, j) + sub)
            return F.concat(acc, F.array(best))

        return f

    def step(row, ca):
        cols = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        new = F.aggregate(cols, F.array(F.element_at(row, 1) + 1.0), cell(ca, row))
        new = F.when(F.array_min(new) > limit, F.array().cast("array<double>")).otherwise(new)
        return F.when(F.size(row) == 0, row).otherwise(new)

    d = F.aggregate(chars(a), row0, step, lambda r: F.when(F.size(r) == 0, limit + 1).otherwise(F.element_at(r, -1)))
    return F.when(a == b, 0.0).when(F.abs(F.length(a) - F.length(b)) > limit, limit + 1).otherwise(d)


def distance(a: str, b: str, costs: dict[str, float], limit: float = 4.0) -> float:
    """``weighted_distance`` of two strings; ``costs``: of substitutions, by both characters."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    row = [float(j) for j in range(len(b) + 1)]
    for ca in a:
        new = [row[0] + 1.0]
        for j, cb in enumerate(b):
            sub = 0.0 if ca == cb else costs.get(ca + cb, 1.0)
            new.append(min(new[j] + 1.0, row[j + 1] + 1.0, row[j] + sub))
        if min(new) > limit:
            return limit + 1
        row = new
    return row[-1]


def distances(a: Column, b: Column, p: ScriptProfile, limit: float = 4.0) -> Column:
    """``weighted_distance`` of many pairs, in Arrow batches: a fraction of the time that nested lambdas take."""
    costs = {x + y: c for x, y, c, _ in p.directed if len(x) == len(y) == 1}

    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else distance(x, y, costs, limit) for x, y in zip(xs.to_pylist(), ys.to_pylist())], pa.float64())

    run.__annotations__ = {"xs": pa.Array, "ys": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(a, b)


def _texts(values) -> str:
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "cast(array(" + ", ".join(map(quote, values)) + ") AS array<string>)"


def join_suffix(root: Column, suffix: Column, p: ScriptProfile) -> Column:
    """A root and a suffix as one word, by the first of the profile's sandhi rules that fits."""
    norm = F.create_map(*[F.lit(x) for kv in p.suffix_norm for x in kv])
    suf = F.coalesce(F.try_element_at(norm, suffix), suffix)
    rules = F.expr("array(" + ", ".join(f"named_struct('ends', {_texts(e)}, 'whole', {_texts(w)}, 'starts', {_texts(s)}, 'cut', {c}, 'put', {_texts([t])}[0], 'keep', {str(k).lower()})" for e, w, s, c, t, k in p.sandhi) + ")")
    fits = lambda r: (
        F.exists(r["ends"], lambda e: F.endswith(root, e))
        & ((F.size(r["whole"]) == 0) | F.array_contains(r["whole"], suf))
        & ((F.size(r["starts"]) == 0) | F.exists(r["starts"], lambda s: F.startswith(suf, s)))
    )
    made = F.transform(F.filter(rules, fits), lambda r: F.concat(substr(root, 1, F.length(root) - r["cut"]), r["put"], F.when(r["keep"], suf).otherwise("")))
    return F.when(suffix == "", root).otherwise(F.coalesce(F.get(made, F.lit(0)), F.concat(root, suf)))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))


#: Extensions of image files that are accepted.
IMAGES = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp")


def is_pdf(path: Column) -> Column:
    return file_extension(path) == ".pdf"


def is_image(path: Column) -> Column:
    return file_extension(path).isin(*IMAGES)


def safe_filename(name: Column) -> Column:
    """A name without separators, wildcards and NUL, stripped of dots, underscores and blanks."""
    base = F.regexp_replace(F.regexp_replace(name, r'[/\\:*?"<>|\x00]', "_"), r"\.[^.]*$", "")
    ext = F.lower(F.regexp_extract(name, r"\.[^./\\:*?\"<>|]*$", 0))
    base = F.regexp_replace(base, "^[._ ]+|[._ ]+$", "")
    return F.concat(F.when(base == "", "document").otherwise(base), ext)


def escape_html(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def diff_class(kind: Column) -> Column:
    """The style class of a correction type."""
    return F.when(kind == "hybrid", "diff-yellow").when(kind == "ocr_repair", "diff-blue").otherwise("diff-green")


def type_label(kind: Column) -> Column:
    return F.when(kind == "hybrid", "Dual (OCR + Word)").when(kind == "ocr_repair", "OCR Glyph Repair").otherwise("Word Correction")
