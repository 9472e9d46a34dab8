r"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

All of it is Column expressions.  A pattern's matches come from
``regexp_extract_all`` and their offsets from the gaps that ``split`` leaves between
them: both walk the text leftmost and without overlap, so match i starts after the
first i+1 gaps and i matches.  Runs are matched possessively and started only at their
first character (or at the end of the last match), which gives the same matches as
the plain patterns but never rescans a long run or recurses along it.

Each kind has a base score; a checksum (Luhn for cards, mod 97 for IBANs) or a range
check confirms a span, and a cue word in the ``CONTEXT`` characters before it raises the
score.  Spans below ``THRESHOLD`` are dropped; spans of the base contract are
confirmed by their checks alone and always stay.  The method adds IBANs, and card
numbers of 13 to 15 digits that pass Luhn and have a cue.

Edge cases: null text counts as empty and has no span; an empty table gives an empty
result; repeated rows give repeated results; extra columns are kept, whatever their names
(``spans`` replaces a column named pii, ``redact`` keeps it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, prefix, table, without

# The contract's patterns, in the order in which kinds are listed.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?\b",
}
#: The same languages, without rescans and recursion.
FAST = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
KINDS = list(BASE)
CONTEXT, THRESHOLD = 40, 0.5
# Cue words of each kind (matched without case), and scores.
CUES = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|debit|amex|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.7}
SHORT_CARD, CUE_BONUS = 0.3, 0.25


OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_OK = rf"^(?:{OCTET}\.){{3}}{OCTET}$"
DIGITS = "0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK = 128
SPAN = "struct<kind:string,s:int,e:int,v:string,base:boolean,score:double>"


def located(hits: Column, gaps: Column) -> Column:
    """array<struct<s,e,v>> from matches and the gaps around them.

    A running sum in two levels: within blocks of matches and over block sums, so
    that a text with very many matches costs little more than one with few.
    """
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v")))
    return _let(steps, _placed)


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, also where ``f`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _placed(steps: Column) -> Column:
    n = F.size(steps)
    blocks = F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda b: F.slice(steps, b * BLOCK + 1, BLOCK)
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x["g"] + F.length(x["v"])))
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def add(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.length(x["v"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    def folded(sums):
        base = lambda b: F.aggregate(F.slice(sums, 1, b), F.lit(0), lambda a, x: a + x)
        return F.flatten(F.transform(blocks, lambda b: F.aggregate(part(b), F.struct(base(b).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])))

    return _let(sums, folded)


def _mod97(v: Column) -> Column:
    """Remainder of an IBAN's number, letter by letter."""
    chars = F.split(F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4)), "")
    digit = lambda c: F.call_function("instr", F.lit(DIGITS), c) - 1
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), lambda r, c: (r * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)


def _judge(kind: str, x: Column) -> tuple[Column, Column]:
    """(is a base span, is confirmed by the method) of a match."""
    v = x["v"]
    if kind == "email":
        return F.lit(True), F.lit(True)
    if kind == "ip":
        return v.rlike(IP_OK), v.rlike(IP_OK)
    if kind == "phone":
        ok = F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)
        return ok, ok
    if kind == "card":
        d = F.regexp_replace(v, "[ -]", "")
        ok = F.when(F.length(d).between(13, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))
        return ok & (F.length(d) >= 16), ok
    d = F.replace(v, F.lit(" "), F.lit(""))
    return F.lit(False), F.length(d).between(15, 34) & (_mod97(d) == 1)


def spans(docs: DataFrame, *, text_col="text") -> DataFrame:
    """``docs`` with pii: array<struct<kind,s,e,v,base,score>> by kind, then start (a column of that name is replaced)."""
    own = prefix(docs.columns, "_pii")
    t, hit, gap, at = f"{own}_t", f"{own}_h_", f"{own}_g_", f"{own}_l_"
    out = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    no = F.array().cast("array<string>")
    for k in KINDS:
        gate = F.contains(t, F.lit(NEEDS[k])) if NEEDS[k] else F.lit(True)
        out = out.withColumn(hit + k, F.when(gate, F.regexp_extract_all(t, F.lit(FAST[k]), F.lit(0))).otherwise(no))
    for k in KINDS:
        out = out.withColumn(gap + k, F.when(F.size(hit + k) > 0, F.split(t, FAST[k], -1)).otherwise(no))
    for k in KINDS:
        out = out.withColumn(at + k, located(F.col(hit + k), F.col(gap + k)))

    def scored(k):
        def one(x):
            base, ok = _judge(k, x)
            near = F.call_function("substring", F.col(t), F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
            start = F.when(base | F.lit(k == "iban"), SCORES[k]).otherwise(SHORT_CARD)
            score = F.when(ok, start + F.when(near.rlike(f"(?i){CUES[k]}"), CUE_BONUS).otherwise(0.0)).otherwise(0.0)
            return F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), base.alias("base"), score.alias("score"))

        return F.filter(F.transform(F.col(at + k), one), lambda x: x["base"] | (x["score"] >= THRESHOLD))

    return out.select(*without(docs.columns, ["pii"]), F.concat(*[scored(k) for k in KINDS]).alias("pii"))


def _listed(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def op9_pii(spark, sf_dir) -> DataFrame:
    out = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: lambda x: x["base"] & (x["kind"] == k)
    counts = [F.size(F.filter("pii", of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return out.select("doc_id", *counts, F.sha2(_listed(F.filter("pii", lambda x: x["base"])), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, *, text_col="text") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; texts without spans stay as they are.

    Where spans overlap the earliest (then longest) wins and covers the others' start;
    n_chars, if there, follows the new text.
    """
    aside = {c: fresh(docs.columns, f"{c}_") for c in docs.columns if c.lower() == "pii"}
    own = prefix(docs.columns, "_red")
    out = spans(docs.withColumnsRenamed(aside), text_col=text_col)
    order = F.array_sort(F.transform("pii", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))))
    t = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc, x):
        keep = x["s"] >= acc["at"]
        piece = F.call_function("substring", t, acc["at"] + 1, x["s"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], -x["e"]).alias("at"),
            F.when(keep, F.concat(acc["out"], piece, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(f"{own}_o", zero, put, lambda acc: F.concat(acc["out"], F.call_function("substring", t, acc["at"] + 1, F.length(t))))
    new, some = f"{own}_new", F.size("pii") > 0
    out = out.withColumn(f"{own}_o", order).withColumn(new, F.when(some, done).otherwise(t))
    value = {text_col: F.col(new), "n_chars": F.when(some, F.length(new).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {text_col: F.col(new)}
    return out.select(*[value.get(c, F.col(aside.get(c, c))).alias(c) for c in docs.columns])


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, k in enumerate(KINDS):
        parts.append(f"""SELECT r, {i} AS ki, '{k}' AS kind, i, v, s::BIGINT AS s, (s + length(v))::BIGINT AS e, text FROM (
    SELECT r, text, i, v, sum(length(g)) OVER w + coalesce(sum(length(v)) OVER b, 0) AS s FROM (
      SELECT r, text, unnest(hits) AS v, unnest(list_slice(gaps, 1, len(hits))) AS g, unnest(range(len(hits))) AS i FROM (
        SELECT r, text, regexp_extract_all(text, {q(BASE[k])}) AS hits, string_split_regex(text, {q(BASE[k])}) AS gaps FROM d))
    WINDOW w AS (PARTITION BY r ORDER BY i), b AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    cues = " ".join(f"WHEN '{k}' THEN regexp_matches(near, {q('(?i)' + CUES[k])})" for k in KINDS)
    scores = " ".join(f"WHEN '{k}' THEN {SCORES[k]}" for k in KINDS)
    luhn = "list_sum(list_transform(range(length(dg)), lambda i: CASE WHEN i % 2 = 0 THEN ascii(dg[length(dg) - i]) - 48 ELSE list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9], ascii(dg[length(dg) - i]) - 47) END)) % 10 = 0"
    mod = f"list_reduce(list_prepend(0, list_transform(string_split(bare[5:] || bare[:4], ''), lambda c: instr('{DIGITS}', c) - 1)), lambda r, c: (r * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
n AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dg, replace(v, ' ', '') AS bare,
    substr(text, greatest(s - {CONTEXT}, 0) + 1, least(s, {CONTEXT})) AS near FROM m),
j AS (SELECT *, CASE kind WHEN 'card' THEN length(dg) BETWEEN 13 AND 19 AND {luhn} WHEN 'iban' THEN length(bare) BETWEEN 15 AND 34 AND {mod}
    WHEN 'ip' THEN regexp_matches(v, {q(IP_OK)}) WHEN 'phone' THEN length(dg) BETWEEN 8 AND 15 ELSE true END AS ok,
    CASE kind {cues} END AS cue FROM n),
b AS (SELECT *, CASE kind WHEN 'card' THEN ok AND length(dg) >= 16 WHEN 'iban' THEN false ELSE ok END AS base FROM j),
k AS (SELECT *, CASE WHEN ok THEN CASE WHEN base OR kind = 'iban' THEN CASE kind {scores} END ELSE {SHORT_CARD} END + CASE WHEN cue THEN {CUE_BONUS} ELSE 0 END ELSE 0 END AS score FROM b),
f AS (SELECT r, {", ".join(f"count(*) FILTER (base AND kind = '{x}') AS n_{x}" for x in KINDS[:4])},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ki, s) FILTER (base) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ki, s) AS spans
    FROM k WHERE base OR score >= {THRESHOLD} GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in KINDS[:4])}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (r)
"""


SQL = _sql()
