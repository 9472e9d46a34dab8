r"""URL filters: listed rules, then a tree of path templates for the rest.

Each host has a tree of path segments, and so have all hosts together.  (1) Shapes: a
segment of digits, hex digits, or letters mixed with digits becomes a wildcard of that
shape; an extension stays.  (2) Rare branches: a literal that holds fewer than
``MIN_SUPPORT`` pages of its parent becomes ``*``.  (3) Similar branches: sibling literals
with the same mix of child shapes are compared with their pool; those whose labelled
rate does not differ from the pool's (two-sided z below ``Z``) are merged into one ``+``
branch; branches with labels and branches without are pooled apart.  What is left of a
path is its template, in its host's tree and in that of all hosts.

Urls that a rule decides are the labels.  A template's purity is its share of blocked
labels, smoothed by ``SMOOTH`` pseudo-counts at the purity of what it backs off to: the
host's template to its siblings under one parent, these to the same path's template among all hosts,
that to the rate of all labels.  So a template without labels on its host is judged by what
such paths are elsewhere.  The threshold of rejection is calibrated: labels of a
fifth of the paths (by hash) are held back, trees and purities are made from the others, and the
value of ``GRID`` that decides most of the held labels rightly is taken, the greatest among
equals.  Purities under it are then worked out from all labels.

Everything is native.  Pages are aggregated to (host, shape path) first, with partial
sums, so that a hot host costs one row per task and path.  The trees are built on that
table branching by branching, as deep as any node goes that has pages enough and more
than one path; what the paths of a node share is passed over at once, however long it is.

Edge cases: a null url, or one without ``://``, has empty host and path, falls under no
rule and is judged by the template of the empty host; ties between rules of one
length go to the smaller rule; repeated rows are judged alike; no labels at all: allow;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, stage, table

#: (rule, verdict): host, then path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MIN_SUPPORT, Z, SMOOTH, REJECT = 3, 1.96, 4.0, 0.8  # REJECT: the threshold without held labels
GRID = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
#: Paths whose fingerprint starts so are held back for calibration (3 of 16).
HELD = ("0", "1", "2")

# Shapes of variable segments, in order of precedence.
SHAPES = [
    ("^[0-9]+$", "{num}"),
    (r"^[0-9]+(\.[A-Za-z]+)$", "{num}.ext"),
    ("^[0-9a-fA-F-]{8,}$", "{hex}"),
    ("^[^.]*[0-9][^.]*$", "{mix}"),
]


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.call_function("substring", url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct<rule,verdict> of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shaped(seg: Column) -> Column:
    out = seg
    for pattern, name in reversed(SHAPES):
        out = F.when(seg.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _open_shape(seg: Column) -> Column:
    """Whether a segment is a wildcard (or nothing) by its shape alone."""
    return F.startswith(seg, F.lit("{")) | (seg == "")


def _common(lo: Column, hi: Column) -> Column:
    """How many leading elements all arrays between the least and the greatest have in common."""
    differs = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs == 0, F.size(lo)).otherwise(differs - 1).cast("int")


def _joined(segs: Column) -> Column:
    return F.when(F.size(segs) > 0, F.concat(F.lit("/"), F.array_join(segs, "/"))).otherwise("")


def tree(paths: DataFrame) -> DataFrame:
    """(host, key, template) of rows (host, key: shape path, n, lab, blk), one per host and key.

    A round takes one branching off every node that has pages enough and more than one
    path; what all paths of a node have in common below it is passed over at once, so
    that there are as many rounds as branchings on top of each other, not as segments.
    """
    segs = F.split("key", "/")
    cur = paths.select("host", "key", "n", "lab", "blk", F.slice(segs, 2, F.size(segs)).alias("rest"), F.lit("").alias("tpl"), F.lit(MIN_SUPPORT).cast("long").alias("sup"), F.lit(2).cast("long").alias("keys"))
    done, held = None, None
    while True:
        goes_on = (F.size("rest") > 0) & (F.col("sup") >= MIN_SUPPORT) & (F.col("keys") > 1)
        left = F.transform("rest", lambda s: F.when(_open_shape(s) | (F.col("sup") >= MIN_SUPPORT), s).otherwise("*"))
        ends = stage(cur.filter(~goes_on).select("host", "key", F.concat("tpl", _joined(left)).alias("template")), "ends")
        done = ends if done is None else done.unionByName(ends)
        cur = cur.filter(goes_on)
        if held is not None and cur.isEmpty():
            discard(held)
            return done
        cur = cur.withColumn("seg", F.col("rest")[0]).withColumn("rest", F.slice("rest", 2, F.size("rest")))
        kid = F.get("rest", F.lit(0))
        kid = F.when(kid.isNull(), "-").when(F.startswith(kid, F.lit("{")), kid).otherwise("*")
        sums = [F.sum(c).alias(c) for c in ("n", "lab", "blk")]
        ends_of = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
        by_kid = cur.groupBy("host", "tpl", "seg", kid.alias("kid")).agg(*sums, F.count("*").alias("keys"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        # collect_set holds shapes only: one per pattern, plus "*" and "-"
        sib = by_kid.groupBy("host", "tpl", "seg").agg(*sums, F.sum("keys").alias("keys"), *ends_of, F.array_join(F.array_sort(F.collect_set("kid")), "|").alias("mix"))
        lit = ~_open_shape(F.col("seg"))
        sib = sib.withColumn("rare", lit & (F.col("n") < MIN_SUPPORT)).withColumn("has", F.col("lab") > 0).withColumn("lit", lit)
        pool = sib.filter("lit AND NOT rare").groupBy("host", "tpl", "mix", "has").agg(F.sum("lab").alias("plab"), F.sum("blk").alias("pblk"), F.count("*").alias("branches"))
        judged = sib.join(pool, ["host", "tpl", "mix", "has"], "left")
        p = F.col("pblk") / F.when(F.col("plab") > 0, F.col("plab"))
        gap = F.abs(F.col("blk") - F.col("lab") * p)
        same = ~F.col("has") | (gap * gap <= Z * Z * F.col("lab") * p * (1 - p))
        plus = F.concat(F.lit("+"), F.when(F.col("has"), "l").otherwise("u"))
        name = F.when(F.col("rare"), "*").when(F.col("lit") & (F.col("branches") > 1) & same, plus).otherwise(F.col("seg"))
        judged = stage(judged.select("host", "tpl", "seg", name.alias("branch"), "n", "keys", "lo", "hi"), "branches")
        nodes = judged.groupBy("host", "tpl", "branch").agg(F.sum("n").alias("sup"), F.sum("keys").alias("keys"), *ends_of)
        pass_ = F.when((F.col("sup") >= MIN_SUPPORT) & (F.col("keys") > 1), _common(F.col("lo"), F.col("hi"))).otherwise(0)
        branch = judged.select("host", "tpl", "seg", "branch").join(nodes.select("host", "tpl", "branch", "sup", "keys", pass_.alias("pass")), ["host", "tpl", "branch"])
        new = cur.drop("sup", "keys").join(branch, ["host", "tpl", "seg"])
        tpl = F.concat("tpl", F.lit("/"), "branch", _joined(F.slice("rest", F.lit(1), F.col("pass"))))
        new = stage(new.select("host", "key", "n", "lab", "blk", F.slice("rest", F.col("pass") + 1, F.size("rest")).alias("rest"), tpl.alias("tpl"), "sup", "keys"), "tree")
        discard(judged, held)
        cur = held = new


def _purity(lab: str, blk: str, rate: float) -> Column:
    """Smoothed share of blocked labels, from the widest pool to the narrowest."""
    p = F.lit(rate)
    for pool in ("g", "p", "t"):
        p = (F.col(f"{pool}_{blk}") + F.lit(SMOOTH) * p) / (F.col(f"{pool}_{lab}") + F.lit(SMOOTH))
    return p


def templates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(host, key, template, purity) and the threshold, from rows (host, key, lab, blk), one per page."""
    aside = F.substring(F.md5(F.concat("host", F.lit(" "), "key")), 1, 1).isin(*HELD)
    base = labelled.groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("lab").alias("all_lab"), F.sum("blk").alias("all_blk"))
    train = lambda c: F.when(aside, F.lit(0)).otherwise(F.col(f"all_{c}")).cast("long").alias(c)
    base = stage(base.select("host", "key", "n", train("lab"), train("blk"), "all_lab", "all_blk"), "paths")
    own = tree(base)
    wide = tree(base.groupBy(F.lit("").alias("host"), "key").agg(*[F.sum(c).alias(c) for c in ("n", "lab", "blk")]))
    cur = base.join(own, ["host", "key"]).join(wide.select("key", F.col("template").alias("wide")), "key")
    cur = stage(cur.withColumn("parent", F.regexp_replace("template", "/[^/]*$", "")), "templates")
    discard(base)
    cols = ("lab", "blk", "all_lab", "all_blk")
    pooled = lambda pool, *keys: cur.groupBy(*keys).agg(*[F.sum(c).alias(f"{pool}_{c}") for c in cols])
    total = cur.agg(*[F.sum(c).alias(c) for c in cols]).first()  # one row
    rate = lambda lab, blk: float(total[blk] / total[lab]) if total[lab] else 0.0
    # Pools meet in a table of one row per template of a host before paths meet it.
    pools = cur.select("host", "template", "parent", "wide").distinct()
    pools = pools.join(pooled("g", "wide"), "wide").join(pooled("p", "host", "parent"), ["host", "parent"]).join(pooled("t", "host", "template"), ["host", "template"])
    pools = pools.select("host", "template", "wide", _purity("lab", "blk", rate("lab", "blk")).alias("tried"), F.round(_purity("all_lab", "all_blk", rate("all_lab", "all_blk")), 12).alias("purity"))
    cur = stage(cur.join(pools, ["host", "template", "wide"]), "purity")
    right = lambda t: F.sum(F.when(F.round("tried", 12) >= t, F.col("all_blk") - F.col("blk")).otherwise(F.col("all_lab") - F.col("lab") - F.col("all_blk") + F.col("blk")))
    score = cur.agg(*[right(t).alias(str(i)) for i, t in enumerate(GRID)], F.sum(F.col("all_lab") - F.col("lab")).alias("held")).first()
    best = max(range(len(GRID)), key=lambda i: (score[str(i)], i)) if score["held"] else None
    return cur.select("host", "key", "template", "purity"), REJECT if best is None else GRID[best]


def judge(pages: DataFrame, *, id_col="page_id", url_col="url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, template, purity of every row."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("key", F.array_join(F.transform(F.split("path", "/"), shaped), "/"))
    nodes, threshold = templates(rows.select("host", "key", F.col("hit").isNotNull().cast("long").alias("lab"), (F.col("hit.verdict").eqNullSafe(F.lit("block"))).cast("long").alias("blk")))
    out = rows.join(nodes, ["host", "key"], "left")
    verdict = F.coalesce("hit.verdict", F.when(F.col("purity") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op5_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = []
    for rule, verdict in RULES:
        h, _, p = rule.partition("/")
        fits.append(f"CASE WHEN (host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q('/' + p)}) THEN {{'n': {len(rule)}, 'rule': {q(rule)}, 'verdict': {q(verdict)}}} END")
    best = f"list_extract(list_reverse_sort(list_filter([{', '.join(fits)}], lambda x: x IS NOT NULL)), 1)"
    case = " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for p, n in SHAPES)
    sql = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
hit AS MATERIALIZED (SELECT *, {best} AS hit, list_transform(string_split(path, '/'), lambda s: CASE {case} ELSE s END) AS segs FROM hp),
base AS MATERIALIZED (SELECT *, CASE WHEN aside THEN 0 ELSE all_lab END AS lab, CASE WHEN aside THEN 0 ELSE all_blk END AS blk FROM (
    SELECT host, segs, count(*) AS n, count(hit) AS all_lab, count(*) FILTER (hit.verdict = 'block') AS all_blk,
    substr(md5(host || ' ' || array_to_string(segs, '/')), 1, 1) IN ({', '.join(map(q, HELD))}) AS aside FROM hit GROUP BY host, segs))"""
    shape = lambda x: f"(starts_with({x}, '{{') OR {x} = '')"
    for t, start in (("h", "SELECT host, segs, '' AS tpl, n, lab, blk FROM base"), ("g", "SELECT '' AS host, segs, '' AS tpl, sum(n) AS n, sum(lab) AS lab, sum(blk) AS blk FROM base GROUP BY segs")):
        sql += f",\n{t}0 AS MATERIALIZED ({start})"
        for k in range(1, SQL_LEVELS + 1):
            kid = f"CASE WHEN len(segs) > {k + 1} THEN CASE WHEN starts_with(segs[{k + 2}], '{{') THEN segs[{k + 2}] ELSE '*' END ELSE '-' END"
            sql += f""",
{t}s{k} AS MATERIALIZED (SELECT host, tpl, segs[{k + 1}] AS seg, sum(n) AS n, sum(lab) AS lab, sum(blk) AS blk, string_agg(DISTINCT {kid}, '|' ORDER BY {kid}) AS mix
    FROM {t}{k - 1} WHERE len(segs) > {k} AND NOT {shape(f'segs[{k + 1}]')} GROUP BY 1, 2, 3),
{t}p{k} AS (SELECT host, tpl, mix, lab > 0 AS has, sum(lab) AS plab, sum(blk) AS pblk, count(*) AS branches FROM {t}s{k} WHERE n >= {MIN_SUPPORT} GROUP BY 1, 2, 3, 4),
{t}b{k} AS (SELECT s.host, s.tpl, s.seg, CASE WHEN n < {MIN_SUPPORT} THEN '*'
    WHEN branches > 1 AND (NOT has OR pow(blk - lab * pblk / plab, 2) <= {Z * Z} * lab * (pblk / plab) * (1 - pblk / plab)) THEN '+' || CASE WHEN has THEN 'l' ELSE 'u' END
    ELSE seg END AS branch FROM {t}s{k} s LEFT JOIN {t}p{k} p ON s.host = p.host AND s.tpl = p.tpl AND s.mix = p.mix AND (s.lab > 0) = p.has),
{t}{k} AS MATERIALIZED (SELECT t.host, segs, t.tpl || CASE WHEN len(segs) > {k} THEN '/' || coalesce(branch, segs[{k + 1}]) ELSE '' END AS tpl, n, lab, blk
    FROM {t}{k - 1} t LEFT JOIN {t}b{k} b ON t.host = b.host AND t.tpl = b.tpl AND len(segs) > {k} AND segs[{k + 1}] = b.seg)"""
    sums = lambda p: ", ".join(f"sum({c}) AS {p}_{c}" for c in ("lab", "blk", "all_lab", "all_blk"))
    smooth = lambda lab, blk, r: f"(t_{blk} + {SMOOTH} * ((p_{blk} + {SMOOTH} * ((g_{blk} + {SMOOTH} * {r}) / (g_{lab} + {SMOOTH}))) / (p_{lab} + {SMOOTH}))) / (t_{lab} + {SMOOTH})"
    grid = ", ".join(f"{{'right': sum(CASE WHEN tried >= {t} THEN all_blk - blk ELSE all_lab - lab - all_blk + blk END), 't': {t}::DOUBLE}}" for t in GRID)
    return sql + f""",
full_ AS MATERIALIZED (SELECT b.*, h.tpl AS template, regexp_replace(h.tpl, '/[^/]*$', '') AS parent, g.tpl AS wide
    FROM base b JOIN h{SQL_LEVELS} h ON b.host = h.host AND b.segs = h.segs JOIN g{SQL_LEVELS} g ON b.segs = g.segs),
rate AS (SELECT coalesce(sum(blk) / nullif(sum(lab), 0), 0)::DOUBLE AS r, coalesce(sum(all_blk) / nullif(sum(all_lab), 0), 0)::DOUBLE AS all_r FROM full_),
pg AS (SELECT wide, {sums('g')} FROM full_ GROUP BY wide), pp AS (SELECT host, parent, {sums('p')} FROM full_ GROUP BY host, parent),
pt AS (SELECT host, template, {sums('t')} FROM full_ GROUP BY host, template),
pur AS MATERIALIZED (SELECT full_.*, round({smooth('lab', 'blk', 'r')}, 12) AS tried, round({smooth('all_lab', 'all_blk', 'all_r')}, 12) AS purity
    FROM full_ JOIN pg USING (wide) JOIN pp USING (host, parent) JOIN pt USING (host, template), rate),
cut AS (SELECT CASE WHEN held > 0 THEN list_extract(list_reverse_sort(s), 1).t ELSE {REJECT} END AS t FROM (SELECT [{grid}] AS s, coalesce(sum(all_lab - lab), 0) AS held FROM pur))
SELECT page_id, h.host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN purity >= cut.t THEN 'block' ELSE 'allow' END) AS verdict,
    f.template, round(purity, 6) AS purity FROM hit h JOIN pur f ON h.host = f.host AND h.segs = f.segs, cut
"""


#: Levels that the SQL unrolls; the query itself goes as deep as the data does.
SQL_LEVELS = 6
SQL = _sql()
