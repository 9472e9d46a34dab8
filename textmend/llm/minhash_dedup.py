"""MinHash near-dedup by tensored banding, with candidates verified on full sets.

A document's set holds the hashes of its distinct word shingles.  Instead of one
band of K minhashes for each of M tables, two small collections of ``SIDE`` sub-bands of
``SUB`` minhashes are computed, and table (i, j) is keyed by the pair of sub-bands (A_i,
B_j): SIDE^2 tables of 2*SUB minhashes each from only 2*SIDE*SUB minhash functions.  With
SIDE = 12 and SUB = 3, two sets of similarity 0.8 share a table with probability
(1 - (1 - 0.8^3)^12)^2 > 0.9996, of 0.85 with 0.99998.

Steps.  (1) One map over the texts gives set digests and sub-bands; equal sets become
one class, named by its least doc_id, so copies cost nothing further.  (2) Table keys
are counted with partial aggregation (a hot key is one row per task); keys that one
class holds alone go.  (3) The members of a key are parted by overlapping windows of set
sizes, such that two sets that may be linked always have a window in common.  Each is
tied to the least member of its window, which is linear in the size of a key and never
parts a pair that shares a key; what hangs together is a family.  (4) A family's texts meet in one task, or block by block if there
are many, and are compared exactly on full sets, except those that are in one component
by then; no pair is ever a row.  In a family of several blocks, every block meets the
least member first; then only members outside the largest component meet the rest.
(5) Links become components.

Edge cases: null and empty texts have an empty set and are linked with nothing; a text
of one word has that word as its set; rows without doc_id are kept and not linked;
equal rows fall into one class; extra columns are ignored; an empty table is fine.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WORD, arrow_map, bounded_broadcast, discard, stage, table
from .components import components

#: Shingles are five words unless a caller asks otherwise, as op6 does.
SIDE, SUB, SHINGLE, PERCENT = 12, 3, 5, 80
CACHE = 50_000
_WORD = re.compile(WORD)
_MASK = (1 << 64) - 1


def _constants(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 64, n, np.uint64)[:, None], r.integers(0, 1 << 64, n, np.uint64)[:, None] | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, w):
        h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self) < CACHE:
            self[w] = h
        return h


class Shingler:
    def __init__(self, width: int):
        self.width, self.hashes = width, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        words = _WORD.findall(text.translate(ASCII_LOWER)) if text else []
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def sub_bands(s: np.ndarray, xor: np.ndarray, mul: np.ndarray, sub: int) -> np.ndarray:
    """The sub-band hashes of a set: minhashes in groups of ``sub``, mixed into one."""
    low = np.full(len(xor), _MASK, np.uint64)
    for i in range(0, len(s), 8192):
        low = np.minimum(low, ((s[i : i + 8192] ^ xor) * mul).min(1))
    low = low.reshape(-1, sub)
    out = np.zeros(len(low), np.uint64)
    for i in range(sub):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + low[:, i])
    return out


def size_class(n: Column, percent: int) -> Column:
    """Class of a set's size: sizes of two sets at ``percent`` are in one class or in neighbouring ones."""
    # Classes are a little wider than the ratio, so that rounding parts no pair.
    return F.floor(F.log(n.cast("double")) / math.log(max(100 / max(percent, 1), 1.01)) * (1 - 1e-9)).cast("int")


def sets(docs: DataFrame, *, id_col, text_col, side, sub, shingle, seed) -> DataFrame:
    """(id, digest, n, bands): digest null where the set is empty."""

    def run(batches):
        make, (xor, mul) = Shingler(shingle), _constants(2 * side * sub, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digest, n, bands = [], [], []
                for t in part.column(1).to_pylist():
                    s = make(t)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    bands.append(sub_bands(s, xor, mul, sub).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "digest", "n", "bands"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_col), run, "id long, digest binary, n long, bands array<long>")


def linked(nodes: list[int], sets_: list[np.ndarray], percent: int) -> list[int]:
    """For each set the least node of its component, by exact similarities.

    Sets that are in one component by now are not compared.  One set's marks in a bitmap
    over the group's shingles give its intersections with all others at once.
    """
    n = len(sets_)
    size = np.array([len(x) for x in sets_])
    flat = np.unique(np.concatenate(sets_), return_inverse=True)[1] if n else np.empty(0, np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    seen, comp = np.zeros(int(flat.max()) + 1 if len(flat) else 1, bool), np.arange(n)
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        small, large = np.minimum(size[i], size[rest]), np.maximum(size[i], size[rest])
        rest = rest[(comp[rest] != comp[i]) & (100 * small >= percent * large) & (small > 0)]
        if not len(rest):
            continue
        mine = flat[off[i] : off[i + 1]]
        seen[mine] = True
        if 2 * len(rest) > n - i:
            both = np.add.reduceat(seen[flat[off[i + 1] :]].astype(np.int64), off[i + 1 : -1] - off[i + 1])[rest - i - 1]
        else:
            both = np.array([np.count_nonzero(seen[flat[off[j] : off[j + 1]]]) for j in rest.tolist()])
        seen[mine] = False
        hit = rest[100 * both >= percent * (size[i] + size[rest] - both)]
        if len(hit):
            comp[np.isin(comp, comp[hit])] = comp[i]
    least: dict[int, int] = {}
    for c, v in zip(comp.tolist(), nodes):
        least[c] = min(v, least.get(c, v))
    return [least[c] for c in comp.tolist()]


def _compared(rows: DataFrame, *, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) between the members of each group (g, node, text): a node and its component's least."""

    def run(batches):
        make = Shingler(shingle)

        def edges(nodes, found):
            root = linked(nodes, found, percent)
            at = [i for i in range(len(nodes)) if nodes[i] != root[i]]
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in at], pa.int64()), pa.array([root[i] for i in at], pa.int64())], names=["a", "b"])

        last, nodes, found = None, [], []
        for batch in batches:
            for g, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g != last:
                    if len(nodes) > 1:
                        yield edges(nodes, found)
                    last, nodes, found = g, [], []
                nodes.append(node)
                found.append(make(text.as_py()))
        if len(nodes) > 1:
            yield edges(nodes, found)

    dealt = rows.select("g", "node", "t").repartition("g").sortWithinPartitions("g", "node")
    return stage(arrow_map(dealt, run, "a long, b long"), "links")


#: A family is cut into blocks of so many classes, and of so many shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 500_000
#: Documents whose table keys one task makes: few enough for their counts to stay in memory.
CLASSES = 6_000
#: Members of families up to this many are broadcast to find their texts, more are joined by shuffle.
MAX_MEMBERS = 500_000


def link(docs: DataFrame, *, id_col="doc_id", text_col="text", side=SIDE, sub=SUB, shingle=SHINGLE, percent=PERCENT, seed=7) -> tuple[DataFrame, DataFrame]:
    """(documents: id, digest, n; classes: digest, node, component)."""
    made = stage(sets(docs, id_col=id_col, text_col=text_col, side=side, sub=sub, shingle=shingle, seed=seed), "sets")
    known = made.filter("id IS NOT NULL AND digest IS NOT NULL")
    parts = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), made.count() // CLASSES)
    classes = stage(known.groupBy("digest").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")).repartition(parts, "digest"), "classes")

    # Tables: keys that more than one class has, and their members by window of sizes.
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(side) for j in range(side)]))
    key = F.xxhash64("p.i", "p.j", F.element_at("bands", F.col("p.i") + 1), F.element_at("bands", F.col("p.j") + 1 + side))
    rows = classes.select("node", size_class(F.col("n"), percent).alias("s"), "bands", at.alias("p")).select("node", "s", key.alias("key"))
    shared = stage(rows.groupBy("key").agg(F.min("node").alias("c"), F.max("node").alias("z")).filter("c <> z").select("key"), "keys")
    window = F.explode(F.array(F.col("s"), F.col("s") + 1)).alias("w")
    members = stage(rows.join(shared, "key").select("key", "node", window).select(F.xxhash64("key", "w").alias("key"), "node"), "members")
    least = stage(members.groupBy("key").agg(F.min("node").alias("c"), F.max("node").alias("z")).filter("c <> z").select("key", "c"), "least")
    star = stage(members.join(least, "key").filter("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct(), "ties")
    discard(shared, members, least)

    # Families: what is connected by keys.
    family = stage(components(star), "family")
    discard(star)

    # Within families every member is compared with every other, block by block.
    size = classes.groupBy("node").agg(F.max("n").alias("n"))
    fam = family.select("node", F.col("component").alias("f")).join(size, "node")
    blocks = fam.groupBy("f").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    fam = stage(fam.join(blocks, "f").select("f", "node", "n", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("blk")), "blocks")
    text = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t")).join(bounded_broadcast(fam, MAX_MEMBERS), "node")
    # A family's least member meets all of its blocks, so most links show in this linear pass.
    first = text.withColumn("x", F.explode(F.when(F.col("node") == F.col("f"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("blk"))))
    links = _compared(first.select(F.struct("f", "x").alias("g"), "node", "t"), shingle=shingle, percent=percent)
    edges = links
    if not fam.filter("nb > 1").isEmpty():
        # Those outside the largest component of a family of several blocks meet all other members.
        big = fam.filter("nb > 1").join(components(links), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        big = stage(big, "big")
        top = big.groupBy("f", "c").agg(F.count("*").alias("m")).groupBy("f").agg(F.max_by("c", "m").alias("top"))
        out = big.join(top, "f").filter("c <> top")
        ob = out.groupBy("f").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("ob"))
        out = stage(out.join(ob, "f").select("node", "f", "nb", "ob", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ob")).cast("int").alias("o")), "out")
        texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
        every = big.join(ob, "f").select("node", "f", F.col("blk").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("o"))
        asked = out.select("node", "f", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("x"), "o")
        pairs = every.unionByName(asked).distinct()
        more = _compared(texts.join(pairs, "node").select(F.struct("f", "x", "o").alias("g"), "node", "t"), shingle=shingle, percent=percent)
        edges = links.unionByName(more)
    full = stage(components(edges), "full")
    result = stage(classes.select("digest", "node").join(full, "node", "left").select("digest", "node", F.coalesce("component", "node").alias("component")), "linked")
    discard(classes, family, fam, links, full)
    return made.select("id", "digest", "n"), result


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", **params) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    made, classes = link(docs, id_col=id_col, text_col=text_col, **params)
    out = made.join(classes.select("digest", "component"), "digest", "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def op6_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: Ids of dropped documents up to this many are broadcast (8 bytes each), more are joined by shuffle.
MAX_GONE = 500_000


def drop_near_duplicates(docs: DataFrame, *, id_col="doc_id", **params) -> DataFrame:
    """``docs`` without the documents that are copies or near copies of one that is kept."""
    gone = stage(near_duplicates(docs, id_col=id_col, **params).filter("NOT kept").select(id_col), "gone")
    return docs.join(bounded_broadcast(gone, MAX_GONE), id_col, "left_anti").select(*docs.columns)
