"""Lexicons: word lists, affix expansion, neighbours in sort order, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..script import ScriptProfile
from ..staging import scope, small, stage

#: Lexicons up to this many words are broadcast, after a count; larger ones join by shuffle.
MAX_BROADCAST = 2_000_000


class Lexicon:
    """Distinct words with their place in sort order, counted once to settle how they are joined."""

    def __init__(self, words: DataFrame):
        with scope() as s:
            self.table = s.keep(stage(ordered(words)))
        self.size = self.table.count()

    def words(self, name: str = "word") -> DataFrame:
        out = self.table.select(F.col("word").alias(name))
        return F.broadcast(out) if self.size <= MAX_BROADCAST else out

    def neighbours(self) -> DataFrame:
        return F.broadcast(self.table) if self.size <= MAX_BROADCAST else self.table


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of literals, as a local relation."""
    quote = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}D" if isinstance(v, float) else str(v)
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def read_dic(spark: SparkSession, path: str, p: ScriptProfile) -> DataFrame:
    """(base, flags) of a word list with ``word/flag,flag`` lines; a count in the first line is no word."""
    line = F.trim(F.col("value"))
    parts = F.split(line, "/", 2)
    base, flags = F.trim(parts[0]), F.try_element_at(parts, F.lit(2))
    rows = spark.read.text(path).filter((line != "") & ~line.rlike("^[0-9]+$"))
    out = rows.select(base.alias("base"), F.when(flags.isNotNull(), F.transform(F.split(flags, ","), T.strip)).alias("flags"))
    return out.filter(T.is_word(F.col("base"), p))


def read_aff(spark: SparkSession, path: str) -> DataFrame:
    """(flag, strip, add) of suffix rules; headers go, 0 means nothing, continuations are cut off."""
    f = F.split(T.strip(F.col("value")), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).filter((F.size("f") >= 4) & (F.col("f")[0] == "SFX") & ~F.col("f")[2].isin("Y", "N"))
    nothing = lambda c: F.when(c == "0", "").otherwise(c)
    add = nothing(F.col("f")[3])
    return rows.select(F.col("f")[1].alias("flag"), nothing(F.col("f")[2]).alias("strip"), F.element_at(F.split(add, "/"), 1).alias("add"))


def expand(bases: DataFrame, affixes: DataFrame, p: ScriptProfile) -> DataFrame:
    """Distinct words: the bases, and each base under each rule of its flags."""
    flagged = bases.select("base", F.explode("flags").alias("flag"))
    stem = F.when(F.col("strip") == "", F.col("base")).when(F.endswith("base", F.col("strip")), T.substr("base", 1, F.length("base") - F.length("strip")))
    made = flagged.join(F.broadcast(affixes), "flag").select(F.concat(stem, F.col("add")).alias("word"))  # rules: one file
    return bases.select(F.col("base").alias("word")).unionByName(made).filter(F.col("word").isNotNull() & T.is_word(F.col("word"), p)).distinct()


def load(spark: SparkSession, dic: str, p: ScriptProfile, aff: str | None = None, core: list[str] | DataFrame | None = None) -> DataFrame:
    """The words of files and further core words."""
    bases = read_dic(spark, dic, p)
    words = expand(bases, read_aff(spark, aff), p) if aff else bases.select(F.col("base").alias("word")).distinct()
    if core is not None:
        words = words.unionByName(core if isinstance(core, DataFrame) else literal_table(spark, [(w,) for w in core], ["word"])).distinct()
    return words


def from_documents(docs: DataFrame, p: ScriptProfile, *, id_col="doc_id", text_col="text", min_docs: int = 3) -> DataFrame:
    """Lower-cased words that occur in at least ``min_docs`` documents."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"[{p.word}]+"), F.lit(0)))
    count = lambda df: df.groupBy("word").agg(F.count("*").alias("docs"))
    each = lambda df: df.select("id", F.explode("words").alias("word")).filter(T.is_word(F.col("word"), p))
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("texts")).filter("texts > 1")
    ids = small(stage(ids.select(F.struct("id").alias("id"))))  # as a struct, in which nulls are equal
    rows = docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), words.alias("words"))
    # Texts of one id count once, so their words are dealt out by id; the words of other texts are counted in each task first.
    alone, several = rows.join(ids, "id", "left_anti"), rows.join(ids, "id", "left_semi")
    total = count(each(alone)).unionByName(count(each(several).distinct()))
    return total.groupBy("word").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("word")


def ordered(lexicon: DataFrame) -> DataFrame:
    """(word, ord, before, after): words in code-point order with their neighbours.

    A range partitioning sorts in parallel; ranks are offsets of partitions plus ranks within
    them, and the neighbours over partition borders come from one row per partition.
    """
    part = stage(lexicon.select("word").distinct().repartitionByRange("word").withColumn("p", F.spark_partition_id()))
    w = Window.partitionBy("p").orderBy("word")
    ends = part.groupBy("p").agg(F.count("*").alias("n"), F.min("word").alias("lo"), F.max("word").alias("hi"))
    e = Window.orderBy("p")  # one row per partition
    ends = ends.select("p", F.coalesce(F.sum("n").over(e.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"), F.lag("hi").over(e).alias("pre"), F.lead("lo").over(e).alias("post"))
    out = part.withColumn("r", F.row_number().over(w)).withColumn("b", F.lag("word").over(w)).withColumn("a", F.lead("word").over(w)).join(F.broadcast(ends), "p")
    return out.select("word", (F.col("off") + F.col("r") - 1).cast("long").alias("ord"), F.coalesce("b", "pre").alias("before"), F.coalesce("a", "post").alias("after"))


def unigrams(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.count("*").alias("n"))


def bigrams(lex: DataFrame) -> DataFrame:
    """Counts of neighbouring words of an ordered lexicon."""
    return lex.filter(F.col("after").isNotNull()).groupBy(F.col("word").alias("w1"), F.col("after").alias("w2")).agg(F.count("*").alias("n"))


def known(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    return words.join(lexicon.words(), "word", "left_semi")


def unknown(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    return words.join(lexicon.words(), "word", "left_anti")
