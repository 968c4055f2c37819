"""Merchant resolution: known keywords, aliases, then fuzzy headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions import fuzzy
from tallybook.operators.dimension import bounded

HIGH, MEDIUM = 0.82, 0.66
#: Letters of a keyword that headers are looked up by.
GRAM = 3


def resolve_exact(headers: DataFrame, keywords: DataFrame) -> DataFrame:
    """The longest keyword (keyword, canonical) in each header (header_id, header), then by name.

    A keyword's first ``GRAM`` letters (all of a shorter one) stand somewhere in the header: both meet in an equi join on them."""
    names = headers.select("header").distinct()
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("header") - n + 1, F.lit(1))), lambda i: F.substring("header", i, F.lit(n)))
    grams = names.withColumn("gram", F.explode(F.array_distinct(F.concat(*[at(n) for n in range(1, GRAM + 1)]))))
    keys = bounded(keywords).where(F.length("keyword") > 0).withColumn("gram", F.substring("keyword", F.lit(1), F.lit(GRAM)))
    met = grams.join(keys, "gram").where(F.contains(F.col("header"), F.col("keyword"))).drop("gram")
    met = headers.join(met, "header")
    w = Window.partitionBy("header_id").orderBy(F.desc(F.length("keyword")), "keyword")
    return met.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("header_id", "canonical", "keyword")


def resolve_fuzzy(headers: DataFrame, families: DataFrame, similarity) -> DataFrame:
    """The most alike family name; ``similarity`` maps two columns to 0..1.  From HIGH on corrected,
    from MEDIUM on suggested, else unknown.  Each distinct header is compared once with the family
    table, which is a bounded dimension."""
    met = headers.select("header").distinct().join(bounded(families))
    scored = met.withColumn("likeness", F.round(similarity(F.col("header"), F.col("canonical")), 6))
    w = Window.partitionBy("header").orderBy(F.desc("likeness"), "canonical")
    best = scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    status = F.when(F.col("likeness") >= HIGH, "corrected").when(F.col("likeness") >= MEDIUM, "suggested").otherwise("unknown")
    return headers.join(best, "header").select("header_id", "canonical", "likeness", status.alias("status"))


def expand_tokens(text: Column, vocabulary: dict[str, str]) -> Column:
    """Whole words replaced by what they abbreviate; null when none is."""
    known = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    tokens = F.split(text, " ")
    out = F.transform(tokens, lambda t: F.coalesce(F.element_at(known, F.upper(t)), t))
    return F.when(F.exists(tokens, lambda t: F.element_at(known, F.upper(t)).isNotNull()), F.array_join(out, " "))


def repeat_repairs(damaged: DataFrame, clean: DataFrame, budget: int = 1000, share: int = 250) -> DataFrame:
    """damaged (receipt_id, line_no, text) against clean (receipt_id, clean) lines of the same receipt: the
    cheapest repair of letters and digits, if only one text has that cost (in thousandths).

    Both have as many letters and digits, and these cost ``budget`` at most, and ``share`` for each of them;
    a letter that differs is taken from the clean line, everything else stays as it is."""
    letters = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[\p{L}\p{N}]"), F.lit(0))
    ours = damaged.withColumn("_a", letters("text")).withColumn("_n", F.size("_a")).where("_n > 0")
    theirs = clean.distinct().withColumn("_b", letters("clean")).withColumn("_n", F.size("_b"))
    price = lambda a, b: F.when(F.upper(a) == F.upper(b), 0).otherwise(F.round(1000 * fuzzy.letter_cost(F.upper(a), F.upper(b))).cast("int"))
    met = ours.join(theirs, ["receipt_id", "_n"]).withColumn("cost", F.aggregate(F.zip_with("_a", "_b", price), F.lit(0), lambda t, x: t + x).cast("long"))
    met = met.where((F.col("cost") > 0) & (F.col("cost") <= F.least(F.lit(budget), share * F.col("_n"))))

    def step(state: Column, c: Column) -> Column:
        is_letter = c.rlike(r"[\p{L}\p{N}]")
        other = F.get(F.col("_b"), state["i"])
        taken = F.when(is_letter & (F.upper(c) != F.upper(other)), other).otherwise(c)
        return F.struct((state["i"] + F.when(is_letter, 1).otherwise(0)).alias("i"), F.concat(state["out"], taken).alias("out"))

    chars = F.filter(F.split("text", ""), lambda c: c != "")
    met = met.withColumn("repaired", F.aggregate(chars, F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step, lambda s: s["out"]))
    best = met.groupBy("receipt_id", "line_no").agg(F.min("cost").alias("cost"), F.collect_set(F.struct("cost", "repaired")).alias("_all"))
    least = F.array_distinct(F.transform(F.filter("_all", lambda x: x["cost"] == F.col("cost")), lambda x: x["repaired"]))
    return best.withColumn("_t", least).where("size(_t) = 1").select("receipt_id", "line_no", "cost", F.get("_t", F.lit(0)).alias("repaired"))


def banner(lines: DataFrame, ratio: float = 1.8, top_share: float = 0.25) -> DataFrame:
    """lines (receipt_id, line_no, text, height, top 0..1): the tallest line in the top share of the page
    that is at least ``ratio`` times the median height; ties to the upper one."""
    median = lines.groupBy("receipt_id").agg(F.median("height").alias("mid"))
    tall = lines.join(median, "receipt_id").where((F.col("top") <= top_share) & (F.col("height") >= ratio * F.col("mid")))
    w = Window.partitionBy("receipt_id").orderBy(F.desc("height"), "line_no")
    return tall.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("receipt_id", "line_no", "text")


def first_plausible(lines: DataFrame, most: int = 10) -> DataFrame:
    """The first of ``most`` lines with over three letters and no date or price."""
    fine = lines.where((F.col("line_no") <= most) & F.col("text").rlike("[A-Za-z].*[A-Za-z].*[A-Za-z].*[A-Za-z]") & ~F.col("text").rlike(r"[0-9]{2}[/.-][0-9]{2}|[0-9]\.[0-9]{2}"))
    w = Window.partitionBy("receipt_id").orderBy("line_no")
    return fine.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("receipt_id", "line_no", "text")
