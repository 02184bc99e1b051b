"""Sentence ends learnt from a corpus, after Kiss and Strunk (2006): which words are abbreviations, which pairs belong together across a period, and
which words often start a sentence, each by a log-likelihood ratio.

The statistics are aggregates over the words of all texts. A text is then cut at white space behind a sign that may end a sentence, unless the
statistics say that the period belongs to the word before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources.lineage import written

# The thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
MAY_END = rf"(?<=[.!?])[\"'\)\]]*{T.SPACE}+"
BRACKETS = "^[\"'(\\[]+|[\"')\\]]+$"


def bare(token: Column) -> Column:
    """A token without quotes and brackets around it, in lower case."""
    return F.lower(F.regexp_replace(token, BRACKETS, ""))


def ratio(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of ``second`` words following ``first`` ones ``both`` times among ``n``."""
    term = lambda k, m, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(1 - p)).otherwise(0.0)
    d = lambda c: c.cast("double")
    p, p1, p2 = d(second) / d(n), d(both) / d(first), d(second - both) / d(n - first)
    return -2 * (term(both, first, p) + term(second - both, n - first, p) - term(both, first, p1) - term(second - both, n - first, p2))


@dataclass(frozen=True)
class Boundaries:
    """``words(word, with_period, without, score, abbreviation)``, ``pairs(word, following, both, score)``, ``starters(word, both, score)``."""

    words: DataFrame
    pairs: DataFrame
    starters: DataFrame

    @classmethod
    def learnt(cls, texts: DataFrame, text: str = "text") -> Boundaries:
        """From all words of ``texts``. Words are counted once with and once without the period; only pairs over a period are counted as pairs."""
        tokens = F.transform(T.tokens(F.col(text)), bare)
        own = texts.select(tokens.alias("_t")).select("_t", F.concat(F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 1, F.lit(0))), F.array(F.lit(""))).alias("_next"))
        each = own.select(F.explode(F.arrays_zip("_t", "_next")).alias("x")).select(F.col("x._t").alias("token"), F.col("x._next").alias("following"))
        each = each.withColumn("period", F.col("token").endswith(".")).withColumn("word", F.when(F.col("period"), F.expr("left(token, length(token) - 1)")).otherwise(F.col("token")))
        named = each.filter(F.col("word").rlike(r"\p{L}"))
        counts = named.groupBy("word").agg(F.sum(F.col("period").cast("long")).alias("with_period"), F.sum((~F.col("period")).cast("long")).alias("without"))
        counts = written(counts, "words")
        total = counts.agg(F.sum(F.col("with_period") + F.col("without")).alias("n"), F.sum("with_period").alias("p"))  # one row
        k1, k2, rate = F.col("with_period"), F.col("without"), F.col("p") / F.col("n")
        null = k1 * F.log(rate) + F.when(k2 > 0, k2 * F.log(1 - rate)).otherwise(0.0)
        other = k1 * F.log(F.lit(0.99)) + k2 * F.log(F.lit(0.01))
        letters = F.length(F.replace("word", F.lit("."), F.lit("")))
        factor = F.exp(-letters) * (F.length("word") - letters + 1) * F.pow(letters.cast("double"), -k2)
        score = F.when((k1 > 0) & (rate < 1), -2 * (null - other) * factor).otherwise(0.0)
        words = counts.crossJoin(F.broadcast(total)).withColumn("score", score).withColumn("abbreviation", F.col("score") >= ABBREVIATION).drop("p")
        words = written(words, "word-scores")
        over = named.filter("period and following <> ''").withColumn("following", F.regexp_replace("following", r"[.,;:!?]+$", "")).filter(F.col("following").rlike(r"\p{L}"))
        over = written(over.groupBy("word", "following").agg(F.count(F.lit(1)).alias("both")), "pairs")
        size = words.select(F.col("word"), (F.col("with_period") + F.col("without")).alias("size"), "with_period", "n", "abbreviation")
        after = size.select(F.col("word").alias("following"), F.col("size").alias("_second"))
        pairs = over.join(size, "word").join(after, "following")
        # the word before the period counts with its period
        scored = pairs.withColumn("score", ratio(F.col("both"), F.col("with_period"), F.col("_second"), F.col("n")))
        more = F.col("both") / F.col("with_period") > F.col("_second") / F.col("n")
        held = scored.filter(more & (F.col("score") >= COLLOCATION) & (F.col("both") > 1) & F.col("abbreviation"))
        breaks = pairs.filter("not abbreviation").groupBy("following", "_second", "n").agg(F.sum("both").alias("both"))
        ends = words.filter("not abbreviation").agg(F.sum("with_period").alias("_first"))  # one row
        starts = breaks.crossJoin(F.broadcast(ends)).withColumn("score", ratio(F.col("both"), F.col("_first"), F.col("_second"), F.col("n")))
        often = F.col("both") / F.col("_first") > F.col("_second") / F.col("n")
        starters = starts.filter(often & (F.col("score") >= STARTER)).select(F.col("following").alias("word"), "both", "score")
        return cls(words.drop("n"), written(held.select("word", "following", "both", "score"), "collocations"), written(starters, "starters"))

    def cut(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, sentence, text): the sentences of each document from 0, white space inside a sentence as it was but for places where it might have ended,
        which have one space. ``key`` names one document; blank texts have none."""
        pieces = F.filter(F.split(T.strip(F.coalesce(text, F.lit(""))), MAY_END), lambda x: x != "")
        each = docs.select(key, F.posexplode(pieces).alias("_i", "_piece"), pieces.alias("_all"))
        following = F.get(F.col("_all"), F.col("_i") + 1)
        each = each.select(key, "_i", "_piece", F.element_at(T.tokens(F.col("_piece")), -1).alias("_last"), F.get(T.tokens(following), F.lit(0)).alias("_next"))
        each = each.withColumns({"_last": bare(F.col("_last")), "_following": F.regexp_replace(bare(F.col("_next")), r"[.,;:!?]+$", "")})
        each = each.withColumn("_word", F.when(F.col("_last").endswith("."), F.expr("left(_last, length(_last) - 1)")))
        short = self.words.filter("abbreviation").select(F.col("word").alias("_word"), F.lit(True).alias("_short"))
        together = self.pairs.select(F.col("word").alias("_word"), F.col("following").alias("_following"), F.lit(True).alias("_together"))
        starts = self.starters.select(F.col("word").alias("_following"), F.lit(True).alias("_starts"))
        judged = each.join(short, "_word", "left").join(together, ["_word", "_following"], "left").join(starts, "_following", "left")
        capital = F.col("_next").rlike(r"^[\"'(\[]*\p{Lu}")
        inside = F.coalesce("_short", F.lit(False)) & (F.coalesce("_together", F.lit(False)) | ~(F.coalesce("_starts", F.lit(False)) & capital))
        ended = judged.withColumn("_end", F.when(inside, 0).otherwise(1))
        number = F.coalesce(F.sum("_end").over(W.partitionBy(key).orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
        parts = ended.withColumn("sentence", number).groupBy(key, "sentence").agg(F.array_sort(F.collect_list(F.struct("_i", "_piece"))).alias("_p"))
        return parts.select(key, "sentence", F.array_join(F.transform("_p", lambda x: x["_piece"]), " ").alias("text"))
