"""For each text the entry of a list with the greatest Jaccard similarity of their token sets, by an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import token_set
from corvane.operators.ranks import checkpointed


def _tasks(texts: int, entries: int, least: int, pairs: int = 2_000_000) -> int:
    """Tasks for so many texts: each meets every entry at most, and at most `pairs` of them (a thousand texts at least)."""
    return max(least, -(-texts // max(1000, pairs // max(entries, 1))))


def best_match(texts: DataFrame, entries: DataFrame, key: str, entry: str, text_col: str = "text", entry_text: str = "text", probe: int = 6, small: int = 1_000_000) -> DataFrame:
    """key, entry, jaccard of each row of texts: the first entry among equals; null and 0 where no token is shared. Keys
    and entries are unique and not null.

    Tokens are ordered by how many entries hold them, rarest first, and texts keep only tokens that some entry holds.
    The entries that hold one of a text's `probe` rarest tokens give a similarity b that the best one reaches. An entry
    that reaches b shares b times the larger set at least, so it holds one of the text's rarest tokens but the last
    ceil(b |x|) - 1, and among its own rarest by the same rule: only such entries, of sizes that allow b, are compared
    whole. No pair is made for tokens that all texts share.

    Texts are dealt over tasks by their key, at most about two million pairs a task; with a short list the entries come to
    them, so pairs are told apart and compared where their text is, and a task's memory doesn't follow the input."""
    e = entries.select(F.col(entry), token_set(F.col(entry_text)).alias("ys")).filter(F.size("ys") > 0)
    lists = e.select(entry, F.size("ys").alias("ny"), F.explode("ys").alias("token"))
    count = lists.groupBy("token").agg(F.count("*").alias("f"))
    # Numbers that rise with a token's place in the order: written, so that every later read finds the same.
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    vocab = checkpointed(count.repartitionByRange(parts, "f", "token").sortWithinPartitions("f", "token").select("token", F.monotonically_increasing_id().alias("r")))
    of_entry = checkpointed(lists.join(vocab, "token").groupBy(entry, "ny").agg(F.array_sort(F.collect_list("r")).alias("ys")))
    few = (of_entry.agg(F.sum("ny")).first()[0] or 0) <= small
    postings = of_entry.select(entry, "ny", F.posexplode("ys").alias("at_y", "r"))

    x = texts.select(F.col(key), token_set(F.col(text_col)).alias("xs"))
    of_text = checkpointed(x.select(key, F.size("xs").alias("nx"), F.explode("xs").alias("token")).join(vocab, "token").groupBy(key, "nx").agg(F.array_sort(F.collect_list("r")).alias("xs")))
    dealt = of_text.repartition(_tasks(of_text.count(), of_entry.count(), parts), key)

    def compared(pairs: DataFrame) -> DataFrame:
        """(key, entry) -> with j. A list of few tokens is broadcast, so pairs move as two numbers; of a longer one each
        pair takes its entry's tokens along to the text's."""
        both = F.size(F.array_intersect("xs", "ys")).cast("double")
        pairs = pairs.distinct()
        met = pairs.join(dealt, key).join(F.broadcast(of_entry), entry) if few else pairs.join(of_entry, entry).join(of_text, key)
        return met.select(key, entry, (both / (F.col("nx") + F.col("ny") - both)).alias("j"))

    def least_shared(b: Column, n: Column) -> Column:
        return F.greatest(F.ceil(b * n - 1e-9), F.lit(1))

    lists_of = F.broadcast(postings) if few else postings
    rare = dealt.select(key, F.explode(F.slice("xs", 1, probe)).alias("r"))
    first = checkpointed(compared(rare.join(lists_of.select("r", entry), "r").select(key, entry)))
    own = dealt.join(first.groupBy(key).agg(F.max("j").alias("b")), key)
    size = F.size("xs")
    prefix = F.slice("xs", F.lit(1), F.greatest(size - least_shared(F.col("b"), F.col("nx")) + 1, F.lit(0)).cast("int"))
    most = F.least(F.col("size"), F.col("ny"))
    met = own.select(key, "nx", "b", size.alias("size"), F.explode(prefix).alias("r")).join(lists_of, "r")
    met = met.filter((F.col("at_y") <= F.col("ny") - least_shared(F.col("b"), F.col("ny"))) & (most >= (F.col("b") - 1e-9) * (F.col("nx") + F.col("ny") - most)))
    fresh = compared(met.select(key, entry))
    if not few:
        fresh = compared(met.select(key, entry).distinct().join(first, [key, entry], "left_anti"))
    found = first.unionByName(fresh).groupBy(key).agg(F.max(F.struct("j", (-F.col(entry)).alias("k"))).alias("m"))
    return texts.select(key).join(found, key, "left").select(key, (-F.col("m.k")).alias(entry), F.coalesce("m.j", F.lit(0.0)).alias("jaccard"))
