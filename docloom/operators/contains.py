"""Which texts contain which of many parts: parts are found by how they begin and settled by equality.

A part's beginning (as many letters as the greatest of GRAMS that it has) and its length are its shape. Texts are split
into their grams; at each place where a gram begins a part, the text is cut at the lengths of the parts that begin so, and the
pieces are joined to the parts by equality. So the work is the texts' letters times the lengths that a beginning has,
and the parts: no part meets a text that it only resembles, and nothing is a nested loop however many parts there are.

Edge cases: null texts and parts meet nothing; an empty part is contained in every text; repeated
parts count once; case counts; very long texts are split once, in linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram.
GRAMS = [1, 2, 4, 8, 16]
#: Beginnings of parts that are broadcast.
BROADCAST_GRAMS = 200_000


def grams(letters: Column, q: int) -> Column:
    """(at, gram): the q-grams of a text that is given as its letters, with their places from 1."""
    return F.transform(F.sequence(F.lit(1), F.size(letters) - (q - 1)), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(letters, i, q), "").alias("gram")))


def contains_join(texts: DataFrame, parts: DataFrame, text: str, part: str) -> DataFrame:
    """Rows of ``texts`` with each ``part`` that their column ``text`` contains."""
    wanted = parts.select(F.col(part).alias("_part")).where(F.col("_part").isNotNull()).distinct()
    names = texts.select(F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    # The gram of a part is its beginning: as many letters as the greatest of GRAMS that it has.
    size = F.char_length("_part")
    q = F.lit(0)
    for n in GRAMS:
        q = F.when(size >= n, F.lit(n)).otherwise(q)
    shapes = wanted.select(q.alias("_q"), size.alias("_size"), F.substring("_part", 1, GRAMS[-1]).alias("_head")).withColumn("_gram", F.expr("substring(_head, 1, _q)"))
    shapes = shapes.groupBy("_q", "_gram").agg(F.collect_set("_size").alias("_sizes"))
    kinds = sorted(r["_q"] for r in shapes.select("_q").distinct().collect())  # at most len(GRAMS) + 1
    pairs = names.select("_text", F.lit("").alias("_part")).where(F.lit(0 in kinds))
    letters, found = F.try_element_at(F.array(F.split("_text", "")), F.lit(1)), None
    for n in kinds:
        if n:
            # The letters are bound by a lambda, so that they are split once and not for each gram.
            of = F.flatten(F.transform(F.array(letters), lambda x: grams(x, n)))  # noqa: B023
            own = names.where(F.char_length("_text") >= n).select(key("_text").alias("_id"), F.lit(n).alias("_q"), F.explode(of).alias("_g")).select("_id", "_q", "_g.at", F.col("_g.gram").alias("_gram"))
            found = own if found is None else found.unionByName(own)
    if found is not None:
        known = F.broadcast(shapes) if shapes.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS else shapes.hint("merge")
        places = found.join(known, ["_q", "_gram"]).select("_id", F.explode("_sizes").alias("_n"), "at").groupBy("_id").agg(F.collect_list(F.struct("at", F.col("_n").alias("n"))).alias("_at"))
        cut = lambda x: F.transform("_at", lambda p: F.array_join(F.slice(x, p["at"], p["n"]), ""))
        pieces = names.withColumn("_id", key("_text")).hint("merge").join(places, "_id").select("_text", F.explode(F.array_distinct(F.flatten(F.transform(F.array(letters), cut)))).alias("_part"))
        # Pieces that run over a text's end are shorter than the part and equal to none that isn't found by its own length.
        pairs = pairs.unionByName(pieces.join(wanted.hint("merge"), "_part").select("_text", "_part"))
    return texts.hint("merge").join(pairs, F.col(text) == F.col("_text")).drop("_text").withColumnRenamed("_part", part)


def key(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))
