"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of the words to take; shares above the allowed number of epochs are cut there and the
excess is dealt to the other sources by weight. A source first takes its documents in complete epochs. What is left
of its target is filled by weighted sampling without replacement: documents are ordered by the exponential key
-ln(u) / quality, u coming from a hash of the id, and taken while the running sum of their sizes fits; the document
at the edge is taken in part, so that a source takes its target to the word.

The running sum is not made in one task per source: keys are binned on a logarithmic scale, the bins' sums find the
bin with the edge, and only that bin's rows are ordered. A row's share then follows from the row and its source's
edge alone.

Cases: a null or empty text has size 0 and takes 0 words. A null source is a source of its own, ordered last. Null
ids sort before others and share their u. Repeated rows have equal keys; if the edge falls on such a tie, the rows of
the tie share what is left by size. An empty table gives an empty result. Other columns are ignored by `plan_mix` and
carried by `mix`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import GAP, few, fresh, settle, words

WEIGHTS, SHARE, EPOCHS, LEAST_QUALITY = (3, 1, 2), 1.5, 2, 0.05
#: Bins of sampling keys for each factor of e.
BINS = 512


def letter_share(text: Column) -> Column:
    """Quality weight of a text: its share of letters, at least LEAST_QUALITY."""
    share = F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]+", "")), F.length(text))
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(share, F.lit(0.0)))


def sampling_key(id_: Column, quality: Column, seed: int) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / quality


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, from rows (source, size). There is one row per source in it from here on.

    Sources in order of size by weight are capped while their cap is below their part of what is left.
    """
    per = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    listed = per.withColumn("nth", F.row_number().over(by_name) - 1)
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    totals = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total")).first()["total"]
    all_weights = listed.agg(F.coalesce(F.sum("weight"), F.lit(1)).alias("w")).first()["w"]
    take = F.lit(share * totals)
    level = (take - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.lit(all_weights) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    judged = settle(listed.withColumn("capped", F.col("ratio") < level))
    done = judged.where("capped").agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("c"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    rest = (share * totals - done["c"]) / max(1, all_weights - done["w"])
    return settle(judged.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.lit(rest) * F.col("weight")).alias("target")))


def edges(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source: complete epochs, and the key and id up to which the fraction is taken.

    rows: id, source, size, key, settled. Columns: source, source_size, target, epochs, edge (key, id; null if no
    fraction is due), tie_size, left (words for the rows at the edge).
    """
    budget = F.floor("target")
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0)))
    plan = plan.withColumn("fraction", budget - F.col("epochs") * F.col("source_size"))
    binned = rows.where("size > 0").withColumn("bin", F.floor(F.log("key") * BINS))
    sums = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("after", F.sum("words").over(upto)).withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    crossing = settle(sums.join(few(settle(plan)), same).where("fraction > after - words and fraction <= after").select("of", "bin", (F.col("fraction") - F.col("after") + F.col("words")).alias("due")))
    inside = binned.join(few(crossing).withColumnRenamed("bin", "edge_bin"), same & (F.col("bin") == F.col("edge_bin")))
    ties = inside.groupBy("of", "due", "key", "id").agg(F.sum("size").alias("tie_size"))
    run = F.sum("tie_size").over(Window.partitionBy("of").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
    found = ties.withColumn("run", run).where("due > run - tie_size and due <= run")
    found = found.select("of", F.struct("key", "id").alias("edge"), "tie_size", (F.col("due") - F.col("run") + F.col("tie_size")).alias("left"))
    return settle(plan.join(found, same, "left").drop("of"))


def _taken(size: Column, key: Column, id_: Column) -> Column:
    at = F.struct(key.alias("key"), id_.alias("id"))
    part = F.when(F.col("edge").isNull(), F.lit(0)).when(at < F.col("edge"), size).when(at == F.col("edge"), F.floor(F.col("left") * size / F.greatest(F.col("tie_size"), F.lit(1)))).otherwise(F.lit(0))
    return (F.col("epochs") * size + part).cast("long")


def _rows(df: DataFrame, id_col: str, source_col: str, text_col: str, quality: Column | None, seed: int) -> DataFrame:
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(text).alias("size"), sampling_key(F.col(id_col), letter_share(text) if quality is None else quality, seed).alias("key"))


def plan_mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", quality: Column | None = None, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """One row per row of df: id, size, source_size, target, taken."""
    rows = settle(_rows(df, id_col, source_col, text_col, quality, seed))
    plan = edges(rows, source_targets(rows, weights, share, epochs)).withColumnRenamed("source", "of")
    out = rows.join(few(plan), F.col("source").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(F.col("size"), F.col("key"), F.col("id")).alias("taken"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_chars_col: str | None = "n_chars", quality: Column | None = None, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """The mixed corpus: df's columns, a row for each time a document is taken; what is taken in part is cut to its first words, joined by one space. Texts are not shuffled."""
    rows = settle(_rows(df, id_col, source_col, text_col, quality, seed))
    plan = edges(rows, source_targets(rows, weights, share, epochs))
    size, key, of, nth = fresh(df, "size", "key", "of", "nth")
    taken = fresh(df, "taken")[0]
    inner = ["source_size", "target", "epochs", "fraction", "edge", "tie_size", "left"]
    text = F.col(text_col)
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(source_col).alias(of), words(text).alias(size), sampling_key(F.col(id_col), letter_share(text) if quality is None else quality, seed).alias(key), F.col(id_col).alias(nth))
    joined = keyed.join(few(plan), F.col(of).eqNullSafe(F.col("source"))).withColumn(taken, _taken(F.col(size), F.col(key), F.col(nth))).drop(*inner, "source")
    due = joined.where(F.col(taken) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    part = F.col(taken) - (F.col(nth) - 1) * F.col(size)
    cut = F.array_join(F.slice(F.filter(F.split(F.col(f"doc.{text_col}"), GAP), lambda w: w != ""), F.lit(1), part.cast("int")), " ")
    out = due.withColumn(of, F.when(part >= F.col(size), F.col(f"doc.{text_col}")).otherwise(cut))
    fields = {text_col: F.col(of)} | ({n_chars_col: F.length(of).cast(df.schema[n_chars_col].dataType)} if n_chars_col in df.columns else {})
    return out.select(*[fields.get(c, F.col(f"doc.`{c}`")).alias(c) for c in df.columns])
