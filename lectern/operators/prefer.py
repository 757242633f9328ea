"""Preference data: merging, choosing and pairing candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(rows: DataFrame, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The first row of each key by ``order`` (a source ordinal, then an arrival number)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_places(rows: DataFrame, keys: tuple[str, ...], order: str, out: str = "first") -> DataFrame:
    """Distinct keys with the least ``order`` of each: sorted by it, they are in the order in which they first came."""
    return rows.groupBy(*keys).agg(F.min(order).alias(out))


def keep_last(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key, by a pre-aggregated maximum: a hot key does not gather."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("_o"), *rest)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(rows.columns)


def best_and_worst(scored: DataFrame, gap: float, page: str = "page_id", item: str = "candidate_idx", score: str = "score", ascending: bool = False) -> DataFrame:
    """(page, chosen, rejected, chosen_score, rejected_score, gap) of pages with two candidates or more and a wide enough gap.

    Ties: the first arrival (least item) is best, the last is worst. ``ascending``: small scores are good.
    """
    good = -F.col(score) if ascending else F.col(score)
    best = F.max_by(F.struct(F.col(item).alias("i"), F.col(score).alias("s")), F.struct(good.alias("g"), (-F.col(item)).alias("n")))
    worst = F.min_by(F.struct(F.col(item).alias("i"), F.col(score).alias("s")), F.struct(good.alias("g"), (-F.col(item)).alias("n")))
    rows = scored.where(F.col(score).isNotNull()).groupBy(page).agg(best.alias("b"), worst.alias("w"), F.count("*").alias("n"))
    out = rows.select(page, F.col("b.i").alias("chosen"), F.col("w.i").alias("rejected"), F.col("b.s").alias("chosen_score"), F.col("w.s").alias("rejected_score"), F.abs(F.col("b.s") - F.col("w.s")).alias("gap"), "n")
    return out.where((F.col("n") >= 2) & (F.col("gap") >= gap)).drop("n")


def representative(candidates: DataFrame, page: str = "page_id", item: str = "candidate_idx") -> DataFrame:
    """Candidate 0 of each page, else the first."""
    return candidates.groupBy(page).agg(F.min_by(item, F.struct((F.col(item) != 0).cast("int"), F.col(item))).alias(item))


def hard_negatives(similar: DataFrame, n: int, page: str = "page_id", item: str = "chunk_id") -> DataFrame:
    """The ``n`` items most similar to any query of a page: similar(page, item, sim), other pages' items only."""
    best = similar.groupBy(page, item).agg(F.round(F.max("sim"), 6).alias("sim"))
    w = Window.partitionBy(page).orderBy(F.desc("sim"), item)
    return best.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)


def distractors(pages: DataFrame, chunks: DataFrame, n: int, seed: int = 42, key: Column | None = None, candidates: int = 4) -> DataFrame:
    """``n`` chunks of other pages for each page, or all of them where there are fewer, by a seeded order that any run repeats.

    Chunks stand on a ring by hash; a page takes the next ones from its own place. No page meets all chunks: ring cells of
    about ``n`` chunks are gathered in arcs of ``candidates`` cells, and a page takes from the arc that begins at its cell.
    A page that owns too much of its arc is joined with as many cells as have ``n`` chunks besides its own.
    """
    total = chunks.count()
    cells = max(1, total // max(n, 1))
    width = min(candidates, cells)
    place = lambda c: F.md5(F.concat(c.cast("string"), F.lit(f"-{seed}")).cast("binary"))
    cell = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % cells
    steps = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("step")
    ring = chunks.select("chunk_id", F.col("page_id").alias("owner"), place(F.col("chunk_id")).alias("h")).withColumn("cell", cell(F.col("h")))
    starts = ring.select("cell", "h", "chunk_id", "owner", steps(F.lit(width).cast("long"))).withColumn("cell", (F.col("cell") - F.col("step") + cells) % cells)
    arcs = starts.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("step", "h", "chunk_id", "owner"))).alias("arc"))
    asks = pages.select("page_id", cell(place(F.col("page_id"))).alias("cell")).join(arcs, "cell", "left")
    pool = asks.select("page_id", "cell", F.slice(F.filter(F.coalesce("arc", F.array()), lambda c: c["owner"] != F.col("page_id")), 1, n).alias("pool"))
    whole = F.lit(width == cells) | (F.size("pool") >= n)
    out = pool.where(whole).select("page_id", F.posexplode("pool").alias("at", "c")).select("page_id", "c.chunk_id", (F.col("at") + 1).alias("rk"))
    if width == cells:
        return out
    few = pool.where(~whole).select("page_id", F.col("cell").alias("first"))
    owned = chunks.groupBy("page_id").agg(F.count("*").alias("owned"))
    need = few.join(owned, "page_id", "left").withColumn("need", F.coalesce("owned", F.lit(0)) + n)
    need = need.withColumn("span", F.least(F.lit(cells), 2 * F.ceil(F.col("need") / n) + 6 + 64 // n))
    sizes = ring.groupBy("cell").agg(F.count("*").alias("size"))
    near = need.select("page_id", "first", "need", "span", steps(F.col("span"))).withColumn("cell", (F.col("first") + F.col("step")) % cells)
    reach = near.join(sizes, "cell", "left").groupBy("page_id", "first", "need", "span").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("reach"))
    far = reach.select("page_id", "first", steps(F.when(F.col("reach") >= F.col("need"), F.col("span")).otherwise(F.lit(cells)))).withColumn("cell", (F.col("first") + F.col("step")) % cells)
    w = Window.partitionBy("page_id").orderBy("step", "h", "chunk_id")
    more = far.join(ring, "cell").where(F.col("owner") != F.col("page_id")).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)
    return out.unionByName(more.select("page_id", "chunk_id", "rk"))


def positives(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first chunk of its page that contains a query's span; null where none does."""
    hit = qa.select("qa_id", "page_id", "answer_span").join(chunks.select("page_id", "pos", "chunk_id", "text"), "page_id").where(F.contains("text", "answer_span"))
    first = hit.groupBy("qa_id").agg(F.min_by("chunk_id", "pos").alias("chunk_id"))
    return qa.select("qa_id", "page_id").join(first, "qa_id", "left")


def positives_in(qa: DataFrame, pages: DataFrame, pieces: Column, name: str) -> DataFrame:
    """As ``positives``, of pages and an array of their chunks: the first that contains the span, found in the page's row."""
    rows = qa.select("qa_id", "page_id", "answer_span").join(pages.select("page_id", pieces.alias("_pieces")), "page_id", "left")
    at = F.array_position(F.transform("_pieces", lambda p: F.contains(p, F.col("answer_span"))), True)
    return rows.select("qa_id", "page_id", F.when(at > 0, F.concat(F.col("page_id").cast("string"), F.lit(f"::{name}#"), (at - 1).cast("string"))).alias("chunk_id"))


def in_batch_negatives(anchors: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(qa_id, batch, chunk_id): the positives of the other anchors of a batch, never those of the same page. Anchors are dealt to
    batches of about ``size`` by a seeded hash, so a batch is bounded whatever the number of anchors."""
    batches = F.greatest(F.lit(1), F.ceil(F.lit(anchors.count() / size))).cast("long")
    dealt = anchors.where("chunk_id IS NOT NULL").withColumn("batch", F.pmod(F.xxhash64(F.col("qa_id").cast("string"), F.lit(seed)), batches))
    other = dealt.select("batch", F.col("page_id").alias("_page"), "chunk_id").distinct()
    return dealt.select("qa_id", "page_id", "batch").join(other, "batch").where(F.col("_page") != F.col("page_id")).select("qa_id", "batch", "chunk_id")


def sampled_negatives(anchors: DataFrame, items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` negatives of each anchor from its own page, never its positive, then repeated from the start where the page has
    too few: anchors(qa_id, page_id, chunk_id), items(page_id, chunk_id)."""
    own = anchors.join(items.withColumnRenamed("chunk_id", "other"), "page_id").where(F.col("other") != F.col("chunk_id"))
    place = F.md5(F.concat(F.lit(f"{seed}-"), F.col("qa_id").cast("string"), F.lit("-"), F.col("other")).cast("binary"))
    w = Window.partitionBy("qa_id").orderBy(place, "other")
    few = own.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n)
    got = few.groupBy("qa_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "other"))), lambda x: x["other"]).alias("pool"))
    slots = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("pool", i % F.size("pool"))))
    return got.select("qa_id", slots.alias("slot", "chunk_id"))
