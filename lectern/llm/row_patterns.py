"""Zigzags in the ordered rows of each client: ``A (D+ U+)+ P?`` by encoded suffixes and regular expressions.

Rows are dealt out by ranges of (client, time, id), so that a client of any size is spread over many tasks; what
happens at a range's edge is mended by tables that have a row for each range and client. A row that is neither lower nor
higher than the one before it (in time, and of a kind that counts) begins a *segment*; a match lies in one segment but for its
last ``P``, which may be the row after it. A segment becomes one row with an array, and ``transform`` encodes, for each start,
the rest of the segment: ``d`` and ``u``, upper-case where the row is also a ``P`` by the start's threshold. One regular expression over
that string gives the length and the letters. Its quantifiers are possessive, which changes no match (no letter is
both ``d`` and ``u``, and ``P?`` matches everywhere) and needs no stack, however long the segment.

All of it are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import once
from .common import Scratch

#: Starts of a segment that one row of work has; a longer segment is dealt to several.
STARTS = 1024
PATTERN = "^((?:[dD]++[uU]++)++)([DN]?)"


def cents(value: Column) -> Column:
    """floor(100 v + 0.5) as a long; null for null, NaN and infinite values."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < 9e16), F.floor(100 * v + 0.5))


def _equal_rows(columns: list[str]) -> list[Column]:
    """128 bits that equal rows share. Which columns are null counts, too."""
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    return [F.xxhash64(nulls, *columns).alias("e1"), F.xxhash64(F.lit(1), *reversed(columns), nulls).alias("e2")]


def _pieces(ordered: DataFrame, gap: Column, barred: str, last: str) -> DataFrame:
    """(pid, client, ls, rows, ...): the segments inside each range and client, as far as that range shows."""
    own = Window.partitionBy("pid", "client")
    order = own.orderBy("ts", "id", "cents", "kind", "e1", "e2")
    same = F.coalesce((F.col("e1") == F.lag("e1").over(order)) & (F.col("e2") == F.lag("e2").over(order)) & F.lag("id").over(order).eqNullSafe(F.col("id")) & (F.lag("ts").over(order) == F.col("ts")), F.lit(False))
    rows = ordered.withColumn("same", same).where(~F.col("same")).drop("same", "e1", "e2")
    order = own.orderBy("ts", "id", "cents", "kind")
    rows = rows.withColumns({"pts": F.lag("ts").over(order), "pc": F.lag("cents").over(order), "rn": F.row_number().over(order)})
    rows = rows.withColumn("c", _letter(F.col("ts"), F.col("cents"), F.col("kind"), F.col("pts"), F.col("pc"), gap, barred))
    rows = rows.withColumn("ls", F.sum(F.when((F.col("c") == "n") & (F.col("rn") > 1), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.coalesce(F.col("ts") - F.col("pts") <= gap, F.lit(False)) & F.coalesce(F.col("kind") == last, F.lit(False)) & F.col("cents").isNotNull()
    item = F.struct("id", "cents", "c", near.alias("p"))
    grouped = rows.groupBy("pid", "client", "ls").agg(
        F.sort_array(F.collect_list(F.struct("rn", item.alias("x")))).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.when(F.col("rn") == 1, F.coalesce("kind", F.lit("")))).alias("kind"),
    )
    by = own.orderBy("ls")
    head = F.lead(F.col("rows")[0]["x"]).over(by)
    return grouped.select(
        "pid", "client", "ls", F.col("rows")[0]["rn"].alias("rn"), F.transform("rows", lambda r: r["x"]).alias("rows"), F.when(head["p"], head).alias("tail"), "first_ts", "last_ts", "kind",
        F.lead("ls").over(by).isNull().alias("ends"),
    )


def _letter(ts: Column, value: Column, kind: Column, pts: Column, before: Column, gap: Column, barred: str) -> Column:
    """``d``, ``u`` or ``n`` of a row after another."""
    counts = F.coalesce((ts - pts <= gap) & (kind != barred), F.lit(False))
    return F.when(counts & (value < before), "d").when(counts & (value > before), "u").otherwise("n")


def _edges(pieces: DataFrame, gap: Column, barred: str, last: str) -> DataFrame:
    """(pid, client, ls, ...) of pieces at ranges' edges that change: into which piece they go on, as which letter, or the row after them."""
    first = F.col("ls") == 0
    ends = pieces.where(first | F.col("ends")).select(
        "pid", "client", F.when(F.col("ends"), F.col("ls")).alias("last_ls"), F.when(first, F.col("rows")[0]).alias("head"), F.when(first, F.col("first_ts")).alias("head_ts"), F.when(first, F.col("kind")).alias("kind"),
        F.when(F.col("ends"), F.element_at("rows", -1)["cents"]).alias("cents"), F.when(F.col("ends"), F.col("last_ts")).alias("ts"),
    )
    # Rows of one client are few here: two for each range that has the client, at most.
    groups = ends.repartition("client").groupBy("client", "pid").agg(*(F.max(c).alias(c) for c in ("last_ls", "head", "head_ts", "kind", "cents", "ts")))
    by = Window.partitionBy("client").orderBy("pid")
    letter = _letter(F.col("head_ts"), F.col("head.cents"), F.when(F.col("kind") != "", F.col("kind")), F.lag("ts").over(by), F.lag("cents").over(by), gap, barred)
    groups = groups.withColumns({"letter": letter, "near": F.coalesce(F.col("head_ts") - F.lag("ts").over(by) <= gap, F.lit(False)), "ppid": F.lag("pid").over(by), "pls": F.lag("last_ls").over(by)})
    # The piece in which each range's last segment began.
    begun = F.when((F.col("last_ls") > 0) | (F.col("letter") == "n"), F.struct("pid", F.col("last_ls").alias("ls")))
    target = F.last(begun, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("target", target).where("ppid is not null")
    peak = F.col("near") & (F.col("kind") == last) & F.col("head.cents").isNotNull()
    joined = groups.where("letter <> 'n'").select("pid", "client", F.lit(0).cast("long").alias("ls"), F.col("target.pid").alias("to_pid"), F.col("target.ls").alias("to_ls"), "letter", peak.alias("peak"), F.lit(None).cast("struct<id:bigint,cents:bigint,c:string,p:boolean>").alias("after"))
    head = F.struct(F.col("head.id").alias("id"), F.col("head.cents").alias("cents"), F.lit("n").alias("c"), F.lit(True).alias("p"))
    follows = groups.where((F.col("letter") == "n") & peak).select(F.col("ppid").alias("pid"), "client", F.col("pls").alias("ls"), F.lit(None).cast("int").alias("to_pid"), F.lit(None).cast("long").alias("to_ls"), F.lit(None).cast("string").alias("letter"), F.lit(None).cast("boolean").alias("peak"), head.alias("after"))
    # One piece may do both: be the end of one segment across ranges, and have a row after it.
    return joined.unionByName(follows).groupBy("pid", "client", "ls").agg(*(F.max(c).alias(c) for c in ("to_pid", "to_ls", "letter", "peak", "after")))


def _segments(pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """(client, pid, ls, parts, tail): whole segments of three rows or more; ``parts`` says from which range each piece is."""
    open_ = (F.col("ls") == 0) | F.col("ends")
    rows = pieces.where(open_ | (F.size("rows") >= 3)).join(edges, ["pid", "client", "ls"], "left")
    mended = F.transform("rows", lambda x, i: F.when((i == 0) & F.col("letter").isNotNull(), F.struct(x["id"].alias("id"), x["cents"].alias("cents"), F.col("letter").alias("c"), F.col("peak").alias("p"))).otherwise(x))
    rows = rows.select(
        "client", F.coalesce("to_pid", "pid").alias("to_pid"), F.coalesce("to_ls", "ls").alias("to_ls"),
        F.struct("pid", "rn", mended.alias("rows")).alias("part"), F.when(F.coalesce(F.col("after"), F.col("tail")).isNotNull(), F.struct("pid", F.coalesce("after", "tail").alias("x"))).alias("tail"),
    )
    return rows.groupBy("client", "to_pid", "to_ls").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.max("tail").alias("tail"))


def _matches(segments: DataFrame) -> DataFrame:
    """(client, pid, rn, first_id, last_id, n_rows, sum_cents, labels) of the starts in [from, to] of each row of work."""
    # Each item knows its range and its number in it, by which matches are numbered later.
    flat = F.flatten(F.transform("parts", lambda p: F.transform(p["rows"], lambda x, i: F.struct(p["pid"].alias("pid"), (p["rn"] + i).alias("rn"), x["id"].alias("id"), x["cents"].alias("cents"), x["c"].alias("c"), x["p"].alias("p")))))
    tail = F.when(F.col("tail").isNotNull(), F.array(F.struct(F.lit(0).alias("pid"), F.lit(0).alias("rn"), F.col("tail.x.id").alias("id"), F.col("tail.x.cents").alias("cents"), F.lit("n").alias("c"), F.lit(True).alias("p"))))
    rows = segments.select("client", "from", "to", F.concat(flat, F.coalesce(tail, F.array().cast("array<struct<pid:int,rn:int,id:bigint,cents:bigint,c:string,p:boolean>>"))).alias("rows"))
    rows = rows.withColumn("last_u", F.expr("aggregate(transform(rows, (x, i) -> if(x.c = 'u', i + 1, 0)), 0, (a, x) -> greatest(a, x))"))
    # A start is a row with a lower one after it and a higher one after that.
    starts = F.expr("filter(sequence(`from`, least(`to`, last_u - 2)), i -> i > 0 and element_at(rows, i + 1).c = 'd' and element_at(rows, i).cents is not null)")
    rows = rows.where("last_u >= 3 and last_u - 2 >= `from`").withColumn("starts", starts)

    def one(i: Column) -> Column:
        rest = F.slice(F.col("rows"), i + 1, F.size("rows") - i)
        code = once(F.element_at("rows", i)["cents"], lambda a: F.array_join(F.transform(rest, lambda x: F.when(x["p"] & (x["cents"] >= a), F.upper(x["c"])).otherwise(x["c"])), ""))
        found = once(code, lambda s: F.struct(F.upper(F.regexp_extract(s, PATTERN, 1)).alias("zigzag"), F.when(F.regexp_extract(s, PATTERN, 2) != "", "P").otherwise("").alias("peak")))
        labels = once(found, lambda f: F.concat(F.lit("A"), f["zigzag"], f["peak"]))

        def match(x: Column) -> Column:
            n = F.length(x)
            total = F.aggregate(F.slice(F.col("rows"), i, n), F.lit(0).cast("long"), lambda a, r: a + r["cents"])
            start = F.element_at("rows", i)
            return F.struct(start["pid"].alias("pid"), start["rn"].alias("rn"), start["id"].alias("first_id"), F.element_at("rows", i + n - 1)["id"].alias("last_id"), n.cast("long").alias("n_rows"), total.alias("sum_cents"), x.alias("labels"))

        return once(labels, match)

    return rows.select("client", F.explode(F.transform("starts", one)).alias("m")).select("client", "m.*")


def zigzags(df: DataFrame, client: str = "client_id", ts: str = "ts", id_col: str = "click_id", value: str = "value", kind: str = "kind", gap: str = "30 minutes", barred: str = "error", last: str = "click") -> DataFrame:
    """(client, match_no, first_id, last_id, n_rows, sum_cents, labels): every match of ``A (D+ U+)+ P?`` over consecutive rows.

    Rows of a client are ordered by time and id (nulls first), equal ones of those by value and kind; rows that are equal in all
    columns are one, rows without client or time are left out. ``A`` fits every row with a value; ``D`` and ``U`` need one below and above that
    of the row before, and a kind that is known and not ``barred``; ``P`` needs the kind ``last`` and at least the value of ``A``; all
    but ``A`` come within ``gap`` of the row before. A null, NaN or infinite value fits no letter. Each row of a
    client is tried as a start, so matches overlap; they are numbered by their first rows. Columns that are not named
    only tell rows apart. Ids are cast to long. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "zigzags")
    wait = F.expr(f"INTERVAL {gap}").cast("interval day to second")
    rows = df.where(F.col(client).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(client).alias("client"), F.col(ts).alias("ts"), F.col(id_col).cast("long").alias("id"), cents(F.col(value)).alias("cents"), F.col(kind).cast("string").alias("kind"), *_equal_rows(df.columns),
    )
    ordered = scratch.stage(rows.repartitionByRange("client", "ts", "id").withColumn("pid", F.spark_partition_id()), "ordered")
    pieces = scratch.stage(_pieces(ordered, wait, barred, last), "pieces")
    scratch.drop(ordered)
    whole = _segments(pieces, _edges(pieces, wait, barred, last)).withColumn("n", F.aggregate("parts", F.lit(0), lambda a, p: a + F.size(p["rows"])))
    segments = scratch.stage(whole.where("n >= 3"), "segments")
    scratch.drop(pieces)
    short = segments.where(F.col("n") <= STARTS).withColumns({"from": F.lit(1), "to": F.col("n")})
    dealt = segments.where(F.col("n") > STARTS).withColumn("from", F.explode(F.expr(f"sequence(1, n, {STARTS})"))).withColumn("to", F.col("from") + STARTS - 1).repartition("client", "to_pid", "to_ls", "from")
    matches = scratch.stage(_matches(short.unionByName(dealt)), "matches")
    scratch.drop(segments)
    # Numbers: inside each range, after those of earlier ranges. A client has a row for each range here.
    counts = matches.groupBy("client", "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("client").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.withColumn("before", before).where("before > 0").select("client", "pid", "before")
    number = F.row_number().over(Window.partitionBy("pid", "client").orderBy("rn"))
    out = matches.withColumn("no", number).join(earlier, ["client", "pid"], "left")
    return out.select(F.col("client").alias(client), (F.col("no") + F.coalesce("before", F.lit(0))).alias("match_no"), "first_id", "last_id", "n_rows", "sum_cents", "labels")
