"""Where answers land without a retriever: covered, split, absent, not parsed; and the ladder of matchers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import once
from ..functions.matching import found_in
from ..functions.text import longest_common_each, longest_common_substring, normalize_for_match, numeric_form, strip, token_recall, tokens

#: Fixed thresholds of the token and substring rungs.
TOKEN_RECALL, SUBSTRING = 0.90, 0.80


#: Stands between the chunks of a page where they are searched as one text; no normalised span has it.
BETWEEN = "\x01"


#: Questions of one page that one row takes; a page with more has more rows.
PACK = 4096


def per_page(qa: DataFrame, forms: DataFrame, ask: dict[str, Column], answers: Callable[[], Column], missing: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """``qa`` with ``answer``: what ``answers()`` gives for the questions of a page, an array beside the array ``asks``.

    ``forms`` has a row for each page (or more): page_id, what is computed of a text once, and ``keep``, columns that go along. ``ask`` names what is
    computed of a question. Questions come to their page's row in packs, so a text is there once for up to ``PACK`` of them, whatever their number, and
    where the packs are small enough for Spark to broadcast, no text crosses an exchange. A question whose page is missing has ``missing``.
    """
    keyed = qa.select("page_id", F.struct(*qa.columns).alias("q"), F.struct(*(c.alias(n) for n, c in ask.items())).alias("a"))
    many = qa.groupBy("page_id").agg(F.ceil(F.count("*") / PACK).cast("int").alias("_packs")).where("_packs > 1")
    keyed = keyed.join(many, "page_id", "left").withColumn("_pack", F.pmod(F.xxhash64("q"), F.coalesce("_packs", F.lit(1))))
    packs = keyed.groupBy("page_id", "_pack").agg(F.collect_list(F.struct("q", "a")).alias("_rows"))
    packs = packs.select("page_id", F.transform("_rows", lambda r: r["q"]).alias("qs"), F.transform("_rows", lambda r: r["a"]).alias("asks"))
    found = forms.join(packs, "page_id").select(*keep, F.explode(F.arrays_zip(F.col("qs"), answers().alias("answer"))).alias("r"))
    found = found.select(*keep, "r.qs.*", F.col("r.answer").alias("answer"))
    lost = qa.join(forms.select("page_id").distinct(), "page_id", "left_anti")
    return found.unionByName(lost.select(*(F.lit(None).cast(dict(forms.dtypes)[c]).alias(c) for c in keep), *qa.columns, missing.alias("answer")))


def classify_pieces(qa: DataFrame, pages: DataFrame, pieces: Column, exact_unicode: bool = True) -> DataFrame:
    """``qa`` (page_id, answer_span, ...) with ``location``; ``pieces`` is an array of the chunks of each of ``pages``.

    Chunking, normalising and searching happen in the page's row, all its questions in one pass of the text. A null markdown or a
    missing page is no_parse; an empty or null span is absent.
    """
    norm = lambda c: normalize_for_match(c, exact_unicode)
    texts = pages.select("page_id", norm(F.col("markdown")).alias("_page"), norm(F.array_join(pieces, BETWEEN)).alias("_chunks"), F.col("markdown").isNotNull().alias("_parsed"))

    def places() -> Column:
        spans = F.transform("asks", lambda a: a["span"])
        both = F.zip_with(found_in(F.col("_chunks"), spans), found_in(F.col("_page"), spans), lambda c, p: F.when(c, "covered").when(p, "split").otherwise("absent"))
        return F.zip_with(spans, both, lambda s, x: F.when(~F.col("_parsed"), "no_parse").when(s == "", "absent").otherwise(x))

    span = F.coalesce(F.replace(norm(F.col("answer_span")), F.lit(BETWEEN), F.lit("")), F.lit(""))
    return per_page(qa, texts, {"span": span}, places, F.lit("no_parse")).withColumnRenamed("answer", "location")


def classify(qa: DataFrame, pages: DataFrame, chunks: DataFrame, exact_unicode: bool = True) -> DataFrame:
    """As ``classify_pieces``, of a stored table of chunks (page_id, text): a page's chunks meet in its row."""
    own = chunks.groupBy("page_id").agg(F.collect_list("text").alias("_pieces"))
    return classify_pieces(qa, pages.join(own, "page_id", "left"), F.coalesce("_pieces", F.array().cast("array<string>")), exact_unicode)


def tally(located: DataFrame, dimensions: tuple[str, ...] = ("question_type", "difficulty")) -> DataFrame:
    """Counts over grouping sets: all, and each dimension alone. (dimension, level, location, n)"""
    sets = located.groupingSets([["location"], *(["location", d] for d in dimensions)], "location", *dimensions).agg(F.count("*").alias("n"), *(F.grouping(d).alias(f"_{d}") for d in dimensions))
    dimension, level = F.lit("all"), F.lit("all")
    for d in dimensions:
        dimension = F.when(F.col(f"_{d}") == 0, d).otherwise(dimension)
        level = F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")).otherwise(level)
    return sets.select(dimension.alias("dimension"), level.alias("level"), "location", "n")


def rates(located: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    share = lambda *names: F.coalesce(F.avg(F.col("location").isin(*names).cast("double")), F.lit(0.0))
    return located.groupBy(*by).agg(F.count("*").alias("total"), share("covered").alias("coverage"), share("split").alias("split_rate"), share("absent", "no_parse").alias("parser_fault"))


def examples(located: DataFrame, order: str, first: int = 5) -> DataFrame:
    w = Window.partitionBy("location").orderBy(order)
    return located.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= first)


def l0(answer: Column, page: Column) -> Column:
    a = strip(answer)
    return (a != "") & F.contains(page, a)


def l1(answer: Column, page: Column, exact_unicode: bool = True) -> Column:
    a, p = normalize_for_match(answer, exact_unicode), normalize_for_match(page, exact_unicode)
    return (a != "") & F.contains(p, a)


def l2(answer: Column, page: Column, exact_unicode: bool = True) -> Column:
    a, p = (numeric_form(normalize_for_match(c, exact_unicode)) for c in (answer, page))
    return (a != "") & F.contains(p, a)


def l3(answer: Column, page: Column, exact_unicode: bool = True, least: float = TOKEN_RECALL) -> Column:
    if exact_unicode:
        return token_recall(answer, page) >= least

    def recalled(a: Column, p: Column) -> Column:
        hits = F.size(F.filter(a, lambda t: F.array_contains(p, t)))
        return F.when(F.size(a) == 0, False).otherwise(hits / F.greatest(F.size(a), F.lit(1)) >= least)

    return once(tokens(answer, False), lambda a: once(F.array_distinct(tokens(page, False)), lambda p: recalled(a, p)))


def l4(answer: Column, page: Column, least: float = SUBSTRING) -> Column:
    a, p = normalize_for_match(answer), normalize_for_match(page)
    return F.when(a == "", False).otherwise(longest_common_substring(a, p) / F.length(a) >= least)


#: Matchers by name, strict to permissive.
LADDER = {"L0_exact": l0, "L1_normalized": l1, "L2_numeric": l2, "L3_token_recall": l3, "L4_fuzzy_lcs": l4}


def present(qa: DataFrame, pages: DataFrame, rungs: tuple[str, ...] = tuple(LADDER), exact_unicode: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """``qa`` with ``answer``, a struct of a boolean for each rung: whether the answer is on its page. A page's forms (normalised, numeric, its
    tokens) are computed once for all its questions; what no rung asks for is not computed."""
    exact = {r: exact_unicode for r in rungs} | {"L4_fuzzy_lcs": True}
    wants = lambda *names: any(r in rungs for r in names)
    norms = sorted({exact[r] for r in ("L1_normalized", "L2_numeric", "L4_fuzzy_lcs") if r in rungs})
    forms = pages.select("page_id", *within, "markdown", *(normalize_for_match(F.col("markdown"), e).alias(f"_norm_{e}") for e in norms))
    answer = F.col("answer_span")
    ask = {"plain": strip(answer)} | {f"norm_{e}": normalize_for_match(answer, e) for e in norms}
    if wants("L2_numeric"):
        forms = forms.withColumn("_numeric", numeric_form(F.col(f"_norm_{exact_unicode}")))
        ask["numeric"] = numeric_form(normalize_for_match(answer, exact_unicode))
    if wants("L3_token_recall"):
        forms = forms.withColumn("_tokens", F.array_distinct(tokens(F.col("markdown"), exact_unicode)))
        ask["tokens"] = tokens(answer, exact_unicode)

    def inside(name: str, text: str) -> Column:
        spans = F.transform("asks", lambda a: F.coalesce(a[name], F.lit("")))
        return F.zip_with(spans, found_in(F.col(text), spans), lambda s, x: (s != "") & x)

    def recalled() -> Column:
        share = lambda t: F.size(F.filter(t, lambda x: F.array_contains("_tokens", x))) / F.greatest(F.size(t), F.lit(1))
        return F.transform("asks", lambda a: F.coalesce((F.size(a["tokens"]) > 0) & (share(a["tokens"]) >= TOKEN_RECALL), F.lit(False)))

    def overlaps() -> Column:
        spans = F.transform("asks", lambda a: F.coalesce(a["norm_True"], F.lit("")))
        return F.zip_with(spans, F.coalesce(longest_common_each(F.col("_norm_True"), spans), F.array().cast("array<int>")), lambda s, n: (s != "") & (F.coalesce(n, F.lit(0)) / F.greatest(F.length(s), F.lit(1)) >= SUBSTRING))

    made = {"L0_exact": lambda: inside("plain", "markdown"), "L1_normalized": lambda: inside(f"norm_{exact_unicode}", f"_norm_{exact_unicode}"), "L2_numeric": lambda: inside("numeric", "_numeric"), "L3_token_recall": recalled, "L4_fuzzy_lcs": overlaps}
    flags = lambda: F.arrays_zip(*(made[r]().alias(r) for r in rungs))
    return per_page(qa, forms, ask, flags, F.struct(*(F.lit(False).alias(r) for r in rungs)), within)


def absent_rates(qa: DataFrame, pages: DataFrame, rungs: tuple[str, ...] = tuple(LADDER), by: str = "question_type", exact_unicode: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """(*within, rung, level, n, absent): the share without the answer on its page, for all and by a dimension. A page that is
    not parsed is absent everywhere. ``within`` names columns of the pages (a parser) that have rates of their own."""
    rows = present(qa.select("page_id", "answer_span", by), pages, rungs, exact_unicode, within)
    long = rows.select(*within, F.col(by).cast("string").alias("level"), F.explode(F.array(*(F.struct(F.lit(r).alias("rung"), F.col(f"answer.{r}").alias("present")) for r in rungs))).alias("x"))
    sets = long.select(*within, "level", "x.*").groupingSets([[*within, "rung"], [*within, "rung", "level"]], *within, "rung", "level")
    counts = sets.agg(F.count("*").alias("n"), F.avg((~F.col("present")).cast("double")).alias("absent"), F.grouping("level").alias("g"))
    return counts.select(*within, "rung", F.when(F.col("g") == 1, "all").otherwise(F.col("level")).alias("level"), "n", "absent")


def answerable(qa: DataFrame, pages: DataFrame, stop: tuple[str, ...] = (), least: int = 2) -> DataFrame:
    """Rows whose span has ``least`` normalised characters, is no stop answer and is on its page."""
    rows = qa.join(pages.select("page_id", "markdown"), "page_id")
    span = normalize_for_match(F.col("answer_span"))
    return rows.where((F.length(span) >= least) & ~F.lower(strip(F.col("answer_span"))).isin(*stop) & F.contains(normalize_for_match(F.col("markdown")), span)).drop("markdown")


def validate(question: Column, span: Column, chunk: Column, page: Column, question_range: tuple[int, int] = (5, 200), span_range: tuple[int, int] = (1, 100)) -> Column:
    """STRUCT(ok, reason): the first rule that fails."""
    reason = (
        F.when(~F.contains(page, span), "span not in page")
        .when(~F.length(question).between(*question_range), "question length")
        .when(~F.length(span).between(*span_range), "span length")
        .when(chunk.isNull() | ~F.contains(chunk, span), "no chunk")
    )
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("ok")).alias("reason"))
