"""Maximal repeated runs of lines, from the suffix array of the texts' line sequences (DataFrame functions only).

Ranks: suffixes are ordered by their first line, then by runs of twice the length, each from the pair of ranks before it, until no run of a
length occurs twice.  A suffix whose run is the only one of its kind leaves the rounds.  The rank tables are kept.

Common prefixes: suffixes of one rank at 2^k lines are an interval of the array.  Where it branches, between 2^k and 2^(k+1) lines, is found by
halving: members are told apart at the middle by the rank of what follows there; those that agree go on above it, and the first of each
run goes on below it.  As only first members go down, a step has at most twice as many rows as the array has branchings.  At width one an interval has its
exact common prefix, and for its members but the first this is the longest run that also starts earlier.

Maximal runs: an interval whose members all follow the same line extends to the left, so it is dropped as soon as that shows.  Of the rest, runs
that lie within another one of their text go.  What the maximal runs cover is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, running_sum, small, stored, text_or_empty, word_count

#: Lines of a run at least, or words of a run of one line.
LEAST, LONG = 2, 50
BUCKETS = 1024
#: A text is named by two hashes; the smallest doc_id that has it stands for it.
TEXT = ["th", "tg"]
#: A suffix: its text, the line that it starts at, the text's smallest doc_id, the line before it (a hash; null at the start).
SUFFIX = [*TEXT, "i", "doc", "before"]
RUNS = ["cuts", "n_runs", "longest"]
NONE = -(1 << 62)  # stands for a null id, before all others


def _in_order(column: str, most: int) -> Column:
    """Buckets that follow the order of numbers from 0 to most - 1."""
    return F.floor(F.col(column) / max(1, -(-most // BUCKETS))).cast("int")


def _groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, n, first (the first member: doc, i, th), wide (not all members follow the same line): groups of two or more."""
    wide = (F.count("before") < F.count(F.lit(1))) | (F.min("before") < F.max("before"))
    rows = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "i", "th")).alias("first"), wide.alias("wide"))
    return rows.filter("n > 1")


def _later() -> Column:
    """Whether a suffix comes after the first of its group, in order of doc_id and place."""
    return (F.col("doc") > F.col("first.doc")) | ((F.col("doc") == F.col("first.doc")) & (F.col("i") > F.col("first.i")))


def _sent(df: DataFrame, few: bool) -> DataFrame:
    """``df`` with a broadcast hint where its rows are known to be ``few``; else AQE settles the join."""
    return F.broadcast(df) if few else df


def _first_ranks(rows: DataFrame) -> DataFrame:
    """SUFFIX, rank, first, wide, many of suffixes whose line occurs twice or more.  Ranks follow the order of the lines' hashes: so many of them come before."""
    # order by h1 as an unsigned number: its upper bits make the bucket
    bucket = F.floor((F.shiftrightunsigned("h1", 1) / float(1 << 63)) * BUCKETS).cast("int")
    groups = stored(_groups(rows, ["h1", "h2"]), "lines-groups").withColumns({"__bucket": bucket, "__all": F.lit(0)})
    ranks = running_sum(groups, ["__all"], "__bucket", [F.col("h1"), F.col("h2")], "n", "rank", bounded=True)
    ranks = small(stored(ranks.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "rank", "first", "wide"), "lines-ranks"))
    return rows.join(ranks, (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))).select(*SUFFIX, "rank", "first", "wide", "many")


def _doubled(ranks: DataFrame, step: int, most: int, few: bool) -> DataFrame | None:
    """SUFFIX, rank, first, wide for runs of 2 ``step`` lines, from the pairs of ranks at i and i + step; None if no such run repeats."""
    ahead = ranks.select(*TEXT, (F.col("i") - step).alias("i"), F.col("rank").alias("b"))
    pairs = stored(ranks.select(*SUFFIX, F.col("rank").alias("a")).join(_sent(ahead, few), [*TEXT, "i"]), "lines-pairs")
    groups = stored(_groups(pairs, ["a", "b"]), "lines-groups")
    found = groups.count()
    if not found:
        return None
    # the suffixes of a rank have the places from it on to themselves, so they are only ordered among each other; what follows one
    # frequent line is spread over buckets
    made = running_sum(groups.withColumn("__bucket", _in_order("b", most)), ["a"], "__bucket", [F.col("b")], "n", "nth")
    made = made.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (F.col("a") + F.col("nth")).alias("rank"), "first", "wide")
    made = F.broadcast(made) if found <= BROADCAST_ROWS else made
    return pairs.join(made, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select(*SUFFIX, "rank", "first", "wide")


def _branching(parts: DataFrame, few: bool) -> DataFrame:
    """SUFFIX, lo, first: the members of intervals that have two or more, and not the same line before all."""
    keep = _groups(parts.withColumnRenamed("first", "_first"), ["lo", "_first"]).filter("wide").select(F.col("lo").alias("_lo"), "_first")
    return parts.join(_sent(keep, few), (F.col("lo") == F.col("_lo")) & (F.col("first") == F.col("_first")), "left_semi")


def _halved(parts: DataFrame, ranks: DataFrame, half: int, least: int, few: bool) -> DataFrame:
    """Intervals that branch between lo and lo + 2 ``half`` lines as such of half the width.  ``ranks``: of runs of ``half`` lines."""
    parts = parts.withColumn("at", F.col("i") + F.col("lo"))
    ahead = ranks.select(F.col("th").alias("_th"), F.col("tg").alias("_tg"), F.col("i").alias("_i"), F.col("rank").alias("b"))
    same = (F.col("th") == F.col("_th")) & (F.col("tg") == F.col("_tg")) & (F.col("at") == F.col("_i"))
    if not few and parts.count() <= BROADCAST_ROWS:
        ahead = ahead.join(F.broadcast(parts.select(*TEXT, "at")), same, "left_semi")
    told = stored(parts.join(_sent(ahead, few), same, "left").select(*SUFFIX, "lo", F.col("first").alias("top"), "b"), "lines-told")
    groups = _groups(told.filter("b is not null"), ["lo", "top", "b"]).select(F.col("lo").alias("_lo"), F.col("top").alias("_top"), F.col("b").alias("_b"), "first", "wide")
    rows = told.join(_sent(groups, few), (F.col("lo") == F.col("_lo")) & (F.col("top") == F.col("_top")) & (F.col("b") == F.col("_b")), "left")
    above = F.when(F.col("wide"), F.struct((F.col("lo") + half).alias("lo"), F.col("first")))
    below = F.when(F.coalesce(~_later(), F.lit(True)) & (F.col("lo") + half > least), F.struct("lo", F.col("top").alias("first")))
    rows = rows.select(*SUFFIX, F.explode(F.array(above, below)).alias("x")).filter("x is not null")
    return rows.select(*SUFFIX, "x.lo", "x.first")


def _intervals(tables: list[DataFrame], least: int, few: bool) -> DataFrame | None:
    """SUFFIX, lo, first: the members of all intervals of the array whose common prefix, ``lo`` lines, is ``least`` or more, that
    don't extend to the left; each member at the interval that it is not the first of, and at those that it is the first of.

    ``tables``: ranks of runs of 1, 2, 4, ... lines, ``few`` of them or not."""
    parts = None
    for k in reversed(range(len(tables))):
        if parts is not None:
            parts = _halved(parts, tables[k], 1 << k, least, few)
        if 2 << k > least:
            # those that branch before 2^(k+1) lines: of each run of that length the first member, and all without such a run
            begun = tables[k].filter("wide").select(*SUFFIX, F.lit(1 << k).alias("lo"), "first")
            if k + 1 < len(tables):
                begun = begun.join(_sent(tables[k + 1].filter(_later()).select(*TEXT, "i"), few), [*TEXT, "i"], "left_anti").select(*begun.columns)
            parts = begun if parts is None else parts.unionByName(begun)
        if parts is not None:
            parts = stored(_branching(stored(parts, "lines-parts"), few), "lines-intervals")
    return parts


def repeated_runs(docs: DataFrame, least: int = LEAST, long: int = LONG) -> DataFrame:
    """doc, th, tg, cuts, n_runs, longest: per document (doc_id, text) that loses lines the number of its maximal runs that also start earlier, the lines of the longest of
    them, and what they cover, an array of (from, upto) over its lines with a word, the end left out.  A text that a smaller doc_id has is a later copy as a whole."""
    text = F.col("text")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NONE)).alias("doc"), text_or_empty().alias("text"))
    rows = rows.select("doc", F.xxhash64(text).alias("th"), F.xxhash64(F.lit("second"), text).alias("tg"), "text")
    each = rows.withColumn("has", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    each = each.select("doc", *TEXT, F.explode(_numbered("has", long)).alias("x")).select("doc", *TEXT, "x.*")
    # copies of a text are one text, of its smallest doc_id
    lines = each.groupBy(*TEXT, "i", "h1", "h2").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.max("many").alias("many"), F.max("before").alias("before"))
    lines = stored(lines, "lines")
    most, tables = lines.count() + 1, [stored(_first_ranks(lines), "lines-1")]
    few = tables[0].count() <= BROADCAST_ROWS  # and so are the later tables, whose rows are some of these
    while (ranks := _doubled(tables[-1], 1 << (len(tables) - 1), most, few)) is not None:
        tables.append(stored(ranks, "lines-ranked"))
    later = tables[0].filter("many").filter(_later()).select(*TEXT, "i", (F.col("i") + 1).alias("upto"))
    found = _intervals(tables, least, few)
    if found is not None:
        later = later.unionByName(found.filter(_later()).select(*TEXT, "i", (F.col("i") + F.col("lo")).alias("upto")))
    # the first document of a text, and the copies: these go whole, or lose their lines of many words if they have too few lines
    texts = lines.groupBy(*TEXT).agg(F.min("doc").alias("doc"), F.max("last").alias("last"), F.count(F.lit(1)).alias("n"), F.max("many").alias("many"))
    own = texts.select("doc", *TEXT).join(_merged(later), TEXT)
    shared = texts.filter(F.col("last") > F.col("doc"))
    few = shared.filter((F.col("n") < least) & F.col("many"))
    few = lines.filter("many").select(*TEXT, "i", (F.col("i") + 1).alias("upto")).join(few.select(*TEXT, "doc"), TEXT)
    few = _merged(few).join(shared.select(*TEXT, "doc"), TEXT).select(*TEXT, "doc", *RUNS)
    n = F.col("n").cast("int")
    whole = shared.filter(F.col("n") >= least).select(*TEXT, "doc", F.array(F.struct(F.lit(0).alias("from"), n.alias("upto"))).alias("cuts"), F.lit(1).cast("bigint").alias("n_runs"), n.alias("longest"))
    copied = stored(whole.unionByName(few).select(F.col("th").alias("_th"), F.col("tg").alias("_tg"), F.col("doc").alias("first"), *RUNS), "lines-copied")
    copies = rows.select("doc", *TEXT).distinct().join(small(copied), (F.col("th") == F.col("_th")) & (F.col("tg") == F.col("_tg")) & (F.col("doc") > F.col("first")))
    return own.select("doc", *TEXT, *RUNS).unionByName(copies.select("doc", *TEXT, *RUNS))


def _merged(spans: DataFrame) -> DataFrame:
    """th, tg, cuts, n_runs, longest: of a text's spans (i, upto) those that lie in no other one, and what they cover, touching parts as one."""
    spans = spans.groupBy(*TEXT, "i").agg(F.max("upto").alias("upto"))
    by = Window.partitionBy(*TEXT).orderBy("i")
    spans = spans.withColumn("ahead", F.coalesce(F.max("upto").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    spans = spans.filter(F.col("upto") > F.col("ahead"))
    spans = spans.withColumn("cut", F.sum((F.col("i") > F.col("ahead")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*TEXT, "cut").agg(F.min("i").alias("from"), F.max("upto").alias("upto"), F.count(F.lit(1)).alias("n"), F.max(F.col("upto") - F.col("i")).alias("most"))
    return spans.groupBy(*TEXT).agg(F.sort_array(F.collect_list(F.struct("from", "upto"))).alias("cuts"), F.sum("n").alias("n_runs"), F.max("most").alias("longest"))


def _numbered(lines: str, long: int) -> Column:
    """Of an array of lines: i (their number), two hashes, whether they have ``long`` words or more, a hash of the line before."""
    many = lambda x: F.when(F.length(x) >= 2 * long - 1, word_count(x) >= long).otherwise(F.lit(long <= 1))
    before = lambda i: F.when(i > 0, F.xxhash64(F.get(F.col(lines), i - 1)))
    return F.transform(F.col(lines), lambda x, i: F.struct(
        i.alias("i"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"), many(x).alias("many"), before(i).alias("before")))


def dedup_lines(docs: DataFrame, least: int = LEAST, long: int = LONG) -> DataFrame:
    """Per document: doc_id, n_lines, n_deleted, n_runs, longest_run (lines), kept_text.

    A line goes if it lies in a run of ``least`` or more lines (those without a word aside), or is a line of ``long`` or more words, that
    also starts earlier, in order of doc_id and place; runs stay within a document and may overlap.  n_runs counts the maximal ones of such runs, those
    within no other of their document, and longest_run is the longest.  Lines without a word are never deleted.  Null text: one empty line, kept.  A null id comes before all others.  Rows equal in doc_id and text are
    one document and lose the same lines; different texts under one doc_id are compared by place.  An empty table gives an empty
    result.  Only doc_id and text are read."""
    # as many rows as documents that lose lines, so a shuffled join at every size
    gone = repeated_runs(docs, least, long).select(F.col("doc").alias("_doc"), *[F.col(x).alias(f"_{x}") for x in TEXT], *RUNS)
    gone = stored(gone, "lines-gone").hint("merge")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    same = ((F.coalesce(F.col("doc_id"), F.lit(NONE)) == F.col("_doc")) & (F.xxhash64("text") == F.col("_th"))
            & (F.xxhash64(F.lit("second"), F.col("text")) == F.col("_tg")))
    rows = rows.join(gone, same, "left").select("doc_id", "text", *RUNS).withColumn("lines", F.split("text", "\n"))
    numbers = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda j: F.get(F.col("lines"), j).rlike(r"[^ \t\n\x0B\f\r]"))
    cut = F.transform(F.array(numbers), lambda w: F.flatten(F.transform(F.col("cuts"), lambda r: F.slice(w, r["from"] + 1, r["upto"] - r["from"]))))[0]
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), cut)
    kept = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda j: F.get(F.col("lines"), j)), "\n"))
    sizes = F.transform("cuts", lambda r: r["upto"] - r["from"])
    count = lambda x: F.coalesce(x, F.lit(0)).cast("bigint")
    return rows.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), count(F.aggregate(sizes, F.lit(0), lambda a, b: a + b)).alias("n_deleted"),
                       count(F.col("n_runs")).alias("n_runs"), count(F.col("longest")).alias("longest_run"), kept.alias("kept_text"))
