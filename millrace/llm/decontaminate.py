"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The training texts' words are counted for the benchmark's vocabulary. Every benchmark window (``window``
consecutive words of an item, or the whole of a shorter item) is looked up by its rarest words: the index
stores, for each lookup word, postings (doc_id, position) with the words around them. Lists of a window's
two rarest words are intersected after shifting each by its place in the window, and what remains is
compared with the whole window in the stored neighbourhood, so matches are exact phrases. The same
postings serve proximity matches.

Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z in lower case. What is
broadcast comes from the benchmark and is counted first; a larger benchmark is joined by shuffles.

Defined cases: null and word-free texts have no words and no hits; items without words match nothing; rows
that repeat a doc_id or an item_id are separate documents and one item, and equal rows get equal results; a
null item_id is left out of the list of items; very long texts are searched whole; empty tables give no rows or no hits;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that separate words.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.filter(F.split(plain, " +", -1), lambda w: w != "")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, w): ``row`` is the id with a hash of the text, the same however often the table is read."""
    key = F.col(id_col).cast("long")
    return docs.select(F.struct(key.alias("id"), F.xxhash64(text_col).alias("tf")).alias("row"), key.alias("doc_id"), words(F.col(text_col)).alias("w"))


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, terms, items): the distinct windows of the items and who has them."""
    w = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("terms"))
    return each.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("win", F.xxhash64("terms"))


def term_counts(docs_words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, freq) of the vocabulary's words over all training texts; words that do not occur have no row."""
    return docs_words.select(F.explode("w").alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("freq"))


def lookups(wins: DataFrame, freq: DataFrame, terms: int = 2) -> DataFrame:
    """(win, terms, rank, term, off): the rarest words of each window that can occur at all, with their first place in it.

    A window that holds a word no training text has is left out, as it has no occurrence."""
    each = wins.select("win", "terms", F.posexplode("terms").alias("off", "term"))
    each = each.join(freq, "term", "left")
    every = Window.partitionBy("win", "terms")
    each = each.withColumn("all", F.count("freq").over(every) == F.size("terms")).where("all")
    first = each.groupBy("win", "terms", "term", "freq").agg(F.min("off").alias("off"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("win", "terms").orderBy("freq", "term")))
    return ranked.where(F.col("rank") <= terms).select("win", "terms", "rank", "term", "off")


def postings(docs_words: DataFrame, terms: DataFrame, reach: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The positional index of the given words: (term, row, pos, near, at): ``near`` holds the words up to ``reach`` away,
    the posting's own at place ``at`` (from 0).

    Up to ``limit`` words are broadcast and each text is looked through where it lies. More words meet the texts' words by a
    shuffle of places alone, and the places found fetch their neighbourhoods from their texts in a second one."""
    near = lambda pos: F.slice("w", F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, F.lit(reach)) + reach + 1)
    if terms.limit(limit + 1).count() <= limit:
        each = docs_words.select("row", "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(terms), "term", "left_semi")
    else:
        places = docs_words.select("row", F.posexplode("w").alias("pos", "term")).join(terms, "term", "left_semi").distinct()
        found = places.groupBy("row").agg(F.collect_list(F.struct("pos", "term")).alias("found"))
        each = docs_words.join(found, "row").select("row", "w", F.explode("found").alias("x")).select("row", "w", "x.pos", "x.term")
    return each.select("term", "row", "pos", near(F.col("pos")).alias("near"), F.least("pos", F.lit(reach)).alias("at"))


def phrase_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(matches, sizes): every occurrence (row, start, length, items) of a window, and (row, doc_id, n_words) of all documents.

    ``row`` tells documents apart (id and a hash of the text); ``start`` counts words from 0."""
    scratch = Scratch(spark, "decontaminate")
    w = _rows(docs, id_col, text_col)
    wins = scratch.put(windows(items, size, item_col, item_text), "windows")
    vocabulary = wins.select(F.explode("terms").alias("term")).distinct()
    freq = scratch.put(term_counts(w, small(vocabulary, limit)), "counts")
    look = scratch.put(lookups(wins, freq), "lookups")
    sought = look.select("term").distinct()
    index = scratch.put(postings(w, sought, size - 1, limit), "postings")
    sizes = scratch.put(w.select("row", "doc_id", F.size("w").cast("long").alias("n_words")), "sizes")
    scratch.release()

    one = index.join(small(look.where("rank = 1"), limit), "term")
    one = one.select("win", "terms", "row", (F.col("pos") - F.col("off")).alias("start"), "near", (F.col("at") - F.col("off")).alias("from")).where("from >= 0")
    two = index.select("term", "row", "pos").join(small(look.where("rank = 2").select("term", "win", "off"), limit), "term")
    two = two.select("win", "row", (F.col("pos") - F.col("off")).alias("start")).distinct()
    single = small(look.groupBy("win").agg(F.max("rank").alias("ranks")), limit)
    exact = one.where(F.slice("near", F.col("from") + 1, F.size("terms")) == F.col("terms")).join(single, "win")
    both = exact.where("ranks > 1").join(two, ["win", "row", "start"], "left_semi").unionByName(exact.where("ranks = 1"))
    hits = both.select("win", "terms", "row", "start").join(small(wins, limit), ["win", "terms"])
    return hits.select("row", "start", F.size("terms").alias("length"), "items"), sizes


def proximity_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, terms: int = 3, reach: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, pos): places where the ``terms`` rarest words of an item occur within ``reach`` words of the rarest one."""
    scratch = Scratch(spark, "proximity")
    w = _rows(docs, id_col, text_col)
    own = items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(words(F.col(item_text)))).alias("term")).distinct()
    freq = scratch.put(term_counts(w, small(own.select("term").distinct(), BROADCAST_ROWS)), "counts")
    rare = own.join(freq, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("freq", F.lit(0)), "term")))
    look = rare.where(F.col("rank") <= terms).groupBy("item").agg(F.max(F.when(F.col("rank") == 1, F.col("term"))).alias("term"), F.collect_set("term").alias("need"))
    index = postings(w, look.select("term").distinct(), reach).withColumn("doc_id", F.col("row.id"))
    near = index.join(small(look, BROADCAST_ROWS), "term").where(F.size(F.array_except("need", "near")) == 0)
    return near.select("doc_id", F.col("item").alias("item_id"), "pos")


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20, **cols) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items, contaminated) of every document; contaminated if ``share`` * n_hit >= n_words > 0."""
    matches, sizes = phrase_matches(spark, docs, items, size, **cols)
    spans = matches.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # words of sorted spans, each counted from where the spans before it end
    ordered = F.array_sort("spans")
    covered = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"].cast("long")))).cast("long").alias("n"),
            F.greatest(a["end"], (s["start"] + s["length"]).cast("long")).alias("end"),
        ),
    )["n"]
    found = spans.select("row", covered.alias("hit"), "items")
    out = sizes.join(found, "row", "left").select("row", "doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), "items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
