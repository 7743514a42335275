"""Benchmark decontamination with a positional inverted index, in DataFrame and SQL functions alone.

Each benchmark item is cut into windows of `WINDOW` consecutive words (a shorter item is one window). The
corpus frequency of every benchmark word is counted, and each window asks for its rarest word only. The index
stores, for each document, the postings of those words: word, position, and the words at the offsets before and
after it, which is the part of the other words' lists that an intersection with this list can reach. A query
then meets the rarest word's list and intersects outwards, offset by offset, from that place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.licenses import words_of
from lectern.session import materialise, scratch_path

WINDOW = 10
#: Query words that one pass over the corpus looks up; more are taken in blocks of so many.
TERMS_PER_PASS = 5000
#: Rows of benchmark words or windows up to which that side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Share of a window's words near its rarest word that makes a proximity match.
NEAR = 0.8


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _sql_string(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def item_words(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item, words) of each item that has a word; key numbers the rows, so null and repeated ids stay apart."""
    rows = benchmark.select(
        F.monotonically_increasing_id().alias("key"), F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
        words_of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("words"),
    )
    return rows.filter(F.size("words") > 0)


def word_frequencies(docs: DataFrame, vocabulary: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq): how often each word of `vocabulary` stands in the whole corpus."""
    words = docs.select(F.explode(words_of(F.col(f"`{text_col}`"))).alias("word"))
    return words.join(_small(vocabulary), "word").groupBy("word").agg(F.count("*").alias("freq"))


def rarest_queries(items: DataFrame, frequencies: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, item, need, before, after): for each place of an item that is the rarest of one of its windows.

    need is the length of a window; before and after are up to window - 1 neighbouring words, nearest first.
    """
    n = F.size("words")
    need = F.least(F.lit(window), n)
    starts = items.select("key", "words", F.explode(F.sequence(F.lit(0), n - need)).alias("start"))
    places = starts.select("key", "start", F.explode(F.sequence(F.col("start"), F.col("start") + need - 1)).alias("place"), "words")
    places = places.select("key", "start", "place", F.get("words", F.col("place")).alias("word"))
    rated = places.join(_small(frequencies), "word", "left").select("key", "start", F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "word", "place").alias("rated"))
    chosen = rated.groupBy("key", "start").agg(F.min("rated").alias("r")).filter("r.freq > 0").select("key", F.col("r.word").alias("word"), F.col("r.place").alias("place")).distinct()
    return chosen.join(items, "key").select("word", "item", need.alias("need"), *_around(F.col("words"), F.col("place"), window))


def _around(words: Column, place: Column, window: int) -> tuple[Column, Column]:
    """Up to window - 1 words before `place`, nearest first, and as many after it."""
    before = F.reverse(F.slice(words, F.greatest(place - (window - 1), F.lit(0)) + 1, F.least(place, F.lit(window - 1))))
    return before.alias("before"), F.slice(words, place + 2, F.lit(window - 1)).alias("after")


def build_index(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Store the index: one row per document with the hash of its text, id, n_words and postings of `terms`.

    Every row of `docs` has one, with or without postings. What is found in a text is found in its copies, so the
    hash stands for the row wherever the index is read, whatever order `docs` comes in.
    """
    path = path or scratch_path(docs.sparkSession, "postings")
    wanted = f"m.word in ({', '.join(map(_sql_string, terms))})" if terms else "false"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("row"), F.col(f"`{id_col}`").alias("id"), words_of(text).alias("words"))
    marked = F.expr(f"filter(transform(words, (w, i) -> struct(w as word, i as pos)), m -> {wanted})")
    rows = rows.withColumn("marked", marked)
    postings = F.transform("marked", lambda m: F.struct(m["word"].alias("word"), m["pos"].alias("pos"), *_around(F.col("words"), m["pos"], window)))
    rows.select("row", "id", F.size("words").cast("long").alias("n_words"), postings.alias("postings")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _run(a: str, b: str) -> Column:
    """How many leading elements the arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same)).otherwise(stop - 1)


def matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(row, item, low, high, kind): places of the corpus that a query reaches.

    kind "phrase": the words low..high equal those of the item and hold one window at least. kind "proximity":
    not so, but `NEAR` of the words around the item's rarest word stand around its posting, in any order.
    """
    lists = index.filter(F.size("postings") > 0).select("row", F.explode("postings").alias("p"))
    lists = lists.select("row", F.col("p.word").alias("word"), F.col("p.pos").alias("pos"), F.col("p.before").alias("doc_before"), F.col("p.after").alias("doc_after"))
    met = lists.join(_small(queries), "word").withColumn("left", _run("before", "doc_before")).withColumn("right", _run("after", "doc_after"))
    phrase = F.col("left") + F.col("right") + 1 >= F.col("need")
    around = F.array_distinct(F.concat("before", "after"))
    near = F.size(F.array_intersect(around, F.concat("doc_before", "doc_after"))) >= F.size(around) * NEAR
    kind = F.when(phrase, "phrase").when(near, "proximity")
    return met.select("row", "item", (F.col("pos") - F.col("left")).alias("low"), (F.col("pos") + F.col("right")).alias("high"), kind.alias("kind")).filter("kind is not null")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, item_text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items, contaminated, n_near.

    A word is hit when it lies in an occurrence of a window of an item; n_hit counts such words, items lists the
    ids of the items whose windows occur (as strings, sorted), and n_near the items met by proximity alone. Null
    texts and items have no words; items of one id count once, a null id as the empty string; repeated documents
    each get their own row; an empty benchmark hits nothing and an empty corpus gives no rows.
    """
    items = materialise(item_words(benchmark, item_col, item_text_col), "items")
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    frequencies = materialise(word_frequencies(docs, vocabulary, text_col), "frequencies")
    queries = materialise(rarest_queries(items, frequencies, window), "queries")
    terms = sorted(r["word"] for r in queries.select("word").distinct().collect())  # words of the benchmark, not of the corpus
    blocks = [terms[k : k + TERMS_PER_PASS] for k in range(0, len(terms), TERMS_PER_PASS)] or [[]]
    indexes = [build_index(docs, block, id_col, text_col, window) for block in blocks]
    found = matches(indexes[0], queries)
    for index in indexes[1:]:
        found = found.union(matches(index, queries))
    phrases = found.filter("kind = 'phrase'")
    hits = phrases.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.select("row", "items", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["low"], s["high"]))))).cast("long").alias("n_hit"))
    near = found.groupBy("row").agg(F.size(F.collect_set(F.when(F.col("kind") == "proximity", F.col("item")))).cast("long").alias("n_near"))
    out = indexes[0].select("row", "id", "n_words").join(hits, "row", "left").join(near, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
