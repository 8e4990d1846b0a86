"""Benchmark decontamination by winnowing.

The words of a text are hashed in grams of ``gram`` words; of every
``window - gram + 1`` consecutive grams the least hash is kept (the rightmost
of equal ones), with its position. What is kept depends on the words of that
window alone, so a passage of ``window`` words that two texts share has at least
one kept gram at the same place in both: joining kept hashes finds every shared
passage. Each hit is then extended, word by word, to the windows that contain
its gram, so hash collisions never count. Items of fewer words than a window
are one window: their whole hash is looked for among all word runs of that length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, perhaps_in

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)


def item_words(text: str = "text") -> Column:
    """A-Z lower-cased; words are runs of a-z, 0-9 and anything beyond ASCII. Null has none."""
    return F.array_remove(F.split(_lowered(text), ITEM_GAP), "")


def _grams(k: int) -> Column:
    """The hash of each run of ``k`` words. (Explode them as outer: the filter that Spark would derive from a
    plain explode repeats this expression, with the word hashes written out for every word.)"""
    h = F.col("_h")
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(h, i + j) for j in range(k)])
    return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), at)).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, k: int) -> DataFrame:
    df = df.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("_g", _grams(k)).drop("words", "_h")


def all_grams(df: DataFrame, k: int) -> DataFrame:
    """One row per run of ``k`` words in ``words``: the other columns, at (0-based) and hash."""
    return _hashed(df, k).select("*", F.posexplode_outer("_g").alias("at", "hash")).drop("_g").where("at IS NOT NULL")


def winnow(df: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per kept gram of ``words``: the other columns, at (0-based) and hash.

    The row of a window is dropped if the window before it kept the same gram.
    """
    wide = window - gram + 1
    keep = [c for c in df.columns if c != "words"]
    rows = _hashed(df, gram)
    rows = rows.select("*", F.explode_outer(F.when(F.size("_g") >= wide, F.sequence(F.lit(0), F.size("_g") - wide))).alias("_j"))
    rows = rows.where("_j IS NOT NULL")
    bits = (wide - 1).bit_length()

    def kept(first: int) -> Column:
        """Offset from ``_j`` of the least gram in the window at _j + first: its low bits, larger to the left, make the rightmost win."""
        grams = [F.shiftleft(F.get("_g", F.col("_j") + first + i), bits).bitwiseOR(F.lit(wide - 1 - i)) for i in range(wide)]
        least = F.least(*grams) if wide > 1 else grams[0]
        return F.lit(first + wide - 1) - least.bitwiseAND(F.lit((1 << bits) - 1))

    # few array reads a row: a longer generated method would not be compiled
    rows = rows.withColumns({"_now": kept(0), "_before": F.when(F.col("_j") > 0, kept(-1))}).where("_before IS NULL OR _before <> _now")
    return rows.select(*keep, (F.col("_j") + F.col("_now")).cast("int").alias("at"), F.get("_g", (F.col("_j") + F.col("_now")).cast("int")).alias("hash"))


def _around(words: str, at: str, reach: int, width: int) -> list[Column]:
    """Up to ``reach`` words before ``at``, ``width`` from it on; how many lie before; how many words from ``at`` to the end."""
    lead = F.least(F.lit(reach), F.col(at))
    near = F.slice(F.col(words), (F.col(at) - lead + 1).cast("int"), (lead + width).cast("int"))
    return [near.alias("near"), lead.alias("lead"), (F.size(words) - F.col(at)).alias("left")]


def shared_windows(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """(k1, k2, item, start, n): every place where a window of an item occurs in a text.

    docs   (k1, k2, text): a text and two 64-bit hashes of it; copies count once
    items  (item, words): distinct word sequences
    """
    items = materialize(items.where(F.size("words") > 0), "items")
    short = sorted(r.n for r in items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect())  # under ``window`` numbers
    texts = docs.select("k1", item_words("text").alias("words"))
    kinds = [(window, winnow(items.where(F.size("words") >= window), window, gram), lambda: winnow(texts, window, gram))]
    kinds += [(n, all_grams(items.where(F.size("words") == n), n), lambda n=n: all_grams(texts, n)) for n in short]
    met = []
    for n, prints, of_texts in kinds:
        known = materialize(prints.select("hash", "item", F.col("at").alias("there")), "item-prints")
        met.append(of_texts().join(known, "hash").select("k1", "at", F.lit(n).alias("n"), "item", "there"))
    met = materialize(reduce(DataFrame.unionByName, met).distinct(), "hits")

    places = materialize(met.groupBy("k1").agg(F.collect_set("at").alias("places")), "places")
    held = perhaps_in(docs, "k1", places.select("k1")).dropDuplicates(["k1", "k2"])
    held = held.join(places, "k1").select("k1", "k2", item_words("text").alias("words"), F.explode("places").alias("at"))
    reach = window - gram
    held = materialize(held.select("k1", "k2", "at", *_around("words", "at", reach, window)), "held")
    there = met.select("item", "there").distinct().join(items, "item").select("item", "there", *_around("words", "there", reach, window))
    there = there.select("item", "there", F.col("near").alias("near2"), F.col("lead").alias("lead2"), F.col("left").alias("left2"))

    # offsets of the windows that hold the gram and lie in both texts, and of those the equal ones
    back = F.when(F.col("n") == window, F.least("lead", "lead2")).otherwise(0)
    ahead = F.least(F.lit(0), F.col("left") - F.col("n"), F.col("left2") - F.col("n"))
    pairs = met.join(materialize(there, "item-places"), ["item", "there"]).join(held, ["k1", "at"])
    pairs = pairs.withColumns({"_from": -back, "_to": ahead}).where("_from <= _to")
    same = lambda o: F.slice("near", F.col("lead") + o + 1, F.col("n")) == F.slice("near2", F.col("lead2") + o + 1, F.col("n"))
    found = pairs.select("k1", "k2", "item", "at", "n", F.explode(F.filter(F.sequence("_from", "_to"), same)).alias("_o"))
    return found.select("k1", "k2", "item", (F.col("at") + F.col("_o")).alias("start"), "n").distinct()


def spans(windows: DataFrame) -> DataFrame:
    """(k1, k2, spans, n_hit): a text's windows merged where they touch, as sorted (start, end) in words."""
    starts = windows.groupBy("k1", "k2", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    opens = starts.withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    merged = opens.withColumn("_nth", F.sum("_new").over(upto)).groupBy("k1", "k2", "_nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted ids as text), spans (word ranges hit).

    Every run of ``window`` words that a document shares with an item is found, whatever
    its place; an item with fewer words counts if all of them occur in a row. Null and
    empty texts have no words and are never hit; items without words are never found.
    Null item ids are written ``null``; an id that several items share counts once. Equal
    texts are looked up once, and items with equal words are one until the ids are listed.
    Rows with repeated or null ids keep their own row; other columns are ignored. Empty
    tables give no hits.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"), item_words(item_text_col).alias("words"))
    named = materialize(named.withColumn("item", F.sha2(F.array_join("words", " "), 256)), "named-items")
    distinct = named.groupBy("item").agg(F.first("words").alias("words"))

    windows = materialize(shared_windows(keyed.select("k1", "k2", "text"), distinct, window, gram), "windows")
    ids = windows.select("k1", "k2", "item").distinct().join(named.select("item", "id").distinct(), "item")
    ids = ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("id")).alias("items"))
    found = materialize(spans(windows).join(ids, ["k1", "k2"]), "found")

    none = F.array().cast("array<string>")
    rows = keyed.select("doc_id", F.regexp_count(_lowered("text"), F.lit(ITEM_WORD)).cast("long").alias("n_words"), "k1", "k2")
    return rows.join(found, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
