"""Benchmark decontamination by a prefix-filtered set join.

Item texts are cut into windows of consecutive words (an item with fewer words is one window).
A window's set holds its word shingles.  For exact containment one shingle is a sufficient prefix, so every
window is looked up by its rarest shingle only:

1. all shingles of the documents meet the windows' shingles; their counts give the order by rarity;
2. windows join the documents' shingles on the rarest one (the prefix);
3. the shingle's place in the window gives where the window would begin and end: it must lie
   inside the document (positional and length bound);
4. the words there are compared with the window's words.

Only DataFrame functions are used.  A null or wordless text has no words and no hits; an item
without words is ignored; an item with a null id marks words but is not listed.  Repeated rows get
equal answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.llm.common import fold_case, settle, text_or_empty
from sceneframe.operators.scale import broadcast_if_small

#: words: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: words of a window and of a shingle
WINDOW, SHINGLE = 10, 5
#: stands for a missing doc_id in joins
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.array_remove(F.split(fold_case(text), BETWEEN_WORDS), "")


def _starts(size: Column, length: Column | int) -> Column:
    """0-based starts of the runs of ``length`` elements in a list of ``size``; none if it is shorter."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(size >= length, F.sequence(F.lit(0), size - length)).otherwise(F.array().cast("array<int>"))


def _shingles(name: str, length: int) -> Column:
    """Hashes of the word shingles of the list column ``name``."""
    return F.transform(_starts(F.size(name), length), lambda i: F.xxhash64(F.slice(F.col(name), i + 1, length)))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(item_id, text, size)``: the words of each window joined by spaces, and their number."""
    split = items.select("item_id", words(text_or_empty()).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    return (split.select("item_id", "words", size.alias("size"), F.explode(_starts(F.size("words"), size)).alias("start"))
            .select("item_id", F.array_join(F.slice("words", F.col("start") + 1, F.col("size")), " ").alias("text"), "size")
            .distinct())


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"),
                       F.xxhash64(text_or_empty()).alias("th"), F.col("text").alias("doc_text"))


def occurrences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(kid, th, start, size, text)``: where the windows ``(text, size)`` occur in the documents.

    ``kid`` and ``th`` (id and hash of the text) name a document; ``start`` is a 0-based word position.
    """
    listed = settle(found.select("text", "size").distinct())
    lengths = [r["n"] for r in listed.select(F.least("size", F.lit(SHINGLE)).alias("n")).distinct().collect()]
    parts = []
    for n in sorted(lengths):
        cut = listed.where(F.least("size", F.lit(SHINGLE)) == n).withColumn("w", F.split("text", " "))
        parts.append(cut.select("text", "size", F.lit(n).alias("length"), F.posexplode_outer(_shingles("w", n)).alias("offset", "token")))
    spark = docs.sparkSession
    if not parts:
        return spark.createDataFrame([], "kid long, th long, start int, size int, text string")
    tokens = parts[0]
    for part in parts[1:]:
        tokens = tokens.unionByName(part)
    tokens = settle(tokens)

    known = broadcast_if_small(settle(tokens.select("length", "token").distinct()))
    # the outer form keeps the optimiser from repeating the split inside a filter per element
    split = _keyed(docs).select("kid", "th", words(F.coalesce("doc_text", F.lit(""))).alias("w"))
    met = None
    for n in sorted(lengths):
        rows = (split.select("kid", "th", F.size("w").alias("n_words"), _shingles("w", n).alias("tokens"))
                .select("kid", "th", "n_words", F.lit(n).alias("length"), F.posexplode_outer("tokens").alias("at", "token"))
                .join(known, ["length", "token"]))
        met = rows if met is None else met.unionByName(rows)
    met = settle(met)

    counts = met.groupBy("length", "token").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", "offset", "token")
    prefixes = (tokens.join(counts, ["length", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
                .groupBy("text", "size", "length").agg(F.min(order).alias("rarest"))
                .where("rarest.n > 0").select("text", "size", "length", "rarest.offset", "rarest.token"))
    places = (met.join(broadcast_if_small(settle(prefixes), text_columns=("text",)), ["length", "token"])
              .withColumn("start", F.col("at") - F.col("offset"))
              .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
              .groupBy("kid", "th").agg(F.collect_set(F.struct("start", "size", "text")).alias("places")))
    places = settle(places)
    # only documents with such a place are read again
    wanted = broadcast_if_small(places.select("kid", "th"))
    again = _keyed(docs).join(wanted, ["kid", "th"], "left_semi").select("kid", "th", "doc_text").distinct()
    spot = F.col("places")
    same = lambda p: F.array_join(F.slice("w", p["start"] + 1, p["size"]), " ") == p["text"]
    return (again.select("kid", "th", words(F.coalesce("doc_text", F.lit(""))).alias("w")).join(places, ["kid", "th"])
            .select("kid", "th", F.explode(F.filter(spot, same)).alias("p"))
            .select("kid", "th", "p.start", "p.size", "p.text"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per contaminated document ``(kid, th)``: ``n_hit`` words inside windows, and its ``items`` (sorted texts of ids)."""
    found = settle(windows(items, window))
    at = settle(occurrences(docs, found))
    sorted_places = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["reach"], x["start"]))).alias("n"),
                              F.greatest(a["reach"], x["stop"]).alias("reach")), lambda a: a["n"].cast("long"))
    marked = at.groupBy("kid", "th").agg(sorted_places.alias("spans")).select("kid", "th", covered.alias("n_hit"))
    listed = (at.select("kid", "th", "text").distinct().join(found.select("text", "item_id"), "text")
              .groupBy("kid", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    return marked.join(listed, ["kid", "th"])


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op10: one row per document."""
    n_words = F.size(F.array_remove(F.split(text_or_empty("doc_text"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))
    all_docs = _keyed(docs).select("doc_id", "kid", "th", n_words.cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (all_docs.join(hits(docs, items), ["kid", "th"], "left")
            .select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
                    F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows without a hit, unchanged."""
    marked = settle(hits(docs, items).select("kid", "th"))
    # the row travels in a struct, so that its columns can have any name
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    return rows.join(broadcast_if_small(marked), ["kid", "th"], "left_anti").select("row.*")
