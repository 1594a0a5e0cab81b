"""Name lookups: exact, substring, destinations and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions.text import name_key
from sceneframe.operators.scale import broadcast_if_small

_GRAM = 3


def lookup_exact(requests: DataFrame, objects: DataFrame, name: str = "object_label"):
    """Case-insensitive label lookup, kept in normal form.

    Returns ``(answers, matches)``: one row per request with ``label_key``, found
    and count; and the matching objects, once per requested label.  A label asked
    for by many requests and carried by many objects is thus never multiplied out.
    """
    keyed = requests.withColumn("label_key", name_key(F.col(name)))
    indexed = objects.withColumn("label_key", F.lower("label"))
    counts = indexed.groupBy("scene_id", "label_key").agg(F.count(F.lit(1)).alias("count"))
    counts = broadcast_if_small(counts, text_columns=["label_key"])
    answers = (keyed.join(counts, ["scene_id", "label_key"], "left")
               .withColumn("found", F.col("count").isNotNull())
               .withColumn("count", F.coalesce("count", F.lit(0).cast("long"))))
    asked = keyed.select("scene_id", "label_key").distinct()
    matches = indexed.join(broadcast_if_small(asked, text_columns=["label_key"]),
                           ["scene_id", "label_key"], "left_semi")
    return answers, matches


def match_substring(keywords: DataFrame, objects: DataFrame) -> DataFrame:
    """(scene_id, keyword, label): distinct labels that contain each keyword.

    ``keyword`` must be a name key.  Labels are listed under their substrings of
    up to three characters; a keyword is looked up under the rarest of its own
    three-character pieces and then tested in full, so the comparison is an
    equi-join on a selective piece.
    """
    labels = objects.select("scene_id", F.lower("label").alias("label")).where(
        "label is not null").distinct()
    kws = keywords.select("scene_id", "keyword").where("keyword is not null").distinct()

    def cut(text, n):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))

    def pieces(text, sizes):
        return F.explode(F.array_distinct(F.concat(*[cut(text, n) for n in sizes])))
    listed = labels.select("scene_id", "label", pieces(F.col("label"), range(0, _GRAM + 1)).alias("gram"))
    size = F.least(F.length("keyword"), F.lit(_GRAM))
    own = F.transform(F.sequence(F.lit(1), F.length("keyword") - size + 1),
                      lambda i: F.substring(F.col("keyword"), i, size))
    wanted = kws.select("scene_id", "keyword", F.explode(F.array_distinct(own)).alias("gram"))
    # piece -> number of labels; small pieces tables go to the broadcast side by size
    frequency = listed.groupBy("scene_id", "gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (wanted.join(frequency, ["scene_id", "gram"], "left")
              .groupBy("scene_id", "keyword")
              .agg(F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram")))
    return (rarest.join(listed, ["scene_id", "gram"])
            .where(F.contains("label", "keyword")).select("scene_id", "keyword", "label"))


def name_catalogue(zones: DataFrame, objects: DataFrame) -> DataFrame:
    """One destination per (scene, lower-cased name): zones win, then list order."""
    z = zones.select("scene_id", F.lower("name").alias("dest_key"), F.lit(0).alias("_p"),
                     F.col("zord").alias("_o"), F.col("cx").alias("tx"), F.col("cy").alias("ty"),
                     F.col("name").alias("destination"), F.lit("zone").alias("kind"))
    o = objects.select("scene_id", F.lower("label").alias("dest_key"), F.lit(1).alias("_p"),
                       F.col("ord").alias("_o"), F.col("x").alias("tx"), F.col("y").alias("ty"),
                       F.col("label").alias("destination"), F.lit("object").alias("kind"))
    pick = F.min_by(F.struct("tx", "ty", "destination", "kind"), F.struct("_p", "_o"))
    return (z.unionByName(o).where("dest_key is not null")
            .groupBy("scene_id", "dest_key").agg(pick.alias("_d"))
            .select("scene_id", "dest_key", "_d.*"))


def resolve_destination(requests: DataFrame, zones: DataFrame, objects: DataFrame,
                        name: str = "name") -> DataFrame:
    """Requests with tx, ty, destination, kind; nulls when nothing has the name."""
    catalogue = broadcast_if_small(name_catalogue(zones, objects),
                                   text_columns=["dest_key", "destination"])
    return (requests.withColumn("dest_key", name_key(F.col(name)))
            .join(catalogue, ["scene_id", "dest_key"], "left").drop("dest_key"))


def first_named(requests: DataFrame, table: DataFrame, name: str, column: str, order: str,
                take: dict[str, str], last: bool = False) -> DataFrame:
    """Requests joined to the first (or last) row of ``table`` with that name."""
    pick = F.max_by if last else F.min_by
    unique = (table.withColumn("_key", F.lower(column)).where("_key is not null")
              .groupBy("scene_id", "_key")
              .agg(pick(F.struct(*[F.col(c).alias(n) for c, n in take.items()]), order).alias("_r")))
    unique = broadcast_if_small(unique, text_columns=["_key", F.to_json("_r")])    # the whole payload counts
    return (requests.withColumn("_key", name_key(F.col(name)))
            .join(unique, ["scene_id", "_key"], "left")
            .select(*requests.columns, F.col("_r").isNotNull().alias("found"), "_r.*"))


def misses(requests: DataFrame, names: DataFrame, name: str, kind: str = "Destination",
           hint: str = "Use list_zones or list_objects to see available names.") -> DataFrame:
    """Requests whose name is not in ``names(scene_id, key)``: error and hint rows."""
    known = broadcast_if_small(names.select("scene_id", F.col("key").alias("_key")).distinct(),
                               text_columns=["_key"])
    return (requests.withColumn("_key", name_key(F.col(name)))
            .join(known, ["scene_id", "_key"], "left_anti").drop("_key")
            .withColumn("error", F.concat(F.lit(f"{kind} '"), F.col(name), F.lit("' not found.")))
            .withColumn("hint", F.lit(hint)))
