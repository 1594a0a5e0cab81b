r"""Information-theoretic sanitisation of personal data.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by fixed patterns.
A *term* (a word near an entity, on the same line) can reveal the entity even if the entity itself is
masked.  How much it does is estimated from the corpus: with N distinct lines, of which c(e) hold
the entity, c(t) the term and c(e, t) both, the term carries

    PMI(e, t) = log2(N * c(e, t) / (c(e) * c(t)))

of the IC(e) = log2(N / c(e)) bits that single the entity out.  Terms that carry at least
``DISCLOSURE`` of these bits, on at least ``SUPPORT`` distinct lines, are spans too, wherever they occur.
:func:`sanitise` removes the terms and generalises the entities to their kind.

Copies of a line count once, so copied documents don't make a term look telling.  Only DataFrame functions
are used.  A null text counts as empty; repeated rows get equal answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from sceneframe.llm.common import fold_case, settle, text_or_empty
from sceneframe.llm.leakage import words
from sceneframe.operators.scale import broadcast_if_small

#: The entity patterns.  Possessive quantifiers, and starts only where a run begins or the last match ended,
#: find the same matches as the plain greedy forms without trying every start of a long run.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: shortest term, distinct lines that show a term with an entity, and share of the entity's information it must carry
TERM_LENGTH, SUPPORT, DISCLOSURE = 3, 3, 0.9
#: what parts words in a text whose case is unchanged
_PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_SPAN = "array<struct<start:int,stop:int,value:string>>"
_NO_ID = -(1 << 63)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3)
                        & (F.coalesce(F.when(F.length(part(x)) <= 3, part(x).try_cast("int")), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits))
    return F.length(digits).between(9, 15)


def entity_spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping valid matches as (start, stop, value), in code points."""
    pattern = F.lit(KINDS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, KINDS[kind])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(a, x):
        begin = a["at"] + x["gap"]
        stop = begin + F.length(x["value"])
        span = F.array(F.struct(begin.alias("start"), stop.alias("stop"), x["value"].alias("value")))
        return F.struct(stop.alias("at"), F.when(_valid(kind, x["value"]), F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))
    # the lists are bound once, then walked
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    spans = F.aggregate(F.filter(pairs, lambda x: x["value"].isNotNull()), start, step, lambda a: a["out"])
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(KINDS["card"]),
           "phone": text.contains("+")}[kind]
    return F.when(may, spans).otherwise(F.array().cast(_SPAN))


def entities(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``kid``, ``th`` and a column of spans for each kind."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), F.xxhash64(text_or_empty()).alias("th"),
                        text_or_empty().alias("t"))
    return keyed.select("doc_id", "kid", "th", *[entity_spans(F.col("t"), k).alias(k) for k in KINDS])


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), F.xxhash64(text_or_empty()).alias("th"),
                       F.explode_outer(F.split(text_or_empty(), "\n")).alias("line"))


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["value"])))


def telling_terms(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(terms, places)``: the disclosing terms, and the documents (kid, th, term) that hold candidates."""
    lines = _lines(docs)
    near = lines.where(F.col("line").rlike("[0-9@]")).select("line").withColumn("h", F.xxhash64("line"))
    held = near.select("h", "line", F.concat(*[
        _named(entity_spans(F.col("line"), k), k) for k in KINDS]).alias("found"))
    held = settle(held.where(F.size("found") > 0).dropDuplicates(["h"]))
    rest = F.col("line")
    for pattern in KINDS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    seen = held.select("h", F.explode(F.array_distinct("found")).alias("entity"))
    pairs = (held.select("found", F.array_distinct(words(rest)).alias("w"))
             .select(F.explode(F.array_distinct("found")).alias("entity"), "w")
             .select("entity", F.explode("w").alias("term")).where(F.length("term") >= TERM_LENGTH)
             .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= SUPPORT))
    pairs = settle(pairs.join(seen.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e")), "entity"))
    n = lines.agg(F.approx_count_distinct(F.xxhash64("line")).alias("n")).first()["n"]
    whole = F.log2(F.lit(float(max(n, 2))) / F.col("c_e"))

    def telling(counts: DataFrame, slack: float) -> DataFrame:
        """Terms whose share reaches the threshold, or would if they were found on ``slack`` times as many lines."""
        bits = F.log2(F.lit(float(max(n, 2))) * F.col("both") / (F.col("c_e") * F.col("c_t") * slack))
        return settle(pairs.join(counts, "term").where(bits >= DISCLOSURE * whole).select("term").distinct())

    def held_by(terms: DataFrame) -> DataFrame:
        small = broadcast_if_small(terms, text_columns=("term",))
        return (lines.select("kid", "th", F.xxhash64("line").alias("h"), F.explode_outer(words(F.col("line"))).alias("term"))
                .join(small, "term", "left_semi"))
    # frequent words are ruled out by sketches of their lines, which need no rows of their own; the rest are counted exactly
    sketched = held_by(settle(pairs.select("term").distinct())).groupBy("term").agg(F.approx_count_distinct("h").alias("c_t"))
    places = settle(held_by(telling(sketched, 0.5)).distinct())
    terms = telling(places.groupBy("term").agg(F.count_distinct("h").alias("c_t")), 1.0)
    return terms, places.select("kid", "th", "term").distinct()


def term_spans(docs: DataFrame) -> DataFrame:
    """``(kid, th, terms)``: sorted (start, stop) of the disclosing terms of the documents that hold any."""
    terms, places = telling_terms(docs)
    small = broadcast_if_small(terms, text_columns=("term",))
    holders = broadcast_if_small(settle(places.join(small, "term", "left_semi").select("kid", "th").distinct()))
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("t"))
    cut = (keyed.join(holders, ["kid", "th"], "left_semi").distinct()
           .select("kid", "th", F.posexplode(F.regexp_extract_all("t", F.lit(f"{_PARTS}*+[^{_PARTS[1:]}++"), F.lit(0))).alias("at", "piece")))
    stop = F.sum(F.length("piece")).over(Window.partitionBy("kid", "th").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return (cut.withColumn("stop", stop.cast("int"))
            .withColumn("term", fold_case(F.regexp_replace("piece", f"^{_PARTS}+", "")))
            .join(small, "term", "left_semi")
            .groupBy("kid", "th").agg(F.array_sort(F.collect_list(F.struct((F.col("stop") - F.length("term")).alias("start"), "stop"))).alias("terms")))


def spans(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, the spans of each kind, and ``terms``."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return (settle(entities(docs)).join(term_spans(docs), ["kid", "th"], "left")
            .select("doc_id", "kid", "th", *KINDS, F.coalesce("terms", none).alias("terms")))


def digest(found: DataFrame) -> DataFrame:
    """op7: counts, the hash of the base spans and all spans as text."""
    as_text = lambda kind, c: F.transform(c, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["stop"].cast("string")))
    base = F.array_join(F.concat(*[as_text(k, F.col(k)) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[as_text(k, F.col(k)) for k in KINDS], as_text("term", F.col("terms"))), ",")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with entities generalised to ``[kind]`` and disclosing terms removed."""
    mark = lambda c, by: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(by).alias("by")))
    marks = F.concat(*[mark(k, f"[{k}]") for k in KINDS], mark("terms", ""))
    found = spans(docs).select("kid", "th", F.array_sort(marks).alias("marks")).dropDuplicates(["kid", "th"])
    text = F.col("t")
    built = F.aggregate("marks", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
                        lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(
                            x["stop"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), x["by"]).alias("out"))),
                        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return (docs.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("kid"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("t"))
            .join(found, ["kid", "th"]).select("doc_id", built.alias("text")))
