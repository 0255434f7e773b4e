"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens (runs of letters and digits, numbers with their separators kept whole). In the
template of a text every number, every name (a token that begins with a capital letter) and every unit after a
number is replaced by a typed placeholder; all other tokens are in lower case. Windows of eight template tokens
of the benchmark, leaving out those with fewer than four literal tokens, are joined by hash with the windows of
all documents. So a passage is found as it is, and also with other numbers, names or units put in.

What the join finds is then checked. Windows of a document and an item that lie at the same distance form an
occurrence. Its slots, the placeholders' original values, are compared: equal values in the item must stand
against equal values in the document, and the reverse, else the occurrence is chance and goes. An item leaks into
a document if the remaining occurrences cover at least half of the item's windows.

With ``passages``, parts, re-cased and lightly edited copies count too. The windows are then taken from a second
template as well, in which letter case tells nothing and so no token is a name, and each template is judged by
itself. A window without a differing slot counts even in an occurrence whose slots contradict each other. An item
leaks if a fifth of its windows are covered, or ``LEAST_RUN`` of them (13 tokens in a row) if that is less.

Null and empty texts, and items of fewer than eight tokens, match nothing; an empty table gives an empty result, and
very long texts are taken whole. Ties don't arise, as each document and item is judged by itself. Rows that share a key (null included)
are one document; an item that is repeated counts once for each id. Other columns are carried along by
``drop_leaks``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import fresh, written

WINDOW, LEAST_LITERAL, LEAST_PERCENT = 8, 4, 50
#: With ``passages``: the share of an item's windows, and their number, of which the smaller is enough.
PASSAGE_PERCENT, LEAST_RUN = 20, 6
TOKEN = r"[0-9]+(?:[.,:/][0-9]+)*|[\p{L}\p{M}0-9]+"
#: Units of measure and money, in lower case, that stand after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mile miles mg g kg lb lbs oz ton tons ml cl l liter liters litre litres s sec second seconds min minute minutes "
    "h hour hours day days week weeks month months year years percent euro euros dollar dollars cent cents pound pounds mph kmh km2 m2 m3 hz khz mhz ghz w kw kwh v a c f"
).split()
#: Benchmark windows are broadcast up to so many bytes, of hashes, places and ids alone. Beyond that both sides are
#: shuffled, and each window is spread over ``SALTS`` keys, so that a common one is no hot key.
BROADCAST_BYTES, SALTS = 24_000_000, 32


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(t: Column) -> Column:
    """Of what a token can begin with, only digits stand before the colon."""
    return t < F.lit(":")


def _slot(raw: Column, t: Column, i: Column, folded: bool = False) -> Column:
    """The placeholder of token ``t`` at ``i`` of ``raw``; null for literal tokens, and for names if ``folded``."""
    found = F.when(_is_number(t), F.lit("<number>")).when(_is_unit(raw, t, i), F.lit("<unit>"))
    return found if folded else found.when(_is_name(t), F.lit("<name>"))


def _is_unit(raw: Column, t: Column, i: Column) -> Column:
    after = F.coalesce(_is_number(F.get(raw, i - 1)), F.lit(False))
    return after & F.array_contains(F.array(*map(F.lit, UNITS)), F.lower(t))


def _is_name(t: Column) -> Column:
    return F.left(t, F.lit(1)) != F.left(F.lower(t), F.lit(1))


def _hash(kind: str) -> Column:
    return F.xxhash64(F.lit(f"<{kind}>"))


def _template(raw: str) -> Column:
    """Hashes of the template's tokens: of their ``_slot``, or of the token in lower case. Lambdas are interpreted, token
    by token, so a token in lower case, as most are, is known by one comparison before names are looked for."""

    def token(t: Column, i: Column) -> Column:
        found = F.when(_is_number(t), _hash("number")).when(_is_unit(F.col(raw), t, i), _hash("unit"))
        return found.when(t == F.lower(t), F.xxhash64(t)).when(_is_name(t), _hash("name")).otherwise(F.xxhash64(F.lower(t)))

    return F.transform(F.col(raw), token)


def _folded(template: str, raw: str) -> Column:
    """The template without names: that of ``template``, but for the names."""
    return F.zip_with(F.col(template), F.col(raw), lambda h, t: F.when(h == _hash("name"), F.xxhash64(F.lower(t))).otherwise(h))


def _windows(template: str, folded: bool = False) -> Column:
    """Hashes of the windows, by where they begin; other ones for the folded template."""
    n, mark = F.size(template), [F.lit("folded")] if folded else []
    return F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col(template), i, WINDOW), *mark))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _with_templates(df: DataFrame, passages: bool) -> DataFrame:
    df = df.withColumn("template", _template("raw"))
    return df.withColumn("folded", _folded("template", "raw")) if passages else df


def _all_windows(passages: bool) -> Column:
    """Windows of the template and, with ``passages``, those of the folded one after them. To be exploded as it is:
    from a column, Spark would infer a filter in which the tokens are made again for every token."""
    return F.concat(_windows("template"), _windows("folded", True)) if passages else _windows("template")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", folded: bool = False) -> DataFrame:
    """``item``, ``folded``, ``j``, ``window``, ``slots`` and ``total``: the windows with enough literal tokens, and their number by item."""
    df = items.select(F.col(key).alias("item"), F.lit(folded).alias("folded"), _tokens(F.col(text)).alias("raw"))
    df = df.withColumn("slots", F.transform("raw", lambda t, i: F.struct(_slot(F.col("raw"), t, i, folded).alias("kind"), F.lower(t).alias("value"))))
    df = df.withColumn("template", _template("raw"))
    df = df.withColumn("template", _folded("template", "raw")) if folded else df
    df = df.select("item", "folded", "slots", F.posexplode(_windows("template", folded)).alias("j", "window"))
    df = df.withColumn("slots", F.slice("slots", F.col("j") + 1, F.lit(WINDOW)))
    df = df.where(F.size(F.filter("slots", lambda s: s["kind"].isNull())) >= LEAST_LITERAL)
    totals = df.groupBy("item").agg(F.countDistinct("j").alias("total"))
    return df.join(totals.withColumnRenamed("item", "of"), F.col("item").eqNullSafe(F.col("of"))).drop("of").dropDuplicates(["item", "j", "window"])


def _joined(windows: DataFrame, of: DataFrame) -> DataFrame:
    """``windows`` with what ``of`` has of the same window."""
    size = of.agg(F.sum(F.lit(24) + F.octet_length(F.col("item").cast("string")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return windows.join(F.broadcast(of), "window")
    spread = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return windows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(spread, ["window", "salt"]).drop("salt")


def _enough(n: str, passages: bool) -> Column:
    """Whether ``n`` of an item's ``total`` windows make a leak."""
    if not passages:
        return 100 * F.col(n) >= LEAST_PERCENT * F.col("total")
    return (100 * F.col(n) >= PASSAGE_PERCENT * F.col("total")) | (F.col(n) >= LEAST_RUN)


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passages: bool = False) -> DataFrame:
    """``doc``, ``item``, ``matched`` (windows of the item that are covered), ``total`` and ``exact`` (no slot differs), a row for each leak."""
    bench = item_windows(items, item_key)
    if passages:
        bench = bench.unionByName(item_windows(items, item_key, folded=True))
    bench = written(bench, "bench")
    prints = _with_templates(docs.select(F.col(key).alias("doc"), _tokens(F.col(text)).alias("raw")), passages)
    # Only hashes and places leave the row; repeated hits of an item's window in one document count once.
    seen = prints.select("doc", F.explode(_all_windows(passages)).alias("window"))
    hits = _joined(seen, bench.select("window", "item", "folded", "j", "total"))
    likely = hits.groupBy("doc", "item", "folded", "total").agg(F.countDistinct("j").alias("n")).where(_enough("n", passages))
    likely = written(likely.select(F.col("doc").alias("of_doc"), F.col("item").alias("of_item")).distinct(), "likely")
    # Only texts with a likely leak are looked at again, in full.
    again = docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).join(likely.select(F.col("of_doc").alias("d")).distinct(), F.col("doc").eqNullSafe(F.col("d")), "left_semi")
    again = _with_templates(again.withColumn("raw", _tokens(F.col("body"))), passages)
    again = again.select("doc", F.col("raw"), F.posexplode(_all_windows(passages)).alias("i", "window"))
    again = again.withColumn("i", F.col("i") % (F.size("raw") - (WINDOW - 1)))
    again = again.select("doc", "i", "window", F.transform(F.slice("raw", F.col("i") + 1, F.lit(WINDOW)), lambda t: F.lower(t)).alias("values"))
    met = _joined(again, bench.select("window", "item", "folded", "j", "total"))
    met = met.join(likely, F.col("doc").eqNullSafe(F.col("of_doc")) & F.col("item").eqNullSafe(F.col("of_item")), "left_semi")
    # Slots are fetched for what is left, by a join of the size that Spark finds.
    slots = bench.select(F.col("item").alias("of"), F.col("folded").alias("of_folded"), F.col("j").alias("of_j"), "slots")
    met = met.join(slots, F.col("item").eqNullSafe(F.col("of")) & (F.col("folded") == F.col("of_folded")) & (F.col("j") == F.col("of_j"))).drop("of", "of_folded", "of_j")
    pairs = F.filter(F.zip_with("slots", "values", lambda s, v: F.struct(s["kind"].alias("kind"), s["value"].alias("item"), v.alias("doc"))), lambda p: p["kind"].isNotNull())
    met = met.select("doc", "item", "folded", "total", (F.col("i") - F.col("j")).alias("at"), "j", pairs.alias("pairs"))
    same = F.forall("pairs", lambda p: p["item"] == p["doc"])
    met = met.groupBy("doc", "item", "folded", "total", "at").agg(F.collect_set("j").alias("js"), F.collect_set(F.when(same, F.col("j"))).alias("same"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    distinct = lambda f: F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p[f]))))
    agreed = (distinct("item") == F.size("pairs")) & (distinct("doc") == F.size("pairs"))
    met = met.withColumn("js", F.when(agreed, F.col("js")).otherwise(F.col("same"))) if passages else met.where(agreed)
    met = met.withColumn("exact", same)
    out = met.groupBy("doc", "item", "folded", "total").agg(F.size(F.array_distinct(F.flatten(F.collect_set("js")))).cast("long").alias("matched"), F.max("exact").alias("exact"))
    out = out.where(_enough("matched", passages)).groupBy("doc", "item").agg(F.max(F.struct("matched", "total")).alias("most"), F.max("exact").alias("exact"))
    return out.select("doc", "item", "most.matched", "most.total", "exact")


def drop_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", passages: bool = False) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, with all their columns."""
    name = fresh(docs, "leak_doc")
    found = written(leaks(docs, items, key, text, passages=passages).select(F.col("doc").alias(name)).distinct(), "leaks")
    return docs.join(found, docs[key].eqNullSafe(found[name]), "left_anti")
