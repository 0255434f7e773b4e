"""Quality rules with adaptive thresholds.

Fixed rules come first: a text with fewer than 50 words fails, and so does one of which more than half of the
words lie in a 3-word window that occurs twice or more. All other cutoffs adapt. Each text has integer metrics;
their distribution is kept per language and source as a quantile sketch, a table of counts over buckets of
seven significant bits. Such sketches merge by adding counts, so that a group with too few rows falls back on
its language's merged sketch, or on that of all rows. From a sketch come the quartiles, and from these fences
(a quartile plus or minus ``REACH`` times the spread, where the spread is the interquartile range or the
metric's least spread, if that is larger). A text is kept if it passes the fixed rules and every metric lies
within its group's fences; the fences are joined to the rows.

Only texts that pass the fixed rules are sketched. Null texts count as empty, null languages and sources form
groups of their own, repeated rows are judged one by one, and an empty table gives an empty result. Very long texts are
measured whole; a value at a fence is inside it. Other columns are carried along by ``keep_good`` and never read,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import SPACE_RUN, SPACES, fresh, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Spreads that a fence lies beyond its quartile, and rows that a sketch needs to be used by itself.
REACH, MIN_ROWS = 3, 100
#: By metric: the least spread, and whether low values are fenced too.
METRICS = {"word_len": (60, True), "symbols": (30, False), "dup_lines": (200, False), "repeats": (100, False), "capitals": (60, False)}


def _covered(positions: Column) -> Column:
    """How many words the 3-word windows that begin at these ascending positions cover."""
    steps = F.zip_with(positions, F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def measure(df: DataFrame, text: str = "text", out: str = "measured") -> DataFrame:
    """``df`` with a struct column ``out``: the base counts, ``base_failed`` and the metrics."""
    body = F.coalesce(F.col(text), F.lit(""))
    w, h, lines = f"{out}_words", f"{out}_windows", f"{out}_lines"
    n = F.size(w)
    df = df.withColumn(w, words(F.col(text)))
    df = df.withColumn(h, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))
    df = df.withColumn(lines, F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    # Equal windows lie side by side once they are sorted; only texts that have any are sorted.
    ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(h, F.when(F.size(F.array_distinct(h)) < F.size(h), ordered))
    twice = F.filter(F.transform(h, lambda e, i: F.when((F.get(h, i - 1)["h"] == e["h"]) | (F.get(h, i + 1)["h"] == e["h"]), e["i"])), lambda x: x.isNotNull())
    df = df.withColumn(h, F.sort_array(twice))
    letters = F.translate(body, SPACES, "")
    counts = {
        "n_words": n,
        "word_chars": F.char_length(letters),
        "n_symbols": F.char_length(body) - F.char_length(F.translate(body, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.coalesce(F.when(F.size(h) > 0, _covered(F.col(h))), F.lit(0)),
        "n_lines": F.size(lines),
        "n_capitals": F.char_length(letters) - F.char_length(F.regexp_replace(letters, "[A-Z]", "")),
    }
    # Going through explode() keeps later filters from pulling copies of these expressions into themselves.
    df = df.withColumn(out, F.explode(F.array(F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))))).drop(w, h, lines)
    at = lambda k: F.col(f"{out}.{k}")
    per = lambda a, b, scale: F.expr(f"({scale} * {out}.{a}) div greatest({out}.{b}, 1L)")
    return df.withColumn(
        out,
        F.struct(
            f"{out}.*",
            ((at("n_words") < MIN_WORDS) | (100 * at("n_repeat_words") > MAX_REPEATED_PERCENT * at("n_words"))).alias("base_failed"),
            per("word_chars", "n_words", 100).alias("word_len"),
            per("n_symbols", "n_words", 1000).alias("symbols"),
            per("n_dup_lines", "n_lines", 1000).alias("dup_lines"),
            per("n_repeat_words", "n_words", 1000).alias("repeats"),
            per("n_capitals", "word_chars", 1000).alias("capitals"),
        ),
    )


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source", out: str = "measured") -> DataFrame:
    """Counts by ``lang``, ``source``, metric and bucket. Partial counts are made before the shuffle, so a large group is no hot key."""
    bucket = F.expr("shiftleft(shiftright(pair.value, greatest(length(bin(pair.value)) - 7, 0)), greatest(length(bin(pair.value)) - 7, 0))")
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{out}.{m}").alias("value")) for m in METRICS)))
    rows = measured.where(~F.col(f"{out}.base_failed")).select(F.col(lang).alias("lang"), F.col(source).alias("source"), pairs.alias("pair"))
    return rows.groupBy("lang", "source", F.col("pair.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Rows, first and third quartile of the sketches merged by ``by``."""
    merged = sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    entries = merged.groupBy(*by, "metric").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("entries"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q3"))

    def step(acc: Column, e: Column) -> Column:
        seen = acc["seen"] + e["n"]
        reach = lambda q, of: F.when(acc[q].isNotNull(), acc[q]).when(4 * seen >= of * F.col("rows"), e["bucket"])
        return F.struct(seen.alias("seen"), reach("q1", 1).alias("q1"), reach("q3", 3).alias("q3"))

    # A sketch has some hundred buckets at most, whatever the number of rows behind it.
    return entries.withColumn("at", F.aggregate("entries", start, step)).select(*by, "metric", "rows", "at.q1", "at.q3")


def fences(sketches: DataFrame) -> DataFrame:
    """``lang``, ``source`` and a struct ``fence`` with ``<metric>_low`` and ``<metric>_high``: one row a group."""
    own = _quartiles(sketches, ["lang", "source"])
    by_lang = _quartiles(sketches, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), *(F.col(c).alias(f"l_{c}") for c in ("rows", "q1", "q3")))
    overall = _quartiles(sketches, []).select(F.col("metric").alias("o"), *(F.col(c).alias(f"o_{c}") for c in ("q1", "q3")))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m")), "left").join(overall, F.col("metric") == F.col("o"), "left")
    pick = lambda c: F.when(F.col("rows") >= MIN_ROWS, F.col(c)).when(F.col("l_rows") >= MIN_ROWS, F.col(f"l_{c}")).otherwise(F.col(f"o_{c}"))
    chosen = joined.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    parts = []
    for m, (least, both) in METRICS.items():
        spread = REACH * F.greatest(F.col("q3") - F.col("q1"), F.lit(least).cast("long"))
        here = lambda c, m=m: F.max(F.when(F.col("metric") == m, c))
        parts += [(here(F.col("q1") - spread) if both else F.lit(None).cast("long")).alias(f"{m}_low"), here(F.col("q3") + spread).alias(f"{m}_high")]
    wide = chosen.groupBy("lang", "source").agg(*parts)
    return wide.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), F.struct(*(c for c in wide.columns if c not in ("lang", "source"))).alias("fence"))


def judge(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", out: str = "measured", names: tuple[str, str, str] = ("fence_lang", "fence_source", "fence")) -> DataFrame:
    """``measured`` with a boolean ``kept`` inside ``out``. ``limits`` is broadcast only if Spark finds it small; else both sides are shuffled."""
    fenced = measured.join(limits, F.col(lang).eqNullSafe(F.col(names[0])) & F.col(source).eqNullSafe(F.col(names[1])), "left")
    inside = F.lit(True)
    for m, (_, both) in METRICS.items():
        v = F.col(f"{out}.{m}")
        inside = inside & F.coalesce(v <= F.col(f"{names[2]}.{m}_high"), F.lit(True))
        if both:
            inside = inside & F.coalesce(v >= F.col(f"{names[2]}.{m}_low"), F.lit(True))
    return fenced.withColumn(out, F.struct(f"{out}.*", (~F.col(f"{out}.base_failed") & inside).alias("kept"))).drop(*names)


def verdicts(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a row of ``df``: the base counts, ``base_failed``, ``kept`` and the metrics. Texts are read once; what is measured is written."""
    slim = written(measure(df.select(key, "text", "lang", "source")).drop("text"), "quality")
    limits = written(fences(sketch(slim)), "fences")
    return judge(slim, limits).select(key, "measured.*")


def keep_good(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns. Texts are measured twice rather than shuffled."""
    out = fresh(df, "quality_measured")
    limits = written(fences(sketch(measure(df.select("text", "lang", "source"), out=out), out=out)), "fences")
    lang, source, fence = (f"{out}_{c}" for c in ("fence_lang", "fence_source", "fence"))
    renamed = limits.select(F.col("fence_lang").alias(lang), F.col("fence_source").alias(source), F.col("fence").alias(fence))
    judged = judge(measure(df, out=out), renamed, out=out, names=(lang, source, fence))
    return judged.where(f"{out}.kept").select(*(F.col(f"`{c}`") for c in df.columns))


_M = ", ".join
_VALUES = {
    "word_len": "(100 * word_chars) // greatest(n_words, 1)", "symbols": "(1000 * n_symbols) // greatest(n_words, 1)", "dup_lines": "(1000 * n_dup_lines) // greatest(n_lines, 1)",
    "repeats": "(1000 * n_repeat_words) // greatest(n_words, 1)", "capitals": "(1000 * n_capitals) // greatest(word_chars, 1)",
}


def measured_sql(of: str = "documents") -> str:
    """DuckDB: CTEs up to ``measured``."""
    return rf"""
texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS body FROM {of}),
split AS (SELECT *, list_filter(regexp_split_to_array(body, '{SPACE_RUN}'), lambda x: x <> '') AS w,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  regexp_replace(body, '{SPACE_RUN}', '', 'g') AS letters FROM texts),
wins AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
keyed AS (SELECT rid, i, [w[i], w[i + 1], w[i + 2]] AS k FROM wins),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS times FROM keyed),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE times > 1) GROUP BY rid),
counted AS (SELECT s.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(letters)::BIGINT AS word_chars,
  length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, length(regexp_replace(letters, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
  FROM split s LEFT JOIN repeats r ON s.rid = r.rid),
measured AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed, {_M(f"{v} AS {m}" for m, v in _VALUES.items())} FROM counted)"""


def sql(of: str = "documents") -> str:
    """DuckDB SQL for ``verdicts``."""

    def quartiles(by: str) -> str:
        part = f"PARTITION BY {by}metric"
        return f"""SELECT {by}metric, max(total) AS rows, min(bucket) FILTER (4 * seen >= total) AS q1, min(bucket) FILTER (4 * seen >= 3 * total) AS q3 FROM (
  SELECT {by}metric, bucket, sum(n) OVER ({part} ORDER BY bucket) AS seen, sum(n) OVER ({part}) AS total FROM (SELECT {by}metric, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL))
  GROUP BY {by}metric"""

    pick = lambda q: f"CASE WHEN own.rows >= {MIN_ROWS} THEN own.{q} WHEN l.rows >= {MIN_ROWS} THEN l.{q} ELSE o.{q} END"
    limits = []
    for m, (least, both) in METRICS.items():
        spread = f"{REACH} * greatest(q3 - q1, {least})"
        limits.append(f"max(CASE WHEN metric = '{m}' THEN q3 + {spread} END) AS {m}_high")
        if both:
            limits.append(f"max(CASE WHEN metric = '{m}' THEN q1 - {spread} END) AS {m}_low")
    inside = " AND ".join([f"coalesce({m} <= {m}_high, true)" for m in METRICS] + [f"coalesce({m} >= {m}_low, true)" for m, (_, both) in METRICS.items() if both])
    shift = "greatest(length(bin(value)) - 7, 0)"
    return f"""WITH {measured_sql(of)},
pairs AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m}::BIGINT AS value FROM measured WHERE NOT base_failed" for m in METRICS)}),
sketch AS (SELECT lang, source, metric, ((value >> {shift}) << {shift}) AS bucket, count(*) AS n FROM pairs GROUP BY ALL),
own AS ({quartiles("lang, source, ")}), l AS ({quartiles("lang, ")}), o AS ({quartiles("")}),
chosen AS (SELECT own.lang, own.source, own.metric, {pick("q1")} AS q1, {pick("q3")} AS q3 FROM own
  LEFT JOIN l ON own.lang IS NOT DISTINCT FROM l.lang AND own.metric = l.metric LEFT JOIN o ON own.metric = o.metric),
fences AS (SELECT lang, source, {_M(limits)} FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {inside}) AS kept
FROM measured m LEFT JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""
