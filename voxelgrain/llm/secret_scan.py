"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

Base spans are the leftmost non-overlapping matches of three patterns, from which too short ones are dropped
afterwards (a short match still uses up its text). On top, every candidate (a run of 20 or more characters of
``A-Za-z0-9+/_=-``) is put into a character class: hexadecimal, letters and digits, or base-64. A window of 20
characters slides over it. The window's Shannon entropy follows from the sum of ``c * log2(c)`` over the counts
``c`` of its characters; a step changes two counts, so two table look-ups update the sum. The sums are whole
numbers (micro-bits), so that no rounding accumulates. What lies from the first to the last window above the
class's threshold is a span, unless the candidate is on the allow-list. Candidates of letters alone, or of
digits alone, have no class: the first are words, the second belong to the hexadecimal pattern.

Offsets count code points, ends are exclusive. Null and empty texts have no spans; very long ones are scanned whole.
Repeated rows are scanned one by one, and an empty table gives an empty result. Spans that begin at one place are in
the order of their kinds. Other columns are carried along by ``redact``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import fresh

#: Kinds in their order: the base patterns, then the classes.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_alnum", "entropy_base64")
#: The base patterns. Letters of the key words match in either case, in ASCII only.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
QUOTE = r"""["']?"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(_either_case, KEYWORDS))}){QUOTE}\\x20*[:=]\\x20*{QUOTE}([A-Za-z0-9+/_.=-]+)"
#: A run of the class is one match, so asking for 14 more characters, or for 16, is the same as dropping shorter matches.
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_SECRET = 12

WINDOW, LEAST_CANDIDATE = 20, 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that a window of each class must exceed.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_alnum": 3.6, "entropy_base64": 3.8}
#: Candidates that hold one of these, whatever the case, are no secrets.
ALLOWED = ("example", "0123456789", "abcdefghij", "placeholder", "xxxxxxxx", "deadbeef")
MASK = "[SECRET]"
_CHUNK = 128

#: c * log2(c) in whole micro-bits, for every count that a window can have.
COST = [0] + [round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1)]
#: The largest sum of costs that a window may have and still exceed the threshold.
LIMIT = {k: math.ceil(WINDOW * (math.log2(WINDOW) - t) * 1e6) - 1 for k, t in THRESHOLDS.items()}


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match begins, from the texts between the matches. Sums by chunk keep long lists cheap."""
    n = F.size(found)
    lens = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char_length(F.get(pieces, i)) + F.char_length(F.get(found, i)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    pack = F.struct(lens.alias("lens"))
    whole = F.transform(F.array(pack), lambda p: F.struct(p["lens"].alias("lens"), F.transform(F.sequence(F.lit(0), F.floor(n / _CHUNK).cast("int")), lambda b: total(F.slice(p["lens"], b * _CHUNK - _CHUNK + 1 + F.when(b == 0, _CHUNK).otherwise(0), F.when(b == 0, 0).otherwise(_CHUNK)))).alias("sums")))
    # sums[b] is what chunk b - 1 holds; their running total is short.
    running = F.transform(whole, lambda p: F.struct(p["lens"].alias("lens"), F.transform(p["sums"], lambda _, b: total(F.slice(p["sums"], 1, b + 1))).alias("before")))
    at = lambda p, i: F.get(p["before"], F.floor(i / _CHUNK).cast("int")) + total(F.slice(p["lens"], F.floor(i / _CHUNK).cast("int") * _CHUNK + 1, i % _CHUNK)) + F.char_length(F.get(pieces, i))
    return F.flatten(F.transform(running, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(p, i))))


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"))


_NONE = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _matches(text: str, pattern: str, found: str, keep=None, kind=lambda i: F.lit(0)) -> Column:
    """Spans of the matches ``found``; ``keep`` and ``kind`` take a match's index."""
    pieces = F.split(F.col(text), pattern, -1)
    joined = F.transform(F.array(F.struct(_starts(pieces, F.col(found)).alias("at"))), lambda s: F.transform(s["at"], lambda b, i: _span(b, kind(i), b + F.char_length(F.get(found, i)))))
    spans = F.flatten(joined)
    return F.when(F.size(found) > 0, F.filter(spans, lambda s, i: keep(i)) if keep else spans).otherwise(F.expr(_NONE))


def _class_of(candidate: Column) -> Column:
    """Index in ``KINDS``; null for words, plain numbers and what is allowed."""
    lower = F.lower(candidate)
    allowed = F.lit(False)
    for word in ALLOWED:
        allowed = allowed | F.contains(lower, F.lit(word))
    return (
        F.when(allowed | ~candidate.rlike("[0-9]") | ~candidate.rlike("[A-Za-z]"), F.lit(None).cast("int"))
        .when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit(3))
        .when(candidate.rlike("^[A-Za-z0-9]+$"), F.lit(4))
        .otherwise(F.lit(5))
    )


def _hot_windows(candidate: Column, kind: Column) -> Column:
    """Of the windows above the threshold, the first's and the last's start, as a struct of ``first`` and ``last``; -1 for none."""
    cost = F.array(*map(F.lit, COST))
    limit = F.when(kind == 3, LIMIT["entropy_hex"]).when(kind == 4, LIMIT["entropy_alnum"]).otherwise(LIMIT["entropy_base64"])
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("i"), F.expr("cast(null as array<int>)").alias("codes"))

    def step(acc: Column, code: Column) -> Column:
        old = F.when(acc["i"] >= WINDOW, F.get(acc["codes"], acc["i"] - WINDOW)).otherwise(F.lit(-1))
        up, down = F.get(acc["n"], code), F.get(acc["n"], old)
        more = F.when(old == code, 0).otherwise(F.get(cost, up + 1) - F.get(cost, up))
        less = F.when((old == code) | (old < 0), 0).otherwise(F.get(cost, down - 1) - F.get(cost, down))
        now = acc["sum"] + more + less
        hot = (acc["i"] >= WINDOW - 1) & (now <= limit)
        start = acc["i"] - (WINDOW - 1)
        counts = F.when(old == code, acc["n"]).otherwise(F.transform(acc["n"], lambda x, k: x + (k == code).cast("int") - (k == old).cast("int")))
        return F.struct(counts.alias("n"), now.alias("sum"), F.when(hot & (acc["first"] < 0), start).otherwise(acc["first"]).alias("first"), F.when(hot, start).otherwise(acc["last"]).alias("last"), (acc["i"] + 1).alias("i"), acc["codes"].alias("codes"))

    begin = lambda p: zero.withField("codes", p["codes"])
    return F.get(F.transform(F.array(F.struct(codes.alias("codes"))), lambda p: F.aggregate(p["codes"], begin(p), step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))), 0)


def scan(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``: all spans as an array of (start, kind as index in ``KINDS``, end), in that order."""
    body, found = f"{out}_body", [f"{out}_{k}" for k in ("assign", "access", "hex", "any")]
    df = df.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    for column, pattern in zip(found, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True):
        df = df.withColumn(column, F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
    secret = f"{out}_secret"
    df = df.withColumn(secret, F.when(F.size(found[0]) > 0, F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2))))
    base = [
        _matches(body, ASSIGN, found[0], keep=lambda i: F.char_length(F.get(secret, i)) >= LEAST_SECRET),
        _matches(body, ACCESS, found[1], kind=lambda i: F.lit(1)),
        _matches(body, HEX, found[2], kind=lambda i: F.lit(2)),
    ]
    kinds = f"{out}_kinds"
    df = df.withColumn(kinds, F.transform(found[3], _class_of))
    some = F.exists(kinds, lambda k: k.isNotNull())
    df = df.withColumn(found[3], F.when(some, F.col(found[3])).otherwise(F.expr("cast(array() as array<string>)")))
    df = df.withColumn(f"{out}_at", _matches(body, CANDIDATE, found[3], kind=lambda i: F.get(kinds, i)))
    hot = F.transform(f"{out}_at", lambda s, i: F.when(s["kind"].isNotNull(), F.struct(s.alias("s"), _hot_windows(F.get(found[3], i), s["kind"]).alias("w"))))
    hot = F.filter(hot, lambda h: h.isNotNull() & (h["w"]["first"] >= 0))
    more = F.transform(hot, lambda h: _span(h["s"]["start"] + h["w"]["first"], h["s"]["kind"], h["s"]["start"] + h["w"]["last"] + WINDOW))
    return df.withColumn(out, F.sort_array(F.concat(*base, more))).drop(body, secret, kinds, f"{out}_at", *found)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of ``df``: counts of the base kinds, the digest of the base spans, and all spans."""
    found = scan(df.select(key, text), text)
    base = F.filter("spans", lambda s: s["kind"] <= 2)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        key,
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``df`` with every span, overlapping ones together, replaced by ``MASK``, and ``n_chars`` made to fit. Rows and columns stay."""
    out = fresh(df, "redact_spans")
    found = scan(df, text, out)
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def merge(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]), longer).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    merged = f"{out}_merged"
    found = found.withColumn(merged, F.aggregate(out, empty, merge))
    end_of = lambda i: F.coalesce(F.get(merged, i)["end"], F.lit(0))
    parts = F.transform(merged, lambda s, i: F.concat(F.substring(F.col(text), end_of(i - 1) + 1, s["start"] - end_of(i - 1)), F.lit(MASK)))
    rest = F.expr(f"substring(`{text}`, coalesce(get({merged}, size({merged}) - 1).end, 0) + 1)")
    found = found.withColumn(text, F.when(F.size(merged) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col(text)))
    if n_chars in df.columns:
        found = found.withColumn(n_chars, F.when(F.size(merged) > 0, F.char_length(text).cast(df.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return found.select(*(F.col(f"`{c}`") for c in df.columns))
