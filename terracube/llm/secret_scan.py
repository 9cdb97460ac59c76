"""Secrets in texts: fixed patterns, and runs whose sliding-window entropy is that of random characters. Built-in Spark functions only."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three listed kinds, and the least length of a match (for ``assign`` of its group 2).
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
LEAST_VALUE = 6
#: A run that is too short never hides a longer one, so the least length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))

#: Candidate strings, and the window that slides over them.
WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
FIRST_CODE, CODES = 43, 80  # "+" is the least character of a candidate, "z" the greatest
#: Character classes, narrowest first: the pattern a candidate of the class matches, and the bits a character that some window must reach. Digits alone are no class.
CLASSES = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", 3.1),
    ("one_case", "^([0-9a-z]+|[0-9A-Z]+)$", 3.6),
    ("mixed", "^[A-Za-z0-9+/_=-]+$", 3.9),
)
#: What a candidate of every class must hold.
NEEDS = ("[0-9]", "[A-Za-z]")
#: Candidates that are no secrets: identifiers, placeholders, sequences, words joined by dashes or slashes.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{6}",
    "01234567|12345678|abcdefgh|ABCDEFGH",
    "^[A-Za-z]*([-_/=+]+([A-Za-z]+|[0-9]{1,4}))+[-_/=+]*$",
)
#: What stands right before a candidate that is no secret: addresses, and names of checksums.
ALLOWED_BEFORE = (
    "[A-Za-z]://[^\\x20\\t\\n\\x0B\\f\\r\"'<>]*$",
    "([Ss][Hh][Aa]-?(1|256|384|512)|[Mm][Dd]5|[Cc][Hh][Ee][Cc][Kk][Ss][Uu][Mm]|[Cc][Oo][Mm][Mm][Ii][Tt]|[Ii][Nn][Tt][Ee][Gg][Rr][Ii][Tt][Yy])[\"']?[\\x20:=-]{0,4}[\"']?$",
)
CONTEXT = 128

#: c * log2(c) in millionths: whole numbers, so that sums don't depend on the order.
PLOGP = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]


def most_plogp(bits: float) -> int:
    """The sum of PLOGP over a window's counts is at most this where its entropy is at least ``bits``."""
    return math.floor(1e6 * WINDOW * (math.log2(WINDOW) - bits))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, not once for each element of the arrays that ``then`` walks."""
    return F.get(F.transform(F.array(value), then), 0)


def _running(steps: Column, part: int = 256) -> Column:
    """Sums of the first 1, 2, ... numbers of an array: within parts, then over the parts, so that a long array isn't copied for each number."""

    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(a, start, lambda x, v: F.struct((x["s"] + v).alias("s"), F.array_append(x["all"], x["s"] + v).alias("all")), lambda x: x["all"])

    def joined(inner: Column) -> Column:
        totals = sums(F.concat(F.array(F.lit(0)), F.transform(inner, lambda a: F.element_at(a, -1))))
        return _let(totals, lambda before: F.flatten(F.transform(inner, lambda a, p: F.transform(a, lambda v: v + F.get(before, p)))))

    places = F.sequence(F.lit(0), F.ceil(F.size(steps) / F.lit(part)).cast("int") - 1)
    return _let(F.transform(places, lambda p: sums(F.slice(steps, p * part + 1, F.lit(part)))), joined)


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """(start, end, x, before) of each match: its place in code points, the match, and what stands between it and the match before."""

    def of(pieces: Column) -> Column:
        ends = _let(F.transform(found, lambda x, i: F.char_length(x) + F.char_length(F.get(pieces, i))), lambda steps: _running(steps))
        row = lambda x, i, e: F.struct((F.get(e, i) - F.char_length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("x"), F.get(pieces, i).alias("before"))
        return _let(ends, lambda e: F.transform(found, lambda x, i: row(x, i, e)))

    none = F.array().cast("array<struct<start int, end int, x string, before string>>")
    return F.when(F.size(found) > 0, _let(F.split(text, pattern, -1), of)).otherwise(none)


def _parts(spans: Column, part: int = 256) -> Column:
    """Spans in parts with the bounds of each, so that a look for those that touch another span needn't read all."""
    bounds = lambda a: F.struct(F.get(a, 0)["start"].alias("start"), F.array_max(F.transform(a, lambda s: s["end"])).alias("end"), a.alias("all"))
    places = F.filter(F.sequence(F.lit(0), F.floor(F.size(spans) / F.lit(part)).cast("int")), lambda p: p * part < F.size(spans))
    return F.transform(places, lambda p: bounds(F.slice(spans, p * part + 1, F.lit(part))))


def window_plogp(candidate: Column) -> Column:
    """The least sum of PLOGP over the windows of a candidate, which is where the entropy is greatest.

    Counts are carried from window to window: the character that comes in raises one of them, the one that goes out lowers one.
    """
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST_CODE)
    table = F.array(*[F.lit(x) for x in PLOGP])
    start = F.struct(F.array_repeat(F.lit(0), CODES).alias("counts"), F.lit(0).alias("sum"), F.lit(PLOGP[WINDOW]).alias("least"))

    def slide(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(-1))
            counts = F.transform(state["counts"], lambda c, j: c + (j == new).cast("int") - (j == old).cast("int"))
            up, down = F.get(state["counts"], new), F.get(state["counts"], old)
            change = F.get(table, up + 1) - F.get(table, up) + F.get(table, down - 1) - F.get(table, down)
            total = state["sum"] + F.when(new == old, F.lit(0)).when(old < 0, F.get(table, up + 1) - F.get(table, up)).otherwise(change)
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when((i >= WINDOW - 1) & (total < state["least"]), total).otherwise(state["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["least"])

    return _let(codes, slide)


def is_random(candidate: Column, before: Column, allow: Sequence[str] = ()) -> Column:
    """Whether some window of a candidate has the entropy that its character class asks for, and no entry of the allow-list holds it."""
    sound = [candidate.rlike(x) for x in NEEDS] + [~candidate.rlike(x) for x in (*ALLOWED, *allow)] + [~F.right(before, F.lit(CONTEXT)).rlike(x) for x in ALLOWED_BEFORE]
    most = F.lit(-1)
    for _, pattern, bits in reversed(CLASSES):
        most = F.when(candidate.rlike(pattern), F.lit(most_plogp(bits))).otherwise(most)
    out = F.lit(True)
    for condition in sound:
        out = out & condition
    return F.when(out, window_plogp(candidate) <= most).otherwise(F.lit(False))


def scan_secrets(df: DataFrame, text_col: str = "text", allow: Sequence[str] = ()) -> DataFrame:
    """Find the secrets of each row: all columns, and ``secret_base`` and ``secret_spans`` (arrays of start, kind, end).

    ``secret_base`` has what the fixed patterns match. ``secret_spans`` also has candidates, runs of at least 20 characters that keys are written with, if a
    window of 20 characters that slides over the run reaches the entropy of its character class, they touch no fixed match and are not on the allow-list
    (``allow`` adds patterns to it). Offsets count code points, ends are exclusive, spans come by start, then kind.

    Null and empty texts have no spans. Repeated rows are read each. A very long text is one row; what is done for it grows in proportion to its length.
    Columns of the two names are replaced, all others stay, an empty table gives an empty one. One pass, no shuffle, no Python.
    """
    df = df.drop("secret_base", "secret_spans")
    own, prefix = df.columns, "_scan"
    while any(c.lower().startswith(prefix) for c in own):
        prefix += "_"
    name = lambda x: f"{prefix}_{x}"
    text, base, run = F.col(name("text")), F.col(name("base")), F.col(name("run"))
    out = df.withColumn(name("text"), F.coalesce(F.col(text_col), F.lit("")))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = out.withColumns({name("run_m"): every(CANDIDATE), name("assign_m"): every(ASSIGN)})
    # what the other two kinds match holds a candidate
    out = out.withColumns({name(f"{k}_m"): F.when(F.size(name("run_m")) > 0, every(p)).otherwise(F.array().cast("array<string>")) for k, p in BASE[1:]})
    out = out.withColumns({name(k): _placed(text, F.col(name(f"{k}_m")), p) for k, p in (*BASE, ("run", CANDIDATE))})

    def fixed(kind: str, number: int) -> Column:
        found = F.col(name(kind))
        if kind == "assign":
            found = F.filter(found, lambda m: F.char_length(F.regexp_extract(m["x"], ASSIGN, 2)) >= LEAST_VALUE)
        return F.transform(found, lambda m: F.struct(m["start"], F.lit(number).alias("k"), m["end"]))

    def added(parts: Column) -> Column:
        touches = lambda a, b: (a["start"] < b["end"]) & (a["end"] > b["start"])
        free = F.filter(run, lambda m: ~F.exists(parts, lambda p: touches(p, m) & F.exists(p["all"], lambda s: touches(s, m))))
        return F.transform(F.filter(free, lambda m: is_random(m["x"], m["before"], allow)), lambda m: F.struct(m["start"], F.lit(len(BASE)).alias("k"), m["end"]))

    out = out.withColumn(name("base"), F.sort_array(F.concat(*[fixed(k, n) for n, (k, _) in enumerate(BASE)])))
    out = out.withColumn(name("all"), F.when(F.size(run) > 0, F.sort_array(F.concat(base, _let(_parts(base), added)))).otherwise(base))
    kinds = F.array(*[F.lit(k) for k, _ in BASE], F.lit("entropy"))
    named = lambda c: F.transform(c, lambda s: F.struct(s["start"].cast("long").alias("start"), F.get(kinds, s["k"]).alias("kind"), s["end"].cast("long").alias("end")))
    return out.select(*own, named(base).alias("secret_base"), named(F.col(name("all"))).alias("secret_spans"))


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs).drop("text")
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind, c: F.size(F.filter(c, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k, "secret_base") for k, _ in BASE], F.sha2(written("secret_base"), 256).alias("base_sha256"), written("secret_spans").alias("spans"), count("entropy", "secret_spans"))


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    allowed = " AND ".join([f"regexp_matches(found, '{x}')" for x in NEEDS] + [f"NOT regexp_matches(found, {quoted(x)})" for x in ALLOWED] + [f"NOT regexp_matches(right(piece, {CONTEXT}), {quoted(x)})" for x in ALLOWED_BEFORE])
    most = "CASE " + " ".join(f"WHEN regexp_matches(found, {quoted(p)}) THEN {most_plogp(bits)}" for _, p, bits in CLASSES) + " END"
    cut = " UNION ALL ".join(
        f"SELECT r, {n} AS k, '{k}' AS kind, regexp_extract_all(text, {quoted(p)}, 0) AS m, string_split_regex(text, {quoted(p)}) AS p FROM d"
        for n, (k, p) in enumerate((*BASE, ("entropy", CANDIDATE)))
    )
    least = f"length(regexp_extract(found, {quoted(ASSIGN)}, 2)) >= {LEAST_VALUE}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
cut AS ({cut}),
one AS (SELECT r, k, kind, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS found, unnest(p[1:len(m)]) AS piece FROM cut WHERE len(m) > 0),
placed AS (SELECT *, sum(length(piece) + length(found)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM one),
spans AS (SELECT r, k, kind, found, piece, CAST(e - length(found) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed),
base AS (SELECT r, k, kind, s, e FROM spans WHERE kind <> 'entropy' AND (kind <> 'assign' OR {least})),
free AS (
  SELECT c.*, {most} AS most FROM spans c WHERE kind = 'entropy' AND {allowed}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.e AND b.e > c.s)),
win AS (SELECT r, s, e, most, w, substr(found, w, {WINDOW}) AS x FROM (SELECT *, unnest(range(1, length(found) - {WINDOW} + 2)) AS w FROM free)),
chars AS (SELECT r, s, e, most, w, c, count(*) AS n FROM (SELECT r, s, e, most, w, unnest(string_split(x, '')) AS c FROM win) GROUP BY ALL),
sums AS (SELECT r, s, e, most, w, sum(({PLOGP})[n + 1]) AS t FROM chars GROUP BY ALL),
added AS (SELECT r, {len(BASE)} AS k, 'entropy' AS kind, s, e FROM sums GROUP BY r, s, e, most HAVING min(t) <= most),
text_of AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         count(*) FILTER (WHERE kind = 'entropy') AS n_entropy,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE kind <> 'entropy'), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
FROM d LEFT JOIN text_of USING (r)
"""


OP12_SQL = _sql()
