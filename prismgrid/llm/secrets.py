"""Secret scanning with SQL expressions only.

Base rules are regular expressions. Spark has no function that gives the places of all
matches, so they are derived: the text split at the pattern and the matches themselves
alternate, and running sums of their lengths are the places (in code points).

The method adds high-entropy spans. Candidate strings are cut to character classes (hex
digits, base64 letters); over each runs a window of fixed length whose Shannon entropy is
kept by incremental counts: a character that enters or leaves changes one count and the
sum of c*log2(c). A candidate is reported when some window reaches its class's threshold
and no allow-list rule knows it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base rules. {kind: (pattern, group that is measured, least length)}
BASE = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
# Of the two kinds without a group, the runs that are too short need not be matched at all:
# a match is as long as its run, and what a short run holds is shorter still.
_LONG = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}


@dataclass(frozen=True)
class Entropy:
    """A character class: candidates are whole runs of `chars`, at least `window` long, that `needs` finds something in."""

    kind: str
    chars: str
    alphabet: str
    window: int
    bits: float
    needs: str


# Character classes and thresholds, in bits a character.
CLASSES = (
    Entropy("entropy_hex", "0-9A-Fa-f", "0123456789abcdef", 16, 3.0, r"^(?=.*[0-9])(?=.*[A-Fa-f])"),
    Entropy("entropy_b64", "A-Za-z0-9+/_=-", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", 20, 3.8, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
)
# Strings that are no secrets.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx|test_?key",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^(?:0123456789abcdef)+$|^(?:abcdefghijklmnopqrstuvwxyz)",
    r"^[A-Z]?[a-z]+(?:[-_/][A-Z]?[a-z]+)*$",
)
#: Windows that are looked at in one piece of a run, so that memory does not follow the run's length; matches that are placed at a time.
PIECE, GROUP = 2048, 256


def _in_java(rule: str) -> str:
    """The rule with possessive repetitions of groups, for which Java's matcher needs no stack; they match the same here.

    A repetition of one of the groups above can be left in one way only, so giving back
    what it took never helps.
    """
    return re.sub(r"(\(\?:[^()]*\))([*+])", r"\1\2+", rule)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _places(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (start, match), in code points from 0.

    The running sums go through the matches in groups, as appending copies what is there:
    the work is in proportion to the matches, however many a text has.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"))  # evaluated once, not in the loop
    none, kind = F.array(), "array<struct<start:int,match:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["match"])).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), x["match"].alias("match"))).alias("out"))

    def group(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["at"].alias("at"), none.cast(kind).alias("out")), step)
        return _let(done, lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")))

    def all_of(x: Column) -> Column:
        cuts = F.sequence(F.lit(1), F.size(x), F.lit(GROUP))
        begin = F.struct(F.lit(0).alias("at"), none.cast(f"array<{kind}>").alias("out"))
        groups = F.aggregate(F.transform(cuts, lambda i: F.slice(x, i, GROUP)), begin, group, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(x) > 0, groups).otherwise(none.cast(kind))

    return _let(F.filter(both, lambda x: x["match"].isNotNull()), all_of)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of a base rule: array of (start, rank, kind, stop), matches that are too short dropped."""
    pattern, group, least = BASE[kind]
    rank = list(BASE).index(kind)
    if group:
        places = F.filter(_places(text, pattern), lambda m: F.length(F.regexp_extract(m["match"], f"^(?:{pattern})$", group)) >= least)
    else:
        places = _places(text, _LONG[kind])
    return F.transform(places, lambda m: _span(m["start"], rank, kind, m["start"] + F.length(m["match"])))


def _span(start: Column, rank: int, kind: str, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.cast("int").alias("stop"))


def top_entropy(s: Column, cls: Entropy) -> Column:
    """The highest Shannon entropy of any window of cls.window characters of s, by incremental counts.

    The counts by character are fields of a few bits in an array of long numbers: a
    character that enters or leaves changes one of them.
    """
    w, bits = cls.window, cls.window.bit_length()
    each = 63 // bits
    folded = F.lower(s) if cls.kind == "entropy_hex" else s

    def field(c: Column) -> Column:
        code = F.instr(F.lit(cls.alphabet), c) - 1
        shift = (code % each * bits).cast("int")
        return F.struct(F.floor(code / each).cast("int").alias("word"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("unit"))

    chars = F.transform(F.filter(F.split(folded, "", -1), lambda c: c != ""), field)
    before = F.struct(F.lit(0).alias("word"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("unit"))
    clog = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def move(acc: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]
        count = lambda y: F.call_function("shiftrightunsigned", F.get(acc["counts"], y["word"]), y["shift"]).bitwiseAND(F.lit(2**bits - 1))
        gain = _let(count(into), lambda c: clog(c + 1) - clog(c))
        loss = F.when(out["unit"] > 0, _let(count(out), lambda c: clog(c) - clog(c - 1))).otherwise(F.lit(0.0))
        total = acc["sum"] + F.when(into == out, F.lit(0.0)).otherwise(gain - loss)
        change = lambda y, j: F.when(y["word"] == j, y["unit"]).otherwise(F.lit(0))
        counts = F.transform(acc["counts"], lambda c, j: c + change(into, j) - change(out, j))
        return _let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.when(x["i"] >= w - 1, F.least(acc["least"], t)).otherwise(acc["least"]).alias("least")))

    def all_of(x: Column) -> Column:
        moves = F.arrays_zip(x.alias("into"), F.concat(F.array_repeat(before, w), F.slice(x, 1, F.size(x) - w)).alias("out"), F.sequence(F.lit(0), F.size(x) - 1).alias("i"))
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(cls.alphabet) // each)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))
        # H = log2(w) - sum(c log2 c) / w, so the highest entropy has the least sum
        return F.aggregate(moves, start, move, lambda acc: F.log2(F.lit(float(w))) - acc["least"] / w)

    return _let(chars, all_of)


def _in_pieces(s: Column, window: int, size: int, test) -> Column:
    """Whether test(piece) holds for any piece of s; pieces have `size` windows, so that each window is in one."""
    return F.exists(F.sequence(F.lit(0), F.length(s) - window, F.lit(size)), lambda i: test(F.substring(s, i + 1, F.lit(size + window - 1))))


def entropy_spans(text: Column, cls: Entropy, rank: int) -> Column:
    """Spans of the runs of a class in which some window reaches the threshold."""
    runs = _places(text, f"[{cls.chars}]{{{cls.window},}}")

    def keep(m: Column) -> Column:
        s = m["match"]
        known = F.lit(False)
        for rule in ALLOW:
            known = known | s.rlike(_in_java(rule))
        high = lambda x: top_entropy(x, cls) >= cls.bits - 1e-9
        some = _in_pieces(s, cls.window, PIECE * PIECE // 4, lambda x: _in_pieces(x, cls.window, PIECE, high))
        return F.when(~s.rlike(cls.needs) | known, F.lit(False)).otherwise(some)

    return F.transform(F.filter(runs, keep), lambda m: _span(m["start"], rank, cls.kind, m["start"] + F.length(m["match"])))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


_HINT = {
    "assign": r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]",
}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans by kind (assign, access, hex, entropy): arrays of (start, rank, kind, stop).

    Places are code points from 0, stop exclusive. A null text counts as empty and an
    empty one has no spans; every row gives one row, also if its doc_id is null or
    repeated. Columns other than doc_id and text are ignored. A very long text is scanned
    whole, runs in it piece by piece.
    """
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    out = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("assign", F.when(text.rlike(_HINT["assign"]), base_spans(text, "assign")).otherwise(none))
    out = out.withColumn("access", F.when(text.contains("AKIA"), base_spans(text, "access")).otherwise(none))
    out = out.withColumn("hex", F.when(text.rlike(_LONG["hex"]), base_spans(text, "hex")).otherwise(none))
    extra = []
    for i, cls in enumerate(CLASSES):
        run = f"[{cls.chars}]{{{cls.window},}}"
        extra.append(F.when(text.rlike(run), entropy_spans(text, cls, len(BASE) + i)).otherwise(none))
    return out.withColumn("entropy", F.concat(*extra)).select("doc_id", "assign", "access", "hex", "entropy")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, with a digest of the base spans."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, "entropy")).alias("spans"),
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_entropy(cls: Entropy) -> str:
    """SQL of entropy_spans()' conditions on a run m."""
    w, m = cls.window, "lower(m)" if cls.kind == "entropy_hex" else "m"
    needs = " AND ".join(f"regexp_matches(m, '{c}')" for c in re.findall(r"\.\*(\[[^]]+\])", cls.needs))
    known = " OR ".join(f"regexp_matches(m, {_quoted(rule)})" for rule in ALLOW)
    count = f"({w} - length(replace(substr({m}, i, {w}), c, '')))"
    top = f"list_max(list_transform(range(1, length(m) - {w} + 2), lambda i: log2({w}) - list_sum(list_transform(list_distinct(string_split(substr({m}, i, {w}), '')), lambda c: {count} * log2({count}))) / {w}))"
    return f"CASE WHEN {needs} AND NOT ({known}) THEN {top} >= {cls.bits} - 1e-9 ELSE FALSE END"


def _sql() -> str:
    rules = [(kind, p, f"length({f'regexp_extract(m, {_quoted(f"^(?:{p})$")}, {g})' if g else 'm'}) >= {n}") for kind, (p, g, n) in ((k, (_LONG.get(k, v[0]), *v[1:])) for k, v in BASE.items())]
    rules += [(c.kind, f"[{c.chars}]{{{c.window},}}", _sql_entropy(c)) for c in CLASSES]
    found = " UNION ALL ".join(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, string_split_regex(text, {_quoted(p)}) AS gap, regexp_extract_all(text, {_quoted(p)}) AS m FROM t" for rank, (kind, p, _) in enumerate(rules))
    good = " ".join(f"WHEN rank = {rank} THEN {test}" for rank, (_, _, test) in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (rank = {rank}) AS n_{kind}" for rank, kind in enumerate(BASE))
    joined = "string_agg(kind || ':' || (stop - length(m)) || ':' || stop, ',' ORDER BY stop - length(m), rank)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
u AS (SELECT doc_id, rank, kind, unnest(range(1, len(m) + 1)) AS i, unnest(list_slice(gap, 1, len(m))) AS gap, unnest(m) AS m FROM f),
p AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM u),
g AS (SELECT * FROM p WHERE CASE {good} END),
a AS (SELECT doc_id, {counts}, {joined} FILTER (rank < {len(BASE)}) AS base, {joined} AS spans FROM g GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (doc_id)
"""


SQL = {"op8_secrets": _sql()}
