"""Secret scanning with DataFrame functions only: fixed patterns plus sliding-window entropy.

Match positions come from splitting the text at a pattern: the lengths of what lies between matches and of the matches
themselves add up to code-point offsets. Candidate strings are then scanned by a window of ``WINDOW`` characters whose
Shannon entropy is kept up to date by the counts of the one character that enters and the one that leaves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quadrille.llm.storage import fresh

#: The kinds and their patterns. Words match in either ASCII case.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")
LEAST_VALUE = 6

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What '=', '/' and '+' leave of a candidate, to hold against the allow list, and stretches of letters and digits in it.
PIECE = r"[A-Za-z0-9_-]{20,}"
STRETCH = r"[A-Za-z0-9]{20,}"


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings: its alphabet (a character outside it counts as the last), a pattern for whole
    candidates and the entropy in bits from which a window is suspicious."""

    kind: str
    alphabet: str
    pattern: str
    bits: float


CLASSES = (
    CharClass("entropy_hex", "0123456789abcdef", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    CharClass("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).*[^0-9A-Fa-f].*$", 3.75),
    CharClass("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", r"^(?=.*[0-9])(?=.*[g-z])[0-9a-z]+$", 3.5),
    CharClass("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"^(?=.*[0-9])(?=.*[G-Z])[0-9A-Z]+$", 3.5),
)
#: A stretch that is only a part of its candidate is scanned too if it has digits and letters of one case; with both
#: cases its candidate is scanned whole as base64.
GLUED = (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$")
#: Candidates that match one of these are not secrets: UUIDs, sub-resource digests, named samples, one repeated character.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^sha(256|384|512)-",
    r"(?i)(example|sample|placeholder|dummy|changeme)",
    r"^(.)\1*$",
)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _spans(text: Column, pattern: str, kind: int, least: tuple[int, int] | None = None) -> Column:
    """Array of struct(start, kind, end) of the leftmost non-overlapping matches; ``least`` (group, characters) drops
    matches whose group is shorter, after they have taken their place."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0])) if least else found
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), size.alias("part"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        keep = F.length(x["part"]) >= (least[1] if least else 0)
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The spans of the three fixed kinds, by start, then kind. Every match of the last two lies in a candidate, so a
    text without candidates is passed over once, not three times; without ':' or '=' nothing is assigned."""
    assigned = F.when(text.contains(":") | text.contains("="), _spans(text, ASSIGN, 0, (2, LEAST_VALUE))).otherwise(_none())
    others = F.when(text.rlike(CANDIDATE), F.concat(_spans(text, ACCESS, 1), _spans(text, HEX, 2))).otherwise(_none())
    return F.array_sort(F.concat(assigned, others))


#: Counts of a window fit in 5 bits; so many share a long.
COUNT_BITS, PER_LONG = 5, 12


def _windows(candidate: Column, start: Column, cls: CharClass) -> Column:
    """Maximal stretches of ``candidate`` covered by windows with at least ``cls.bits`` bits, as spans.

    State: characters seen, counts per character of the window packed in a few longs, the sum of n log2 n over them, the
    stretch that is open, and the spans before it. A window's entropy is log2 W - sum / W; each step reads two counts,
    changes the sum by two terms and adds one unit to the counts and takes one from them.
    """
    kind, n = KINDS.index(cls.kind), len(cls.alphabet)
    most = math.log2(WINDOW) * WINDOW - cls.bits * WINDOW + 1e-9  # entropy >= bits, as a bound of the sum
    term = F.array(*[F.lit(i * math.log2(i) if i else 0.0) for i in range(WINDOW + 1)])
    folded = F.lower(candidate) if cls.alphabet == cls.alphabet.lower() else candidate
    chars = F.transform(
        F.split(F.translate(folded, cls.alphabet, "".join(map(chr, range(0x100, 0x100 + n)))), ""),
        lambda c: F.least(F.ascii(c) - 0x100, F.lit(n - 1)),
    )

    def place(i: Column) -> Column:
        return F.struct((i / PER_LONG).cast("int").alias("word"), (i % PER_LONG * COUNT_BITS).alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), (i % PER_LONG * COUNT_BITS).cast("int")).alias("unit"))

    none = F.struct(F.lit(-1).alias("word"), F.lit(0).alias("shift"), F.lit(0).cast("long").alias("unit"))
    places = F.transform(chars, place)
    steps = F.arrays_zip(places.alias("new"), F.concat(F.array_repeat(none, WINDOW), places).alias("old"))

    def add(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        same = (new["word"] == old["word"]) & (new["shift"] == old["shift"])

        def count(c: Column) -> Column:
            return F.call_function("shiftright", F.get(acc["counts"], c["word"]), c["shift"]).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

        after = F.transform(
            acc["counts"],
            lambda w, k: w + F.when(new["word"] == k, new["unit"]).otherwise(F.lit(0).cast("long")) - F.when(old["word"] == k, old["unit"]).otherwise(F.lit(0).cast("long")),
        )
        came = F.get(term, count(new) + 1) - F.get(term, count(new))
        left = F.when(old["word"] >= 0, F.get(term, count(old) - 1) - F.get(term, count(old))).otherwise(0.0)
        total, seen = acc["sum"] + F.when(same, 0.0).otherwise(came + left), acc["seen"] + 1
        first, end = start + seen - WINDOW, start + seen
        hit, joins = (seen >= WINDOW) & (total <= most), acc["end"] >= first
        closed = F.when(hit & ~joins & (acc["end"] >= 0), F.concat(acc["out"], F.array(_span(acc["start"], kind, acc["end"])))).otherwise(acc["out"])
        return F.struct(
            seen.alias("seen"), after.alias("counts"), total.alias("sum"),
            F.when(hit & ~joins, first).otherwise(acc["start"]).alias("start"), F.when(hit, end).otherwise(acc["end"]).alias("end"), closed.alias("out"),
        )

    begin = F.struct(
        F.lit(0).alias("seen"), F.array_repeat(F.lit(0).cast("long"), -(-n // PER_LONG)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(-1).alias("start"), F.lit(-1).alias("end"), _none().alias("out"),
    )
    return F.aggregate(
        F.filter(steps, lambda x: x["new"].isNotNull()), begin, add,
        lambda acc: F.when(acc["end"] >= 0, F.concat(acc["out"], F.array(_span(acc["start"], kind, acc["end"])))).otherwise(acc["out"]),
    )


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _hits(text: Column, pattern: str, start: Column | int = 0) -> Column:
    """Array of struct(start, hit) of the matches; ``start`` is where ``text`` begins."""
    return F.transform(_spans(text, pattern, 0), lambda s: F.struct((s["start"] + start).alias("start"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("hit")))


def entropy_spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of the entropy kinds in candidates, and in stretches of them, that no pattern of ``allow`` suppresses."""
    empty = _none()
    whole = _hits(text, CANDIDATE)
    suspects = F.filter(whole, lambda c: ~_any(c["hit"], allow) & _any(c["hit"], tuple(x.pattern for x in CLASSES)))
    pieces = F.filter(_hits(text, PIECE), lambda c: ~_any(c["hit"], allow))
    parts = F.flatten(F.transform(pieces, lambda c: _hits(c["hit"], STRETCH, c["start"])))
    glued = F.filter(parts, lambda c: _any(c["hit"], GLUED) & ~F.exists(whole, lambda w: (w["start"] == c["start"]) & (w["hit"] == c["hit"])))

    def scan(c: Column) -> Column:
        return F.concat(*[F.when(c["hit"].rlike(x.pattern), _windows(c["hit"], c["start"], x)).otherwise(empty) for x in CLASSES])

    return F.when(text.rlike(CANDIDATE), F.flatten(F.transform(F.concat(suspects, glued), scan))).otherwise(empty)


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of struct(start, kind, end), the kind an index of
    ``KINDS``; offsets in code points, end exclusive, sorted by start, then kind).

    Null and empty texts have no spans; whole texts are scanned whatever their length; repeated rows each get a row;
    other columns are not read. There is no shuffle and no Python on the executors.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    found = rows.select("doc_id", base_spans(F.col("__text")).alias("base"), entropy_spans(F.col("__text"), allow).alias("__more"))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "__more")).alias("spans"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of ``scan``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return scan(docs, id_col, text_col).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with each stretch that spans cover replaced by ``mark``; rows without spans are unchanged, null texts
    stay null, and all columns keep their names, types and order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, spans = fresh(docs, "__base"), fresh(docs, "__spans")
    rows = docs.withColumn(base, base_spans(text)).withColumn(spans, F.array_sort(F.concat(base, entropy_spans(text, allow))))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])
        more = F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).when(
            acc["at"] == 0, F.array(F.lit(mark))
        ).when(s["start"] == acc["at"], F.concat(acc["out"], F.array(F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), acc["at"] + 1, F.length(F.col(text_col))))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.when(F.size(spans) > 0, F.aggregate(spans, begin, add, end)).otherwise(F.col(text_col))
    return rows.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
