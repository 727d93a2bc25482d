"""Personal data in texts, with native expressions only.

For each kind a regular expression proposes spans, left to right without
overlaps; a validator confirms them (Luhn for cards, mod 97 for IBANs, part and
digit counts), and words nearby, up to ``CONTEXT`` code points before or behind, raise the
score. Base kinds (email, ip, card, phone) are kept whenever their validator passes; added
kinds (iban, ssn, secret) only from ``MIN_SCORE`` on. A strong form reaches that by itself (an
IBAN, a number written as 123-45-6789, a key after its name); a weak one (nine digits, a
long run of letters and digits) only by a word nearby. Positions are code points, the end is exclusive.

The spans of one text come from a single pass per kind: matches are put between
marks, the text is split at the marks, and the lengths of the pieces add up to the
positions. Patterns use possessive groups, so no text makes them backtrack far
or recurse deeply. Null and empty texts have no spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
CONTEXT = 40  # code points on either side of a span that are searched for context words
_MARK = "\u0001"

# (kind, cheap test of the text, proposal, words nearby, score without and with them).
# A proposal starts where a run of its characters starts, or where the last match ended.
BASE = [
    ("email", lambda t: t.contains("@"),
     r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
     r"(?i)mail|contact|write|address|correo|courriel|contacter|schreib", 0.9, 1.0),
    ("ip", lambda t: F.col("__digit"),
     r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
     r"(?i)\bip\b|host|server|address|login|from", 0.6, 0.9),
    ("card", lambda t: F.col("__digit"),
     r"[0-9](?:[\x20-]?[0-9])++",
     r"(?i)card|visa|credit|debit|payment|tarjeta|carte|karte", 0.7, 1.0),
    ("phone", lambda t: t.contains("+"),
     r"\+[0-9][\x20().0-9-]+[0-9]",
     r"(?i)phone|call|tel|mobile|fax|móvil|appel|anruf", 0.7, 1.0),
]
ADDED = [
    ("iban", lambda t: F.col("__digit"),
     r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
     r"(?i)iban|bank|account|konto|cuenta|compte", 0.8, 1.0),
    ("ssn", lambda t: F.col("__digit"),
     "(?<![0-9-])(?!000|666|9)[0-9]{3}(?:" + "|".join(rf"{x}(?!00)[0-9]{{2}}{x}(?!0000)[0-9]{{4}}" for x in ("-", r"\x20", ""))
     + ")(?![0-9-])",
     r"(?i)\bssn\b|social|security|insurance|seguridad|sécurité|sozial",
     lambda span: F.when(span.contains("-"), 0.5).otherwise(0.2), 0.9),
    ("secret", lambda t: t.contains("AKIA") | t.rlike("(?i)pass(?:word|wd)|secret|token|api.?key"),
     r"(?<![A-Z0-9])AKIA[A-Z0-9]{16}(?![A-Z0-9])"
     r"|(?i:(?<![a-z0-9])(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9/+_.-]{8,}+)"
     r"|(?<![A-Za-z0-9/+_-])(?=[A-Za-z/+_-]{0,40}[0-9])(?=[0-9/+_-]{0,40}[A-Za-z])[A-Za-z0-9/+_-]{20,}+",
     r"(?i)\bkey|login|secret|passw|token",
     lambda span: F.when(span.rlike("^AKIA|[=:]"), 0.6).otherwise(0.3), 0.9),
]
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def mod97(text: Column) -> Column:
    """Remainder of an IBAN, moved and spelled in digits."""
    chars = F.split(F.regexp_replace(text, " ", ""), "")
    moved = F.concat(F.slice(chars, 5, F.greatest(F.size(chars) - 4, F.lit(0))), F.slice(chars, 1, 4))

    def step(r, c):
        v = F.ascii(c)
        return F.when(v >= 65, (r * 100 + v - 55) % 97).otherwise((r * 10 + v - 48) % 97)

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step)


def _valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(s) == 1
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _spans(kind: str, text: Column, test, pattern: str, words: str, low, high: float) -> Column:
    """Valid spans of one kind, in order. ``low``: the score without words nearby, a
    number or a function of the span."""
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    # each piece with the beginning of the next one
    both = F.zip_with(pieces, F.slice(pieces, F.lit(2), F.size(pieces)), lambda p, n: F.struct(
        p.alias("piece"), F.substring(F.coalesce(n, F.lit("")), 1, CONTEXT).alias("next")))

    def step(acc, x):
        piece = x["piece"]
        end = acc["at"] + F.length(piece)
        before = F.concat(acc["tail"], piece)
        alone = low(piece) if callable(low) else F.lit(low)
        score = F.when(acc["tail"].rlike(words) | x["next"].rlike(words), F.lit(high)).otherwise(alone)
        span = F.struct(F.lit(kind).alias("kind"), acc["at"].alias("start"), end.alias("end"), score.alias("score"))
        return F.struct(
            end.alias("at"), (~acc["inside"]).alias("inside"),
            F.substring(before, -CONTEXT, CONTEXT).alias("tail"),
            F.when(acc["inside"] & _valid(kind, piece), F.concat(acc["out"], F.array(span)))
            .otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.lit("").alias("tail"),
                     F.from_json(F.lit("[]"), _SPANS).alias("out"))
    found = F.aggregate(both, start, step, lambda acc: acc["out"])
    return F.when(test(text), found).otherwise(F.from_json(F.lit("[]"), _SPANS))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``found``: spans (kind, start, end, score), base kinds first,
    each kind in order of position."""
    # the mark itself is no part of any pattern; in texts another control character stands for it
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, "\u0003")
    marked = docs.select(F.col(id_col), text.alias("__text")).withColumn("__digit", F.col("__text").rlike("[0-9]"))
    base = [_spans(k, F.col("__text"), *rest) for k, *rest in BASE]
    added = [F.filter(_spans(k, F.col("__text"), *rest), lambda s: s["score"] >= MIN_SCORE) for k, *rest in ADDED]
    return marked.select(id_col, F.concat(*base, *added).alias("found"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every text, one row per row of the input."""
    found = find(docs, id_col, text_col)

    def of(kinds):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [k for k, *_ in BASE]
    return found.select(
        id_col, *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(of(base)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
