"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

A text is split at a kind's matches, so that the pieces and matches give every
span's place and the words around it in one pass over the row. Patterns start
only where a match can start and never backtrack over what they have taken, so
that long runs of letters or digits cost no more than their length. All of it is
DataFrame functions on a document's own row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

BEFORE, AFTER, BLOCK, THRESHOLD = 40, 20, 128, 0.5
CONFIRMED, NEAR, AGAINST = 0.2, 0.3, -0.3
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _running(xs: Column) -> Column:
    """Running sums of an array of numbers, by blocks so that a long array is not copied for each element."""
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long"))
    scan = lambda ys: F.aggregate(ys, none, lambda a, x: F.concat(a, F.array(last(a) + x)))

    def joined(local: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), scan(F.transform(local, last)))
        return let(ends, lambda e: F.flatten(F.transform(local, lambda ys, i: F.transform(ys, lambda y: y + F.get(e, i)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: scan(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(xs) > 0, let(blocks, joined)).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    each = F.transform(
        F.split(F.reverse(digits), "(?!^)(?!$)"),
        lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda x: F.when(x > 9, x - 9).otherwise(x)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number's letters and digits leave 1 modulo 97, its first four moved to the end."""
    turned = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), lambda a, c: (F.when(c.rlike("^[0-9]$"), a * 10).otherwise(a * 100) + value(c)) % 97)
    return rest == 1


def _small_parts(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card(text: Column) -> Column:
    return let(_digits(text), lambda d: F.length(d).between(16, 19) & luhn(d))


def _always(text: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    #: Finds the leftmost non-overlapping matches; hint, if not null, must hold for there to be any.
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column] = _always
    score: float = 0.5
    checked: bool = False
    near: tuple[str, ...] = ()
    against: tuple[str, ...] = field(default=("example", "version", "isbn", "sample"))
    #: Base kinds are kept whatever their score.
    base: bool = True


#: Countries by the length of their account numbers (the IBAN registry).
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """A known country's number has its length, so that what follows it is not taken; others go on until one of a known country starts."""
    group, known = "[A-Z0-9]{4}", "|".join(_LENGTHS.values()).replace(" ", "|")
    fixed = lambda n: f"(?: ?{group}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    listed = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}{fixed(n)}" for n, codes in _LENGTHS.items())
    gap = f"(?: (?!(?:{known})[0-9]{{2}}))?+"
    other = f"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:{gap}{group}){{2,7}}+(?:{gap}[A-Z0-9]{{1,3}}+)?+"
    return f"(?<![A-Za-z0-9])(?:{listed}|{other})(?![A-Za-z0-9])"


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS: tuple[Kind, ...] = (
    # A match starts where a run of local characters starts, or where the match before has ended within it.
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), score=0.9, near=("mail", "contact", "write")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _small_parts, 0.6, near=("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), _card, 0.6, True, ("card", "visa", "credit", "payment")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(8, 15), 0.6, near=("phone", "tel", "call", "fax", "mobile")),
    Kind(
        "iban", _iban(), lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
        lambda m: let(F.translate(m, " ", ""), lambda c: F.length(c).between(15, 34) & mod97(c)), 0.5, True, ("iban", "account", "bank"), base=False,
    ),
    Kind(
        "ssn", r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"),
        score=0.3, near=("ssn", "social", "security"), base=False,
    ),
    Kind(
        "secret", r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])", lambda t: t.rlike("[0-9a-fA-F]{32}"),
        score=0.3, near=("token", "secret", "password", "key", "auth"), base=False,
    ),
)


def _spans(text: Column, kind: Kind) -> Column:
    """The kind's valid spans as structs of kind, start, end (code points, end exclusive) and score."""
    none = F.array().cast(_SPAN)

    def placed(ms: Column, ps: Column) -> Column:
        steps = F.transform(ms, lambda m, i: (F.length(m) + F.length(F.get(ps, i))).cast("long"))

        def span(ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                around = F.lower(F.concat(F.substring(F.get(ps, i), -BEFORE, BEFORE), F.lit("\n"), F.substring(F.get(ps, i + 1), 1, AFTER)))
                said = lambda names: around.rlike(r"(?<!\p{L})(?:" + "|".join(names) + ")") if names else F.lit(False)
                score = (
                    F.lit(kind.score + CONFIRMED * kind.checked)
                    + F.when(said(kind.near), NEAR).otherwise(0.0)
                    + F.when(said(kind.against), AGAINST).otherwise(0.0)
                )
                return F.struct(
                    F.lit(kind.name).alias("kind"), (F.get(ends, i) - F.length(m)).cast("long").alias("start"),
                    F.get(ends, i).alias("end"), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6).alias("score"), kind.valid(m).alias("valid"),
                )

            good = F.filter(F.transform(ms, one), lambda s: s["valid"] & (F.lit(kind.base) | (s["score"] >= THRESHOLD)))
            return F.transform(good, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "score"))))

        return let(_running(steps), span)

    found = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    pieces = F.split(text, kind.pattern, -1)
    spans = let(found, lambda ms: F.when(F.size(ms) > 0, let(pieces, lambda ps: placed(ms, ps))).otherwise(none))
    return F.when(kind.hint(text), spans).otherwise(none)


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id and spans by kind, each an array of structs (kind, start, end, score).

    Null and empty texts have no spans. Rows are judged one by one, so repeated
    rows repeat their spans. Spans of different kinds may overlap. Texts of any
    length are read whole, in time that grows with their length. Null ids are
    kept; other columns are not read.
    """
    rows = docs.select(docs[id].alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_t"))
    return rows.select(F.col("_id").alias(id), *(_spans(F.col("_t"), k).alias(k.name) for k in KINDS))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each base or scored span of its text in place of which stands [KIND].

    Spans that overlap are taken from the left, longer first; null texts stay null.
    """
    t = F.coalesce(docs[text], F.lit(""))
    every = F.sort_array(F.transform(F.concat(*(_spans(t, k) for k in KINDS)), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        cut = F.concat(a["out"], F.substr(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= a["at"], F.struct(cut.alias("out"), (-s["back"]).alias("at"))).otherwise(a)

    done = F.aggregate(every, state, step, lambda a: F.concat(a["out"], F.substr(t, (a["at"] + 1).cast("int"), F.length(t))))
    return docs.withColumn(text, F.when(docs[text].isNotNull(), done))
