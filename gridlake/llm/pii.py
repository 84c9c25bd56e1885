"""Personal data by column expressions alone: patterns propose spans, checksums confirm them, context words set the score.

Positions come from splitting at a pattern: the lengths of the pieces between matches and of the matches add up. The
patterns are written so that a text is read once from left to right whatever it holds: possessive repeats where giving
back can't help, and a look-behind that skips starts inside a run which failed at its first character.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, put_back


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    context: str  # words nearby that make the kind more likely
    score: float
    base: bool = True
    needs: str | None = None  # a text without this has no match


#: Kinds in their listed order, their patterns and context words.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"mail|contact|write", 0.8, needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\bip\b|host|server|address|login", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"card|visa|master|credit|payment|\bcc\b", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"tel|phone|call|mobile|fax", 0.6, needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"iban|account|bank|konto|cuenta|compte", 0.8, base=False),
    # numbers that stand next to others, which the wider base patterns take together and then drop
    Kind("card_number", r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])", r"card|visa|master|credit|payment|\bcc\b", 0.6, base=False),
    Kind("phone_number", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", r"tel|phone|call|mobile|fax", 0.6, base=False, needs="+"),
)
BASE = [k for k in KINDS if k.base]
#: Characters before a span in which context words count, and what they add to the score.
NEARBY, RAISE = 48, 0.2


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, without spaces, leaves 1 modulo 97 (first four signs last, letters as 10 to 35)."""
    turned = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def add(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, sign: F.when(sign == "", rest).otherwise(add(rest, sign))) == 1


def small(part: Column) -> Column:
    """Whether a string of digits is at most 255."""
    plain = F.ltrim(part, F.lit("0"))
    return F.when(F.length(plain) > 3, False).otherwise(F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)


def confirmed(kind: Kind, found: Column) -> Column:
    if kind.name == "ip":
        return F.forall(F.split(found, r"\."), small)
    if kind.name in ("card", "card_number"):
        digits = F.regexp_replace(found, "[ -]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind.name in ("phone", "phone_number"):
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(10, 15)
    if kind.name == "iban":
        plain = F.replace(found, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


#: Elements that a fold works on at a time: a list is copied when something is appended, so lists are built in short blocks.
BLOCK = 256


def running(name: str, join) -> Column:
    """For each value of the array column `name` (int), all values before it joined; 0 for the first. join: associative, 0 its zero.

    Blocks are folded alone, then the blocks' results, and each block again from what is before it. The array is a column and not an
    expression, which a lambda would work out again for every element.
    """
    values, zero, none = F.col(name), F.lit(0), F.array().cast("array<int>")
    block = lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK))

    def before(given: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        return F.aggregate(given, first, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    starts = before(F.transform(blocks, lambda i: F.aggregate(block(i), zero, join)), zero)
    whole = F.flatten(F.transform(starts, lambda start, i: before(block(i), start)))
    return F.when(F.size(values) <= BLOCK, before(values, zero)).otherwise(whole)


_SCORED = "array<struct<start:int,order:int,kind:string,end:int,score:double>>"


def _scored(order: int, kind: Kind) -> Column:
    """The confirmed matches of a kind with their scores. Context words count in the piece between the match before and this one."""

    def told(x: Column, at: Column) -> Column:
        piece, match = x["piece"], x["match"]
        start = at + F.length(piece)
        end = start + F.length(match)
        near = F.lower(F.substring(piece, -NEARBY, NEARBY)).rlike(kind.context)
        score = F.when(near, kind.score + RAISE).otherwise(kind.score)
        return F.when(match.isNotNull() & confirmed(kind, match), F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind.name).alias("kind"), end.alias("end"), score.alias("score")))

    both = F.zip_with(f"_pii_p_{kind.name}", f"_pii_m_{kind.name}", lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.filter(F.zip_with(both, f"_pii_b_{kind.name}", told), lambda s: s.isNotNull())


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs and `into`: array of (start, order, kind, end, score), by start, then kinds as listed.

    Null and empty texts have an empty array. Columns other than `text` are carried; temporary names start with `_pii_`. Work grows
    with a text's length and its number of matches.
    """
    body, out, none = F.coalesce(F.col(text), F.lit("")), docs, F.array().cast(_SCORED)
    named = lambda x, f: {f"_pii_{x}_{k.name}": f(k) for k in KINDS}
    of = lambda x, k: F.col(f"_pii_{x}_{k.name}")
    out = out.withColumns(named("p", lambda k: F.when(F.contains(body, F.lit(k.needs or "")), F.split(body, k.pattern, -1))))
    out = out.withColumns(named("m", lambda k: F.when(F.size(of("p", k)) > 1, F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0)))))
    out = out.withColumns(named("w", lambda k: F.zip_with(of("p", k), of("m", k), lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))))
    out = out.withColumns(named("b", lambda k: F.when(of("w", k).isNotNull(), running(f"_pii_w_{k.name}", lambda x, y: x + y))))
    out = out.withColumns(named("s", lambda k: F.when(of("m", k).isNotNull(), _scored(KINDS.index(k), k)).otherwise(none)))
    out = out.withColumn("_pii_all", F.array_sort(F.concat(*[F.col(f"_pii_s_{k.name}") for k in KINDS])))
    out = out.withColumn("_pii_ends", F.transform("_pii_all", lambda s: F.when(s["order"] < len(BASE), s["end"]).otherwise(0)))
    # an added span inside a base one is not told again: base spans that begin before it (or with it, being listed first) have gone by
    reach = F.when(F.size("_pii_ends") > 0, running("_pii_ends", lambda x, y: F.greatest(x, y))).otherwise(F.array().cast("array<int>"))
    both = F.zip_with("_pii_all", reach, lambda s, r: F.when((s["order"] < len(BASE)) | (r < s["end"]), s))
    temporary = ["_pii_all", "_pii_ends", *[f"_pii_{x}_{k.name}" for x in "pmwbs" for k in KINDS]]
    return out.withColumn(into, F.filter(both, lambda s: s.isNotNull())).drop(*temporary)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans and scores of each row.

    Null text is empty. Overlapping spans of different kinds all stay. Equal rows are each reported; no rows: no rows. Only doc_id
    and text are read. A text is searched whole; work grows with its length and its number of matches.
    """
    found = with_spans(docs.select("doc_id", "text"))
    own = F.filter("pii", lambda s: s["order"] < len(BASE))
    counts = [F.size(F.filter("pii", _is(k.name))).cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(own), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), F.transform("pii", lambda s: s["score"]).alias("scores"))


#: Code points of the parts that a text is cut to, so that a place is reached without a walk from the text's start.
PART = 1024


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in brackets; n_chars, where docs has it, follows. Null text stays null.

    Of overlapping spans the first is named and the others only cut. All other columns are carried as they are, whatever their
    names. Equal rows are each redacted; no rows: no rows. Work grows with a text's length and its number of matches.
    """
    own = [c for c in ("text", "n_chars") if c in docs.columns]
    found = with_spans(aside(docs, own), into="_spans")
    hit = F.size("_spans") > 0
    found = found.withColumn("_ends", F.transform("_spans", lambda s: s["end"]))
    found = found.withColumn("_upto", F.when(hit, running("_ends", lambda x, y: F.greatest(x, y))))
    found = found.withColumn("_parts", F.when(hit, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))))

    def cut(start: Column, end: Column) -> Column:
        """The text from start up to end."""
        of = lambda at: F.floor(at / PART).cast("int")

        def piece(i: Column) -> Column:
            low = F.greatest(start - i * PART, F.lit(0))
            return F.substring(F.get("_parts", i), low + 1, F.least(end - i * PART, F.lit(PART)) - low)

        return F.when(end <= start, "").otherwise(F.array_join(F.transform(F.sequence(of(start), of(end - 1)), piece), ""))

    def told(s: Column, upto: Column) -> Column:
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= upto, F.concat(cut(upto, s["start"]), mark)).otherwise("")

    last = F.greatest(F.element_at("_upto", -1), F.element_at("_spans", -1)["end"])
    clean = F.concat(F.array_join(F.zip_with("_spans", "_upto", told), ""), cut(last, F.length("text")))
    out = found.withColumn("_clean", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.when(hit, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("_clean")).select(put_back(out, docs.columns, own))
