"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Base kinds (email, ip, card, phone) stand by their pattern and check alone; their score only tells how
sure they are. Added kinds are reported if their score reaches ``ACCEPT``: IBANs (mod-97), and national
ids and local phone numbers, for which a word nearby must speak.

Everything is built-in functions. A pattern is applied twice: its matches and the gaps between
them; the running sum of both gives each match's place in code points. That sum is a window
over the matches of one document, so it stays linear in a text full of numbers.

Patterns start only where the leftmost match could (not inside a run that has failed already) and
never give back what they took, so long runs cost linear time and no stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallywork.llm.common import named, text_of

ACCEPT = 0.6
NEAR = 40
LOCAL = r"[A-Za-z0-9._%+-]"
#: Fixed: characters of an IBAN by country.
IBANS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
_SIZED = "".join((
    r"(?=[A-Z]{2}[0-9]{2})(?:",
    "|".join(rf"(?:{lands})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{size - 4}}}" for size, lands in IBANS.items()),
    ")(?![A-Za-z0-9])",
))
#: An IBAN of its country's length, whatever follows; else a run of that form, up to where such a one begins.
IBAN = rf"(?<![A-Za-z0-9])(?:{_SIZED}|[A-Z]{{2}}[0-9]{{2}}(?:\x20(?!{_SIZED})[A-Z0-9]|[A-Z0-9]){{11,30}}(?![A-Za-z0-9]))"


@dataclass(frozen=True)
class Kind:
    """A pattern, the score of a confirmed match, and words nearby (lower case) that add ``BOOST``."""

    name: str
    pattern: str
    score: float
    words: str
    base: bool = False


BOOST = 0.3
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, "mail|contact|write", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|visa|credit|payment|account", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", True),
    Kind("iban", IBAN, 0.7, "iban|account|bank|konto|compte|cuenta"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"ssn|social security|national id|\bid\b"),
    Kind(
        "local_phone", r"(?<![0-9+])(?<![0-9)][\x20().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        0.3, r"phone|\btel|call|mobile|fax",
    ),
)


def _digit(text: Column, at: Column) -> Column:
    return F.ascii(F.substr(text, at, F.lit(1))) - 48


def luhn(digits: Column) -> Column:
    """The check digit rule of payment cards over a string of digits."""
    def part(i: Column) -> Column:
        value = _digit(digits, F.length(digits) - i)
        double = F.when(value > 4, 2 * value - 9).otherwise(2 * value)
        return F.when(i % 2 == 1, double).otherwise(value)

    places = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part)
    return F.aggregate(places, F.lit(0), lambda total, x: total + x) % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 over an IBAN without spaces: the first four characters go last, letters count from 10."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        account = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(account).between(15, 34), mod97(account)).otherwise(F.lit(False))
    return F.lit(True)


def _proposals(text: Column, kind: Kind) -> Column:
    """Array of (kind, nth, gap, size, ok, and the nearest characters), one per match in order; null without a match."""
    matches, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    # Zipped, so that each array is made once, not once per match; the last gap has no match.
    zipped = F.arrays_zip(matches, gaps, F.slice(gaps, F.lit(2), F.size(gaps)))

    def one(x: Column, i: Column) -> Column:
        match, before, after = x["0"], x["1"], x["2"]
        near = F.lit(NEAR)
        return F.struct(
            F.lit(kind.name).alias("kind"), i.alias("nth"), F.length(before).alias("gap"), F.length(match).alias("size"),
            _confirmed(kind.name, match).alias("ok"), F.right(before, near).alias("before"), F.left(after, near).alias("after"),
            F.right(F.concat(before, match), near).alias("upto"), F.left(F.concat(match, after), near).alias("onward"),
        )

    return F.when(text.rlike(kind.pattern), F.transform(F.filter(zipped, lambda x: x["0"].isNotNull()), one))


def _near(order: WindowSpec) -> Column:
    """The ``NEAR`` characters on either side of a match, lower case. Each match or gap adds one at least, so as many neighbours suffice."""
    earlier = F.collect_list("upto").over(order.rowsBetween(-NEAR, -1))
    later = F.collect_list("onward").over(order.rowsBetween(1, NEAR))
    before = F.right(F.concat(F.array_join(earlier, ""), "before"), F.lit(NEAR))
    # What follows the next match is in that match's piece, so the gap between the two counts once.
    after = F.left(F.concat("after", F.array_join(later, "")), F.lit(NEAR))
    return F.lower(F.concat_ws(" ", before, after))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and spans, an array of (kind, start, end, score) in code points, end exclusive.

    Spans come by kind as in ``KINDS``, then by start. A null or empty text has none (an empty array). Rows that
    repeat are looked at one by one; ids may be null or repeat. Only two columns are read.
    """
    text = F.col("text")
    found = F.concat(*[F.coalesce(_proposals(text, kind), F.array()) for kind in KINDS])
    rows = (
        docs.select(named(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("place"), text_of(text_col).alias("text"))
        .select("doc_id", "place", F.explode_outer(found).alias("m")).select("doc_id", "place", "m.*")
        .repartition("place")
    )
    order = Window.partitionBy("place", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(KINDS) for x in (k.name, n)]), F.col("kind"))
    placed = rows.select(
        "doc_id", "place", "kind", "ok", rank.alias("rank"), (end - F.col("size")).alias("start"), end.alias("end"), _near(order).alias("near")
    )
    score, base = F.lit(None).cast("double"), F.lit(False)
    for k in KINDS:
        own = F.col("kind") == k.name
        score = F.when(own, F.lit(k.score) + F.when(F.col("near").rlike(k.words), F.lit(BOOST)).otherwise(F.lit(0.0))).otherwise(score)
        base = base | (own & F.lit(k.base))
    placed = placed.withColumn("score", score).withColumn("ok", F.col("ok") & (base | (F.col("score") >= ACCEPT)))
    span = F.when(F.col("ok"), F.struct("rank", "start", "end", "kind", "score"))
    listed = placed.groupBy("place").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    return listed.select(
        "doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"))).alias("spans")
    )
