"""Text expressions: trimming and word counts over all Unicode white space, content keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACE = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def word_count(text: Column) -> Column:
    """Runs of non-space characters; 0 for blank text.

    Naming the printable ASCII range first spares most characters the long list.
    """
    return F.regexp_count(text, F.lit(rf"[!-~[^{SPACE}]]+")).cast("long")


def content_digest(name: Column, text: Column) -> Column:
    """MD5 of ``name:text``."""
    return F.md5(F.concat(name, F.lit(":"), text))


def digest_key(digest: Column) -> Column:
    """First 32 bits of a digest, as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def content_key(name: Column, text: Column) -> Column:
    return digest_key(content_digest(name, text))


def fenced_sql(answer: Column) -> Column:
    """The first ``sql`` block of a Markdown answer, else its first block, else all of it."""
    fence = "```"

    def block(opening: str) -> Column:
        return F.split_part(F.split_part(answer, F.lit(opening), F.lit(2)), F.lit(fence), F.lit(1))

    inner = (
        F.when(F.contains(answer, F.lit(fence + "sql")), block(fence + "sql"))
        .when(F.contains(answer, F.lit(fence)), block(fence))
        .otherwise(answer)
    )
    return strip(inner)


def is_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.lit(False))
