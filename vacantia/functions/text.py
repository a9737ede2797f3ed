"""Text helpers whose results equal Python's on the same text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text, which are
# the Unicode spaces and the four ASCII separators.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space, no-break spaces included, at both ends.

    Trimming only looks at the ends; a regular expression would walk whole documents.
    """
    return F.btrim(text, F.lit(_SPACES))


def or_default(text: Column, default: str | Column) -> Column:
    """``default`` where the text is null or empty."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def percent_encode(text: Column) -> Column:
    """Percent-encode as a URL path part is: ``/`` and ``~`` stay, a space is ``%20``.

    ``url_encode`` follows the form rules; the four replacements turn its result into the
    path form. A literal ``+`` is already ``%2B`` when the first replacement runs.
    """
    encoded = F.url_encode(text)
    for form, path in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(form), F.lit(path))
    return encoded


def grouped_thousands(amount: Column) -> Column:
    """Integer part with a plain space between groups of three digits.

    The cast comes first because ``format_number`` rounds and the rule truncates.
    """
    return F.replace(F.format_number(amount.cast("bigint"), 0), F.lit(","), F.lit(" "))


def is_set(number: Column) -> Column:
    """True where a number is neither null nor zero."""
    return F.coalesce(number != 0, F.lit(False))


def line_count(text: Column) -> Column:
    """Lines of a text, counting the one after the last line break."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def json_list(text: Column) -> Column:
    """JSON array of strings; null for null, empty or malformed text."""
    return F.from_json(F.nullif(text, F.lit("")), "array<string>")


def json_list_text(items: Column) -> Column:
    """List of strings as JSON text with ``", "`` between the items, as stored and exported."""

    def quoted(item: Column) -> Column:
        alone = F.to_json(F.array(item))
        return F.substr(alone, F.lit(2), F.length(alone) - 2)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))
