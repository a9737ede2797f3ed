"""Generated documents: fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia.functions.text import strip

_FENCE = "```"
_HTML_FENCE = "```html"


def strip_fence(text: Column) -> Column:
    """Remove one Markdown fence at the head and one at the tail of an answer.

    Only the two ends are looked at. Stripping after each removal takes the white space
    and line break that belong to the fence.
    """
    answer = strip(text)
    opened = strip(
        F.when(F.startswith(answer, F.lit(_HTML_FENCE)), F.substr(answer, F.lit(len(_HTML_FENCE) + 1)))
        .when(F.startswith(answer, F.lit(_FENCE)), F.substr(answer, F.lit(len(_FENCE) + 1)))
        .otherwise(answer)
    )
    closed = F.when(
        F.endswith(opened, F.lit(_FENCE)), F.left(opened, F.length(opened) - len(_FENCE))
    ).otherwise(opened)
    return strip(closed)
