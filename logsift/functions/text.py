"""Column functions over evidence text: folding, tokens, snippets, chunks."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions.patterns import IPV4, IPV6

#: Latin letters with marks and the plain letters they are searched as.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďđēęěğīłńňōőřśšťūůűźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccddeeegilnnoorsstuuuzzz"


def text(c: Column | str) -> Column:
    """A cell as text, null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only, as the comparison operators do."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def clip(c: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis where something was cut off."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def search_tokens(c: Column) -> Column:
    """Tokens of the phrase search, each with a space before and one after the last.

    Tokens are runs of letters and digits, in lower case, Latin marks folded.
    """
    folded = F.translate(F.lower(c), _MARKED, _PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def search_phrase(value: str) -> str:
    """The same for a search value."""
    import re

    folded = value.lower().translate(str.maketrans(_MARKED, _PLAIN))
    words = [w for w in re.split(r"[\W_]+", folded) if w]
    return f" {' '.join(words)} " if words else ""


def leading_number(c: Column) -> Column:
    """The number at the start of a text, 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


# templates: what stands for a changing part of a log line
_EDGE = r"\p{Punct}&&[^./]"


def _kind(core: str) -> str:
    """A pattern of a whole token: marks at its edges, and a core that has none of them at its ends."""
    return rf"(?<!\S)([{_EDGE}]*+)(?:{core})(?<![{_EDGE}])([{_EDGE}]*+)(?!\S)"


_KINDS = (
    (f"{IPV4}|{IPV6}", "<ip>"), (r"[sS]-1-\S*", "<sid>"),
    (r"(?=[0-9a-fA-F-]{36}(?![0-9a-fA-F]))(?:[0-9a-fA-F]*-){4}[0-9a-fA-F]*", "<guid>"), (r"[0-9a-fA-F]{16,}", "<hash>"),
)


def normalize_tokens(c: Column) -> Column:
    """White-space tokens in lower case, addresses, identifiers, hashes and numbers replaced by their kind."""
    plain = F.regexp_replace(trim(c), r"\s+", " ")
    line = plain
    for core, kind in _KINDS:
        line = F.regexp_replace(line, _kind(core), f"$1{kind}$2")
    line = F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "<number>"), r"\p{Cntrl}", " ")
    # many cells have nothing to replace
    return F.when(c.rlike(r"[0-9:]|[a-fA-F]{16}|[\p{Cntrl}&&[^\s]]"), line).otherwise(F.lower(plain))


def informative(c: Column) -> Column:
    """At least three letters."""
    return c.rlike(r"(?s)\p{L}.*\p{L}.*\p{L}")


def word_chunks(c: Column, size: int = 72, overlap: int = 12, most: int | None = 4, chars: int = 2048, cell_chars: int | None = 16_384) -> Column:
    """Chunks of ``size`` words, each starting ``size - overlap`` words after the one before."""
    step = size - overlap
    cut = F.substring(c, 1, cell_chars) if cell_chars else c
    words = F.filter(F.split(cut, r"\s+"), lambda w: w != "")
    count = F.greatest(F.lit(1), F.ceil((F.size(words) - overlap) / F.lit(step))).cast("int")
    count = F.least(count, F.lit(most)) if most else count
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.array_join(F.slice(words, i * step + 1, size), " "), 1, chars))
    return F.filter(chunks, lambda x: x != "")
