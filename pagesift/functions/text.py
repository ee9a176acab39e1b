"""Text column functions, all JVM-side built-ins (no Python on the row path).

Each function takes and returns a ``Column``; they compose inside
``transform``/``filter`` lambdas over nested block arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesift.functions.exprs import let
from pagesift.functions.html_blocks import LINK_BEGIN, LINK_END

# ---- fixed values: must equal the reference's token classes ----
DIGIT_CLASS = "<DIGITS>"
LONG_CLASS = "<LONG>"
LONG_TOKEN_CHARS = 16          # tokens longer than this become LONG_CLASS
SENTENCE_DELIMITERS = ".,?!"   # characters counted as sentence ends
# ---- end of fixed values ----

# Characters Python's str.strip() removes: ASCII whitespace plus the
# Unicode separators (trimmed from the ends only, never scanned for).
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
_MARKER_RE = "<<LINK<<|>>LINK>>"
_ANCHOR_RE = "<<LINK<<(.*?)>>LINK>>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Unicode-aware strip of both ends."""
    return F.trim(_c(col), F.lit(STRIP_CHARS))


def normalize_text(col) -> Column:
    """ASCII whitespace runs -> one space, then strip (Unicode-aware)."""
    return strip(F.regexp_replace(_c(col), r"\s+", " "))


def mark_anchor(col) -> Column:
    """Wrap stripped anchor text in link markers."""
    return F.concat(F.lit(LINK_BEGIN), strip(col), F.lit(LINK_END))


def anchor_text(col) -> Column:
    """All marked anchor texts (non-greedy) joined by one space."""
    return F.array_join(F.regexp_extract_all(_c(col), F.lit(_ANCHOR_RE), 1), " ")


def remove_markers(col) -> Column:
    """Text with both link markers removed."""
    return F.regexp_replace(_c(col), _MARKER_RE, "")


def space_count(col) -> Column:
    """Number of ' ' characters (the reference's crude word count)."""
    c = _c(col)
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def whitespace_tokens(col) -> Column:
    """Split on ASCII whitespace, dropping empty pieces."""
    return F.filter(F.split(_c(col), r"\s+"), lambda t: t != "")


def css_tokens(col) -> Column:
    """P7+P8: tokens of a class/id attribute text.

    Split on whitespace and ``_ - :``, split camel-case words, lower-case,
    then class all-digit tokens as ``<DIGITS>`` and long tokens as ``<LONG>``.
    """
    spaced = F.regexp_replace(F.coalesce(_c(col), F.lit("")), "([A-Z][a-z]+)", " $1 ")
    parts = F.filter(F.split(spaced, r"[\s_:\-]+"), lambda t: t != "")
    return F.transform(
        parts,
        lambda t: F.when(F.lower(t).rlike(r"^\p{Nd}+$"), F.lit(DIGIT_CLASS))
        .when(F.length(F.lower(t)) > LONG_TOKEN_CHARS, F.lit(LONG_CLASS))
        .otherwise(F.lower(t)))


def token_bag(tokens) -> Column:
    """MAP<token, count> of a token array (empty map for no tokens).

    The array is evaluated once and sorted; a token's count is the length of
    its run, so a block costs ``n log n`` however many different tokens it has."""
    def runs(s):
        return F.filter(F.transform(s, lambda t, i: F.when(
            (i == 0) | (t != F.get(s, i - 1)), i)), lambda i: i.isNotNull())

    def counts(s):
        return let(runs(s), lambda starts: F.map_from_entries(F.transform(
            starts, lambda at, k: F.struct(
                F.get(s, at).alias("key"),
                (F.coalesce(F.get(starts, k + 1), F.size(s)) - at).cast("int").alias("value")))))
    return let(F.sort_array(_c(tokens)), counts)


def sentence_count(col) -> Column:
    """P12 (raw): number of sentence delimiter characters."""
    return F.length(F.regexp_replace(_c(col), r"[^.,?!]", ""))


def strip_xml_decl(col) -> Column:
    """Drop a leading XML declaration (case-insensitive)."""
    return F.regexp_replace(_c(col), r"(?i)^\s*<\?xml[^>]*?>", "")
