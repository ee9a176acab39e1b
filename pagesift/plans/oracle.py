"""DuckDB SQL text for the driver's correctness oracle.

The segmentation recipe below re-derives the blocks of the test corpus with
regular expressions (RE2).  It is *not* a general HTML segmenter: it relies
on the corpus having well-formed anchors and no nested class-bearing
elements, which is exactly why it makes an independent check of the
event-walk UDF on these tables.
"""

from __future__ import annotations

# Elements that neither start nor end a block (fixed values), written out here
# so the oracle does not share the walker's list.
INLINE_ALTERNATION = (
    "a|b|big|i|small|tt|abbr|acronym|cite|code|dfn|em|kbd|strong|samp|var|"
    "bdo|img|map|object|q|span|sub|sup|button|input|label|select|textarea")


def _unescape(expr: str) -> str:
    s = expr
    for ent, ch in (("&quot;", "chr(34)"), ("&middot;", "chr(183)"),
                    ("&copy;", "chr(169)"), ("&lt;", "'<'"), ("&gt;", "'>'")):
        s = f"replace({s}, '{ent}', {ch})"
    return f"regexp_replace({s}, '&amp;?', '&', 'g')"


def _normalize(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


# Pages with their gold key and normalized gold text.
PAIRS_CTE = f"""
pairs AS (
  SELECT p.page_id, d.doc_id, p.html, {_normalize('d.text')} AS gold
  FROM pages p
  JOIN documents d
    ON d.doc_id = TRY_CAST(NULLIF(regexp_extract(p.url, '/[a-z]{{2}}/(\\d+)', 1), '') AS BIGINT)
)"""

_BODY = "regexp_extract(html, '(?is)<body[^>]*>(.*)', 1)"
_NO_COMMENTS = "regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
_NO_SCRIPTS = "regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
_NO_STYLES = "regexp_replace({x}, '(?is)<style[^>]*>.*?</style>[^<]*', '', 'g')"
_MARK_ANCHORS = ("regexp_replace({x}, '(?i)<a(\\s[^>]*)?>\\s*([^<]*[^<\\s])\\s*', "
                 "' ' || chr(2) || '\\2' || chr(3) || ' ', 'g')")
_INLINE = ("regexp_replace({x}, '(?i)</?(" + INLINE_ALTERNATION
           + ")(\\s[^>]*)?/?>', ' ', 'g')")
_TAG_AD = "regexp_replace({x}, '(?i)<div class=\"ad\">', chr(1) || chr(4), 'g')"
_SPLIT_TAGS = "regexp_replace({x}, '</?[a-zA-Z][^<>]*>', chr(1), 'g')"


def _chain(x: str, *steps: str) -> str:
    for s in steps:
        x = s.format(x=x)
    return x


_SPLIT_BODY = _chain(_BODY, _NO_COMMENTS, _NO_SCRIPTS, _NO_STYLES,
                     _MARK_ANCHORS, _INLINE, _TAG_AD, _SPLIT_TAGS)
_BODY_TEXT = _normalize(_unescape(
    "regexp_replace(" + _chain(
        "regexp_extract(html, '(?is)<body[^>]*>(.*?)(</body>|$)', 1)",
        _NO_COMMENTS, _NO_SCRIPTS) + ", '</?[a-zA-Z][^<>]*>', '', 'g')"))

# One row per block: page_id, doc_id, gold, pos (1-based), text, in_ad
# (block inside the corpus's only class-bearing element, <div class="ad">).
BLOCKS_CTE = PAIRS_CTE + f""",
split_pages AS (
  SELECT page_id, doc_id, gold, {_BODY_TEXT} AS body_text,
         string_split({_SPLIT_BODY}, chr(1)) AS parts
  FROM pairs
),
raw_pieces AS (
  SELECT page_id, doc_id, gold, body_text,
         unnest(parts) AS piece, generate_subscripts(parts, 1) AS k
  FROM split_pages
),
texts AS (
  SELECT page_id, doc_id, gold, body_text, k, contains(piece, chr(4)) AS in_ad,
         {_normalize(_unescape("replace(replace(replace(piece, chr(4), ''), chr(2), '<<LINK<<'), chr(3), '>>LINK>>')"))} AS text
  FROM raw_pieces
),
blocks AS (
  SELECT page_id, doc_id, gold, body_text,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS pos,
         text, in_ad
  FROM texts WHERE text <> ''
),
page_bodies AS (
  SELECT page_id, doc_id, gold, body_text FROM split_pages
)"""


def with_blocks(select_sql: str) -> str:
    """Wrap a SELECT that reads the ``blocks``/``pairs`` CTEs."""
    return "WITH " + BLOCKS_CTE + "\n" + select_sql
