"""HTML cleanup as chains of JVM regular expressions (no Python per row).

The patterns are written in the common subset of Java and RE2 syntax (no
look-around, no back-references), so the DuckDB oracle uses the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import col_of

# Blocks removed before text extraction.
DROP_BLOCKS = (
    r"(?s)<!--.*?-->",
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?is)<noscript[^>]*>.*?</noscript>",
    r"(?is)<nav[^>]*>.*?</nav>",
    r"(?is)<footer[^>]*>.*?</footer>",
    r"(?is)<aside[^>]*>.*?</aside>",
    r"(?is)<header[^>]*>.*?</header>",
    r"(?is)<(?:div|section|span|p)[^>]*class=\"(?:ad|ads|advert|advertisement|sponsor)(?: [^\"]*)?\"[^>]*>.*?</(?:div|section|span|p)>",
)
ARTICLE_BLOCK = r"(?is)<article[^>]*>(.*?)(?:</article>|$)"
BODY_BLOCK = r"(?is)<body[^>]*>(.*?)(?:</body>|$)"
TAG = r"<[^>]*>"

# Named entities unescaped (ampersand last).
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&amp;", "&"))


def unescape(c) -> Column:
    out = col_of(c)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def strip_blocks(c) -> Column:
    out = col_of(c)
    for p in DROP_BLOCKS:
        out = F.regexp_replace(out, p, " ")
    return out


def main_block(c) -> Column:
    """The <article> block if any, else <body>, else the whole document."""
    h = col_of(c)
    art = F.regexp_extract(h, ARTICLE_BLOCK, 1)
    body = F.regexp_extract(h, BODY_BLOCK, 1)
    has_art = h.rlike(r"(?i)<article[\s>]")
    has_body = h.rlike(r"(?i)<body[\s>]")
    return F.when(has_art, art).when(has_body, body).otherwise(h)


def html_to_text(c) -> Column:
    """B1: main text: drop scripts/styles/nav/ads/footer, keep the article block,
    strip tags, unescape entities, collapse whitespace."""
    block = main_block(strip_blocks(c))
    no_tags = F.regexp_replace(block, TAG, " ")
    return F.trim(F.regexp_replace(unescape(no_tags), r"\s+", " "))
