"""P5 as a table function of SQL:

    SELECT p.page_id, b.pos, b.text FROM pages p, LATERAL page_blocks(p.html) b

The function walks one page at a call and emits its blocks; ``css_src`` holds the
class and id texts that a block's token bag is made of (``functions.text.css_tokens``).
It is a plain Python table function, as Spark 4.1 allows no Arrow one under a
lateral join: ``segment_blocks`` is the faster way, this one serves SQL.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagesift.session import ship_package

NAME = "page_blocks"


class _PageBlocks:
    def __init__(self):
        from pagesift.functions.html_blocks import BlockWalker
        self.walker = BlockWalker()

    def eval(self, html: str):
        blocks, _ = self.walker.run(html or "")
        for pos, (text, sources) in enumerate(blocks, 1):
            yield pos, text, list(sources)


def register_block_table(spark: SparkSession, name: str = NAME) -> str:
    """Make the function known to the session's SQL; returns its name.  Blocks
    come in page order, ``pos`` from 1; a page that is NULL, empty or without
    text has no row (``LEFT JOIN LATERAL`` keeps it)."""
    ship_package(spark)
    spark.udtf.register(name, F.udtf(_PageBlocks, returnType="pos INT, text STRING, css_src ARRAY<STRING>"))
    return name
