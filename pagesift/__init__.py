"""pagesift: main-content extraction from web pages as Spark DataFrame jobs.

Pages are split into ordered text blocks, each block gets shallow text,
position and class-token features, classifiers decide which blocks form the
article, and the rebuilt article is scored against annotated gold text.
Every public operator is a DataFrame -> DataFrame function.
"""

__all__ = ["session"]
