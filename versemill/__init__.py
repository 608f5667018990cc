"""versemill: lyric, score and word-list analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
