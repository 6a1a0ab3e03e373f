"""From question texts to report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph import rules
from sitegraph.functions.vectors import Encoder, hash_encoder
from sitegraph.operators import search
from sitegraph.session import write_stage


def search_text(questions: DataFrame | str, pages: DataFrame, k: int = rules.TOP_K, encoder: Encoder | None = None) -> DataFrame:
    """Report rows of the ``k`` best pages for every question (query_id, text), or for one question as a string.

    ``pages`` has page_id, url, clean_text and a page_vector of the same encoder. A null text counts as empty, which
    no page resembles; a null id is an error. Hits are worked out once, then the texts of hit pages are read.
    """
    if isinstance(questions, str):
        questions = pages.sparkSession.createDataFrame([(0, questions)], "query_id long, text string")
    vector = (encoder or hash_encoder())(F.coalesce("text", F.lit("")))
    queries = questions.select("query_id", vector.alias("query_vector"))
    hits = write_stage(search.search_batch(queries, pages, k), "hits")
    return search.format_hits(hits, pages)
