"""The column functions as SQL functions, and the page splitter as a table function.

An expression is turned into SQL text and becomes a temporary SQL function, which Catalyst inlines: calls stay native.
Expressions with lambdas have no SQL text; these functions are for the DataFrame API only.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import vocab as V
from ..sources import html_chunks
from . import rules, similarity, urls


class PageChunks:
    """T0-T4 as a lateral table function: page_chunks(html, category)."""

    def eval(self, html: str, category: str):
        for n, c in enumerate(html_chunks.chunks(html or "", category or "")):
            yield n, c["text"], c["title"], c["date"], c["chunk_type"], c["category"]


def expressions() -> dict[str, tuple[str, Column]]:
    """SQL name to parameters and expression."""
    c = F.col
    return {
        "sw_signal_type": ("text string, category string", rules.signal_type(c("text"), c("category"))),
        "sw_lifecycle": ("stage string, kind string", rules.lifecycle(c("stage"), c("kind"))),
        "sw_timeline": ("text string, stage string", rules.timeline(c("text"), c("stage"))),
        "sw_parse_amount": ("raw string", rules.parse_amount(c("raw"))),
        "sw_friction": ("text string", rules.friction(c("text"))),
        "sw_strength": ("text string, stage string, has_amount boolean, has_date boolean", rules.strength(c("text"), c("stage"), c("has_amount"), c("has_date"))),
        "sw_fit": ("relevance double, level string", rules.fit(c("relevance"), c("level"))),
        "sw_trigger": ("text string", rules.trigger(c("text"))),
        "sw_agency": ("text string, fallback string", rules.agency(c("text"), c("fallback"))),
        "sw_meeting_date": ("text string, fallback string", rules.meeting_date(c("text"), c("fallback"))),
        "sw_first_date": ("text string", rules.first_date(c("text"))),
        "sw_tokens": ("text string", similarity.tokens(c("text"))),
        "sw_jaccard": ("a array<string>, b array<string>", similarity.jaccard(c("a"), c("b"))),
        "sw_amount_similarity": ("a double, b double", similarity.amount_similarity(c("a"), c("b"))),
        "sw_url_host": ("url string", urls.host(c("url"))),
        "sw_url_category": ("url string, parent string", urls.category(c("url"), c("parent"))),
        "sw_file_extension": ("content_type string", urls.extension(c("content_type"))),
        "sw_site_name": ("authority string", urls.site_name(c("authority"))),
        "sw_stage_rank": ("stage string", F.coalesce(*[F.when(c("stage") == s, k) for k, s in enumerate(V.STAGES)], F.lit(V.NO_STAGE))),
    }


def sql_text(spark: SparkSession, parameters: str, expression: Column) -> tuple[str, str]:
    """SQL text and type of an expression over the parameters."""
    plan = spark.createDataFrame([], parameters).select(expression.alias("x"))
    tree = plan._jdf.queryExecution().analyzed().expressions().head().child()
    return tree.sql(), plan.schema["x"].dataType.simpleString()


def register_functions(spark: SparkSession) -> list[str]:
    """Register everything; the names."""
    spark.udtf.register("page_chunks", udtf(PageChunks, returnType="chunk_no int, text string, title string, date string, chunk_type string, category string"))
    for name, (parameters, expression) in expressions().items():
        text, kind = sql_text(spark, parameters, expression)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {text}")
    return ["page_chunks", *expressions()]
