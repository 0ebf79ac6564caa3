"""Queries over text primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from . import sql as S


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def topterms(spark, d):
    """A report: the fifty most frequent tokens."""
    each = _docs(spark, d).select("doc_id", F.explode(T.lexical_tokens(F.col("text"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(50)


QUERIES = {
    "tok_count": lambda s, d: _docs(s, d).select("doc_id", T.token_count(F.col("text")).cast("bigint").alias("n_tokens")),
    "tok_lexical_topterms": topterms,
    "norm_whitespace": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("norm_md5")),
    "norm_match": lambda s, d: _docs(s, d).select("doc_id", F.md5(T.matchable(F.col("text"))).alias("match_md5")),
    "sentence_count": lambda s, d: _docs(s, d).select("doc_id", T.sentences(F.col("text")).alias("x")).select("doc_id", F.size("x").cast("bigint").alias("n_sentences"), F.md5(F.array_join("x", "|")).alias("sentences_md5")),
    "truncate_240": lambda s, d: _docs(s, d).select("doc_id", T.truncated(F.col("text")).alias("short_text")),
    "doc_id_hash": lambda s, d: table(s, d, "pages").select("page_id", T.stable_id(F.coalesce("url", F.lit(""))).alias("stable_id")),
    "page_list": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.min("turn").cast("int").alias("a"), F.max("turn").cast("int").alias("b")).select("conv_id", F.array_join(T.page_list(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("pages")),
    "safe_mean": lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.round(T.mean_or_zero(F.when(F.col("n_chars") > 2000, F.col("n_chars"))), 6).alias("mean_long")),
}
_D = "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents) "
SQL = {
    "tok_count": _D + f"SELECT doc_id, CAST({S.count('text', S.TOKEN)} AS BIGINT) AS n_tokens FROM d",
    "tok_lexical_topterms": _D + f"SELECT term, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS term FROM d) GROUP BY term ORDER BY n DESC, term LIMIT 50",
    "norm_whitespace": _D + f"SELECT doc_id, md5({S.norm('text')}) AS norm_md5 FROM d",
    "norm_match": _D + f"SELECT doc_id, md5({S.match('text')}) AS match_md5 FROM d",
    "sentence_count": _D + f", x AS (SELECT doc_id, {S.sentences('text')} AS x FROM d) SELECT doc_id, CAST(len(x) AS BIGINT) AS n_sentences, md5(array_to_string(x, '|')) AS sentences_md5 FROM x",
    "truncate_240": _D + f", n AS (SELECT doc_id, {S.norm('text')} AS n FROM d) SELECT doc_id, CASE WHEN length(n) > 240 THEN regexp_replace(substr(n, 1, 237), '[{S.BL}]+$', '') || '...' ELSE n END AS short_text FROM n",
    "doc_id_hash": "SELECT page_id, substr(sha1(lower(coalesce(url, ''))), 1, 16) AS stable_id FROM pages",
    "page_list": "SELECT conv_id, array_to_string(range(CAST(min(turn) AS BIGINT), CAST(max(turn) AS BIGINT) + 1), ',') AS pages FROM conversations GROUP BY conv_id",
    "safe_mean": "SELECT lang, round(coalesce(avg(n_chars) FILTER (WHERE n_chars > 2000), 0.0), 6) AS mean_long FROM documents GROUP BY lang",
}
