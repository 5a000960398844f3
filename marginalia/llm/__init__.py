"""Operators for preparing training data; nothing outside this subpackage imports it."""

#: Modules that hold QUERIES and SQL.
QUERY_MODULES = ("text_quality_queries", "rank_fusion_queries", "top_hits_queries", "pieces_queries", "containers_queries", "mixture_queries", "unwelcome_queries")
