"""Operations of a training-data pipeline: deduplication, quality, mixing, packing, extraction.

Nothing outside this subpackage imports it; ``gritstone.llm.queries`` registers its queries.
"""
