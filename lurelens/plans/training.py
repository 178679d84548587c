"""End-to-end plan of the training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import corpus


def build_corpus(sources: list[tuple[str, DataFrame]], synthetic: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Split training records from labelled sources in order of precedence; generated records join train only."""
    united = corpus.min_text(corpus.union_sources(sources))
    unique = corpus.first_by_hash(united, ["src_ord", "row_ord"])
    numbered = corpus.sequential_ids(unique, ["src_ord", "row_ord"], "real_")
    split = corpus.stratified_split(corpus.build_records(numbered), ["language", "is_scam"], seed=seed)
    return split if synthetic is None else corpus.with_synthetic(split, synthetic)
