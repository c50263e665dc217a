"""One entry for every search mode."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import retrieval as rt


def search(mode: str, vectors: DataFrame, query, passages: DataFrame, k: int = 10, keywords=(),
           aux: DataFrame | None = None, signatures: DataFrame | None = None, signature_query=None,
           alpha: float = 0.7, walk: bool = False, deleted: DataFrame | None = None) -> DataFrame:
    """hamming, fast, pure_brain, smart or associate; a mode without its input falls back.

    ``aux`` (idx, aux) is the precomputed second score; ``signatures`` (idx, signature) the second
    vector. ``walk`` appends the passages reached from several results of the associate mode.
    """
    if mode == "hamming":
        found = rt.hamming_blend_topk(vectors, query, passages, k, keywords)
    elif mode == "pure_brain" and signatures is not None:
        found = rt.signature_topk(signatures, signature_query, k, passages, keywords)
    elif mode == "smart" and aux is not None:
        found = rt.blend_rerank(vectors, query, aux, alpha, k)
    elif mode == "associate":
        found = (rt.blend_rerank(vectors, query, aux, 1.0, k) if aux is not None
                 else rt.hamming_blend_topk(vectors, query, passages, k, keywords))
        if walk:
            found = rt.walk_expand(vectors, found.select("idx", "score"), deleted)
    else:
        found = rt.cosine_topk(vectors, query, k, passages, keywords)
    return found
