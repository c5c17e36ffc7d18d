"""Label maps of large images, and training corpora, as Spark jobs. The merge of tiles is exported here for those who need just that; names are imported when they are first used."""

from importlib import import_module

_PLACES = {"Segmenter": "operators.segment", "Thresholds": "model", "TileSpec": "model", "merge_pairs": "operators.merge", "merge_two_phase": "operators.merge"}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
