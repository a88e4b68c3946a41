"""Embedding models that are loaded where they run: once per Python worker, on the first text."""

from __future__ import annotations

from collections.abc import Callable

#: What stands before a query, but not before a passage, for models trained so (fixed value).
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
DEFAULT_MODEL = "BAAI/bge-small-en-v1.5"

#: Loaded models of this process by key; None marks one that could not be loaded, which is not tried again.
_loaded: dict[str, Callable[[list[str]], list[list[float]]] | None] = {}


class LazyEmbedder:
    """A text -> vector function for `embed_texts` and `open_memory`.

    `load()` gives a function from texts to vectors. It is called in each
    worker process when the first text comes; if it fails, all vectors there are
    null from then on, and recall goes on without them. `prefix` is put before
    each text.
    """

    def __init__(self, key: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = ""):
        self.key, self.load, self.prefix = key, load, prefix

    def for_queries(self, prefix: str = QUERY_PREFIX) -> LazyEmbedder:
        """The same model, loaded once with this one, for queries."""
        return LazyEmbedder(self.key, self.load, prefix)

    def resident(self) -> bool:
        """Whether this process has the model loaded."""
        return _loaded.get(self.key) is not None

    def __call__(self, text: str | None) -> list[float] | None:
        if text is None:
            return None
        if self.key not in _loaded:
            try:
                _loaded[self.key] = self.load()
            except Exception:
                _loaded[self.key] = None
        model = _loaded[self.key]
        return None if model is None else [float(v) for v in model([self.prefix + text])[0]]


def _load_default():
    from fastembed import TextEmbedding  # an optional package, with a model that it fetches

    model = TextEmbedding(model_name=DEFAULT_MODEL)
    return lambda texts: list(model.embed(texts))


def default_embedder() -> LazyEmbedder:
    """A small English retrieval model, where its package is installed; else its vectors are null."""
    return LazyEmbedder(DEFAULT_MODEL, _load_default)
