"""Places where foreign models plug in: embeddings, token counters, scorers and language models as vectorised functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import text as T


def text_model(load: Callable[[], Any], call: Callable[[Any, list[str]], list[Any]], returns: str, fallback: Any = None) -> Callable[[Column], Column]:
    """A UDF over texts with one model a worker. A batch that fails gets ``fallback`` in every row, as the deterministic answer."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            try:
                yield pd.Series(call(model, texts.fillna("").tolist()))
            except Exception:  # noqa: BLE001  foreign code
                yield pd.Series([fallback] * len(texts))

    return run


class BpeLength:
    """The number of tokens that a vocabulary file of the tokenizers library cuts a text into; its estimate where the library or the file fails.

    Loaded once a worker, on first use.
    """

    def __init__(self, path: str):
        self.path, self._lib = path, None

    def __getstate__(self):
        return {"path": self.path, "_lib": None}

    def __call__(self, text: str) -> int:
        if not text.strip():
            return 0
        try:
            if self._lib is None:
                from tokenizers import Tokenizer

                self._lib = Tokenizer.from_file(self.path)
            return len(self._lib.encode(text.strip(), add_special_tokens=False).ids)
        except Exception:  # noqa: BLE001  foreign code
            return estimated_tokens(text)


def estimated_tokens(text: str) -> int:
    """The estimate of ``functions.text.token_count`` for one text."""
    s = text.strip()
    if re.search(T.CJK, s):
        return len(re.findall(rf"{T.CJK}|[A-Za-z0-9_]+|[^\w\s]", s))
    return len(s.split())


def token_counter(length: Callable[[str], int]) -> Callable[[Column], Column]:
    """A counter for texts as a vectorised function, to be given wherever tokens are counted. Null counts nothing."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(length).astype("int32")

    return run


class ModelRouter:
    """Which named model a task uses, with one loaded object a name; unnamed tasks use the default."""

    def __init__(self, default: str, routes: dict[str, str] | None = None):
        self.default, self.routes, self._loaded = default, dict(routes or {}), {}

    def name(self, task: str) -> str:
        return self.routes.get(task) or self.default

    def model(self, task: str, load: Callable[[str], Any]) -> Any:
        name = self.name(task)
        if name not in self._loaded:
            self._loaded[name] = load(name)
        return self._loaded[name]
