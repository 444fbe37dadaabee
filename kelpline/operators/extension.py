"""What a new modality has to bring: how items are cut, how chunks are described, and what words there are.

All three work on columns and DataFrames, so an implementation is a plan, not a loop.  ``describe`` of
:meth:`kelpline.engine.Engine.build_images` and ``search_bytes`` takes any :class:`Extractor`.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Splitter(Protocol):
    """Content to an array of chunks."""

    def __call__(self, content: Column) -> Column: ...


@runtime_checkable
class Extractor(Protocol):
    """Encoded content to an array of descriptors (arrays of numbers); null or empty where there is none."""

    def __call__(self, content: Column) -> Column: ...


@runtime_checkable
class Codebook(Protocol):
    """Words from descriptors, and the nearest word of each descriptor."""

    def build(self, descriptors: DataFrame, k: int) -> DataFrame: ...

    def quantise(self, descriptors: DataFrame, words: DataFrame) -> DataFrame: ...
