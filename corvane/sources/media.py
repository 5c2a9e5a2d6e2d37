"""Interfaces to video decoding, detection and drawing. Planning of frames is native; pixels are injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Decoder(Protocol):
    def __call__(self, path: str, indices: list[int]) -> list[bytes]: ...


class Detector(Protocol):
    def __call__(self, frames: list[bytes]) -> list[list[list[float]]]: ...


def decode(plans: DataFrame, factory: Callable[[], Decoder]) -> DataFrame:
    """plans (path, idx array) -> (path, idx, frame): frames that fail to decode are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for f in frames:
            rows = []
            for path, idx in zip(f["path"], f["idx"]):
                for i, b in zip(idx, read(path, list(map(int, idx)))):
                    if b:
                        rows.append((path, int(i), b))
            yield pd.DataFrame(rows, columns=["path", "idx", "frame"])

    return plans.select("path", "idx").mapInPandas(run, "path string, idx long, frame binary")


def detect(frames: DataFrame, factory: Callable[[], Detector], batch: int = 32) -> DataFrame:
    """(path, idx, frame) -> (path, idx, boxes array<array<double>>), batch by batch."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for f in parts:
            boxes: list = []
            for k in range(0, len(f), batch):
                boxes += model(list(f["frame"][k : k + batch]))
            yield pd.DataFrame({"path": f["path"], "idx": f["idx"], "boxes": boxes})

    return frames.mapInPandas(run, "path string, idx long, boxes array<array<double>>")
