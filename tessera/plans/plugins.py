"""Places for models: scorers, detectors and remote judges as Arrow-batched functions of whole partitions.

A detector is a function of a picture (height x width x channels, blue, green, red) to a list of faces, each with
``landmarks`` (x and y as shares of width and height) and ``blendshapes`` (names to numbers).
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import faces, pixels, prompts
from ..sources.shared import cut

Scorer = Callable[[object], float]
_LOADED: dict[str, object] = {}


def loaded(name: str | None, loaders: list[Callable[[], object]], tries: int = 1) -> object:
    """What the first loader that works makes, once for each worker process and ``name`` (None: each time); each is tried ``tries`` times."""
    if name in _LOADED:
        return _LOADED[name]
    for k, load in enumerate(loaders * tries):
        try:
            made = load()
            break
        except Exception:
            if k + 1 == len(loaders) * tries:
                raise
    if name is not None:
        _LOADED[name] = made
    return made


def scored(value: Column, load: Callable[[], Scorer] | list[Callable[[], Scorer]], low: float = 0.0, high: float = 10.0, name: str | None = None, tries: int = 1, together: int = 1) -> Column:
    """struct<score, error> of a model; a row that fails fails alone.

    together: the model takes lists of so many values and gives as many scores; where that fails, these values are
    given to it one by one.

    load: makes the model, or several loaders (one for each device), of which the first that works counts. With a
    ``name`` a worker process keeps the model for later tasks, else each task loads it. Scores are clamped and
    rounded to four places. If the model can't be loaded every row says so.
    """
    loaders = load if isinstance(load, list) else [load]

    def some(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            model, broken = loaded(name, loaders, tries), None
        except Exception as error:  # the stage goes on without scores
            model, broken = None, str(error)

        bounded = lambda y: (round(min(high, max(low, float(y))), 4), None)

        def one(x: object) -> tuple[float | None, str | None]:
            if broken is not None:
                return None, broken
            try:
                return bounded(model([x])[0] if together > 1 else model(x))
            except Exception as error:
                return None, str(error)

        def some_of(values: list[object]) -> list[tuple[float | None, str | None]]:
            if broken is None and together > 1:
                try:
                    made = list(map(bounded, model(values)))
                    if len(made) == len(values):
                        return made
                except Exception:
                    pass
            return list(map(one, values))

        for batch in batches:
            rows = [r for s in range(0, len(batch), together) for r in some_of(list(batch[s : s + together]))]
            yield pd.DataFrame(rows, columns=["score", "error"]).astype({"score": "float64", "error": "object"})

    some.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = StructType([StructField("score", DoubleType()), StructField("error", StringType())])
    return F.pandas_udf(some, kind)(value)


def asked(prompts: DataFrame, connect: Callable[[], Callable[..., str]], tries: int = 3, at_once: int = 8, wait: float = 1.0, encode: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``prompts`` (id, prompt[, picture]) with ``reply`` and ``error`` of a remote judge.

    Calls wait on the network, so each task keeps ``at_once`` of them going; a call is tried ``tries`` times
    with doubled waits between. With ``encode`` the judge is asked with the prompt and the encoded bytes of ``picture``.
    """
    columns = ["id", "prompt", *["picture"] * (encode is not None)]

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = connect()

        def one(prompt: str, *picture: bytes) -> tuple[str | None, str | None]:
            for k in range(tries):
                try:
                    return ask(prompt, *map(encode, picture)), None
                except Exception as error:
                    last = str(error)
                    if k + 1 < tries:
                        time.sleep(wait * 2**k)
            return None, last

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                found = list(pool.map(one, *(batch[c] for c in columns[1:])))
                yield batch[["id"]].assign(reply=[r for r, _ in found], error=[e for _, e in found])

    return prompts.select(*columns).mapInPandas(some, "id bigint, reply string, error string")


_FACES = {"face_overall": pa.float64(), "face_count": pa.int32(), "ratio": pa.float64(), "clarity": pa.float64(), "second_ratio": pa.float64(), "any_blink": pa.bool_(), "main_blink": pa.bool_(), "has_face": pa.bool_()}
_KINDS = "face_overall double, face_count int, ratio double, clarity double, second_ratio double, any_blink boolean, main_blink boolean, has_face boolean"
Detector = Callable[[np.ndarray], list[dict]]


def _measured(picture: np.ndarray | None, model: Detector | None, broken: str | None) -> tuple[dict, str | None]:
    """What faces of a picture measure, and the error; without a picture, a detector or a success none."""
    none = faces.measured([], 1, 1, lambda *_: 0.0)
    if picture is None or model is None:
        return none, broken if picture is not None else "no picture"
    try:
        levels = pixels.grey(picture)
        return faces.measured(model(picture), picture.shape[1], picture.shape[0], lambda *box: pixels.clarity(levels, *box)), None
    except Exception as error:
        return none, str(error)


def _loaded_or_not(name: str | None, load, tries: int) -> tuple[object, str | None]:
    try:
        return loaded(name, load if isinstance(load, list) else [load], tries), None
    except Exception as error:
        return None, str(error)


def faced(pictures: DataFrame, load: Callable[[], Detector] | list[Callable[[], Detector]], name: str | None = None, tries: int = 3) -> DataFrame:
    """``pictures`` (id, height, width, channels, data) as id, face_overall, face_count, ratio, clarity, second_ratio, any_blink,
    main_blink, has_face and error.

    The detector is made once for each task, or, with a ``name``, for each worker process, in ``tries`` tries. Pictures
    that weren't decoded, that it fails on, or all, where it can't be made, have no faces and an error.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, broken = _loaded_or_not(name, load, tries)
        for batch in batches:
            found = [_measured(x, model, broken) for x in pixels.rows_of(batch)]
            made = [pa.array([m[c] for m, _ in found], kind) for c, kind in _FACES.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array([e for _, e in found], pa.string())], ["id", *_FACES, "error"])

    return pictures.select("id", "height", "width", "channels", "data").mapInArrow(some, f"id bigint, {_KINDS}, error string")


def faced_and_asked(pictures: DataFrame, load: Callable[[], Detector] | list[Callable[[], Detector]], connect: Callable[[], Callable[[str, np.ndarray], str]], name: str | None = None, tries: int = 3, at_once: int = 8, wait: float = 1.0, together: int = 16) -> DataFrame:
    """faced() with ``reply`` and ``reply_error`` of a remote judge, in one pass over the pictures.

    The judge is asked for a picture, by its prompt and its pixels, as soon as its faces are known, while the next
    pictures are looked at; ``at_once`` calls are under way, and not more than twice as many wait, so that a task holds few
    pictures however slow the judge is. Rows keep their order whatever the order of replies.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, broken = _loaded_or_not(name, load, tries)
        judge, unreached = _loaded_or_not(None, connect, 1)

        def ask(prompt: str, picture: np.ndarray) -> tuple[str | None, str | None]:
            last = unreached
            for k in range(tries if judge is not None else 0):
                try:
                    return judge(prompt, picture), None
                except Exception as error:
                    last = str(error)
                    if k + 1 < tries:
                        time.sleep(wait * 2**k)
            return None, last

        def rows(ready: list[tuple]) -> pa.RecordBatch:
            ids, measures, errors, replies = zip(*ready)
            made = [pa.array([m[c] for m in measures], kind) for c, kind in _FACES.items()]
            said, failed = zip(*(r.result() if r is not None else (None, None) for r in replies))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *made, *(pa.array(c, pa.string()) for c in (errors, said, failed))], ["id", *_FACES, "error", "reply", "reply_error"])

        with ThreadPoolExecutor(at_once) as pool:
            waiting: deque[tuple] = deque()
            for batch in batches:
                for i, picture in zip(batch.column(0), pixels.rows_of(batch)):
                    while sum(r is not None and not r.done() for *_, r in waiting) >= 3 * at_once or len(waiting) >= max(together, 3 * at_once):
                        first = [waiting.popleft() for _ in range(min(together, len(waiting)))]
                        yield rows(first)
                    m, error = _measured(picture, model, broken)
                    sent = None if picture is None else pool.submit(ask, prompts.text(faces.described(m)), picture)
                    waiting.append((i.as_py(), m, error, sent))
            while waiting:
                yield rows([waiting.popleft() for _ in range(min(together, len(waiting)))])

    return pictures.select("id", "height", "width", "channels", "data").mapInArrow(some, f"id bigint, {_KINDS}, error string, reply string, reply_error string")


def fallback(make: Callable[[], DataFrame], otherwise: Callable[[], DataFrame], skipped: list[str], layer: str, tries: int = 1) -> DataFrame:
    """``make()`` written once, or ``otherwise()`` if that fails ``tries`` times, in planning or in a task; ``skipped`` then lists the layer once."""
    for _ in range(tries):
        try:
            return cut(make())
        except Exception:
            pass
    if layer not in skipped:
        skipped.append(layer)
    return otherwise()
