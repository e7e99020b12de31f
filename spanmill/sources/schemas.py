"""Schemas of the tables that the readers and writers know. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SPAN = _of(kana=_S, start=_D, end=_D)
TRANSCRIPT = _of(client_id=_S, path=_S, sentence=_S, up_votes=_S, down_votes=_S)
DURATIONS = _of(path=_S, ms=_S)
ITEM = _of(item_id=_S, audio_path=_S, client_id=_S, sentence=_S, kana=_S, units=_I, duration=_D, rate=_D)
ALIGNMENT = _of(item_id=_S, ok=_B, duration=_D, spans=T.ArrayType(SPAN), speech_start=_D, speech_end=_D, reason=_S, detail=_S)
SOURCE = _of(source_id=_S, kind=_S, client_id=_S, item_ids=T.ArrayType(_S), item_samples=T.ArrayType(_L), gap_samples=T.ArrayType(_L), known_no_speech=_B)
WINDOW = _of(source_id=_S, window=_L, start_sample=_L, label=_D, kind=_S, known_no_speech=_B)
PREDICTION = _of(source_id=_S, window=_L, condition=_S, method=_S, pred=_D)
SPLIT = _of(split=_S, unit=_S, seed=_L, method=_S, client_ids=T.ArrayType(_S))
FEATURE = _of(item_id=_S, frames=_I, feature=T.ArrayType(T.ArrayType(T.FloatType())))
