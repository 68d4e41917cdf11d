"""Spark types from Python annotations, and what fits what."""

from __future__ import annotations

import datetime
import decimal
import inspect
import pathlib
import types
import typing

from pyspark.sql import types as T

# Scalar types.
SCALARS = {
    int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType(),
    datetime.date: T.DateType(), datetime.datetime: T.TimestampNTZType(), decimal.Decimal: T.DecimalType(38, 18),
    pathlib.Path: T.StructType([T.StructField("path", T.StringType())]),
}


def spark_type(hint) -> T.DataType:
    if hint in SCALARS:
        return SCALARS[hint]
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        kinds = [a for a in args if a is not type(None)]
        if len(kinds) != 1:
            raise TypeError(f"a union of several types: {hint}")
        return spark_type(kinds[0])
    if origin in (list, set, frozenset) or getattr(origin, "__name__", "") == "Sequence":
        return T.ArrayType(spark_type(args[0]))
    if origin is tuple:
        if len(args) == 2 and args[1] is ...:
            return T.ArrayType(spark_type(args[0]))
        if len(set(args)) == 1:
            return T.ArrayType(spark_type(args[0]))
        return T.StructType([T.StructField(f"f{i}", spark_type(a)) for i, a in enumerate(args)])
    if origin is dict:
        return T.ArrayType(T.StructType([T.StructField("key", spark_type(args[0])), T.StructField("value", spark_type(args[1]))]))
    name = getattr(hint, "__name__", "")
    numpy = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "bool_": T.BooleanType()}
    if name in numpy:
        return numpy[name]
    raise TypeError(f"no Spark type for {hint!r}")


def to_python(value, hint):
    """A Spark value as the Python value that ``hint`` names."""
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if value is None:
        return None
    if origin in (typing.Union, types.UnionType):
        return to_python(value, next(a for a in args if a is not type(None)))
    if hint is pathlib.Path:
        return pathlib.Path(value["path"])
    if origin is dict:
        return {to_python(e["key"], args[0]): to_python(e["value"], args[1]) for e in value}
    if origin is tuple:
        if isinstance(value, dict):
            return tuple(to_python(value[f"f{i}"], a) for i, a in enumerate(args))
        return tuple(to_python(v, args[0]) for v in value)
    if origin in (list, set, frozenset):
        return origin(to_python(v, args[0]) for v in value)
    return value


def to_spark(value, hint):
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if value is None:
        return None
    if origin in (typing.Union, types.UnionType):
        return to_spark(value, next(a for a in args if a is not type(None)))
    if hint is pathlib.Path:
        return {"path": str(value)}
    if origin is dict:
        return [{"key": to_spark(k, args[0]), "value": to_spark(v, args[1])} for k, v in value.items()]
    if origin is tuple and len(set(args) - {...}) > 1:
        return {f"f{i}": to_spark(v, a) for i, (v, a) in enumerate(zip(value, args))}
    if origin in (list, set, frozenset, tuple):
        return [to_spark(v, args[0]) for v in value]
    return value


def function_types(function, output_keys, inputs: dict | None = None, outputs=None) -> tuple[dict, dict]:
    """Python hints of parameters and of output keys."""
    hints = typing.get_type_hints(function)
    params = {}
    for name in inspect.signature(function).parameters:
        if inputs and name in inputs:
            params[name] = inputs[name]
        elif name in hints:
            params[name] = hints[name]
        else:
            raise ValueError(f"parameter {name} has no annotation")
    keys = list(output_keys)
    if isinstance(outputs, dict):
        return params, {k: outputs[k] for k in keys}
    if outputs is not None:
        return params, dict(zip(keys, outputs, strict=True))
    back = hints.get("return", inspect.Signature.empty)
    if not keys:
        if back not in (inspect.Signature.empty, type(None)):
            raise ValueError("the function returns a value but has no output keys")
        return params, {}
    if back in (inspect.Signature.empty, type(None)):
        raise ValueError("output keys need an annotated return value")
    if len(keys) == 1:
        return params, {keys[0]: back}
    origin, args = typing.get_origin(back), typing.get_args(back)
    if origin is tuple and len(args) == len(keys) and ... not in args:
        return params, dict(zip(keys, args))
    if origin is list or origin is tuple and args[1:] == (...,) or getattr(origin, "__name__", "") == "Sequence":
        return params, {k: args[0] for k in keys}
    raise ValueError(f"{len(keys)} output keys do not fit {back}")


def fits(incoming: T.DataType, receiver: T.DataType) -> bool:
    """Whether values go in unchanged; integers and floats may widen."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if type(incoming) in order and type(receiver) in order:
        return order.index(type(incoming)) <= order.index(type(receiver))
    if isinstance(incoming, (T.FloatType, T.DoubleType)) and isinstance(receiver, T.DoubleType):
        return True
    if isinstance(incoming, T.ArrayType) and isinstance(receiver, T.ArrayType):
        return fits(incoming.elementType, receiver.elementType)
    if isinstance(incoming, T.StructType) and isinstance(receiver, T.StructType):
        return incoming.names == receiver.names and all(fits(a.dataType, b.dataType) for a, b in zip(incoming, receiver))
    if isinstance(incoming, (T.TimestampType, T.TimestampNTZType)) and isinstance(receiver, (T.TimestampType, T.TimestampNTZType)):
        return True
    return type(incoming) is type(receiver)
