"""Order-free comparison of two row lists."""
import math


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return f"{type(value).__name__}:{value}"


def same_rows(a, b):
    return sorted(tuple(map(_plain, r)) for r in a) == sorted(tuple(map(_plain, r)) for r in b)
