"""Folding of constants with the source language's meaning; what fails there is null here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Binary operators with their forward and reflected method names (fixed values).
BINARY = {"+": ("__add__", "__radd__"), "-": ("__sub__", "__rsub__"), "*": ("__mul__", "__rmul__"), "/": ("__truediv__", "__rtruediv__"), "//": ("__floordiv__", "__rfloordiv__"), "%": ("__mod__", "__rmod__"), "**": ("__pow__", "__rpow__"), "<<": ("__lshift__", "__rlshift__"), ">>": ("__rshift__", "__rrshift__"), "&": ("__and__", "__rand__"), "|": ("__or__", "__ror__"), "^": ("__xor__", "__rxor__"), "<": ("__lt__", "__gt__"), ">": ("__gt__", "__lt__"), "<=": ("__le__", "__ge__"), ">=": ("__ge__", "__le__"), "==": ("__eq__", "__eq__"), "!=": ("__ne__", "__ne__")}


def fold(op: str, l: Column, r: Column) -> Column:
    """An operator on two numbers; null where it would raise. Floor division and remainder round towards minus infinity."""
    if op == "/":
        return F.try_divide(l.cast("double"), r.cast("double"))
    if op == "//":
        return F.when(r != 0, F.floor(l / F.nullif(r, F.lit(0))))
    if op == "%":
        return F.when(r != 0, l - r * F.floor(l / F.nullif(r, F.lit(0))))
    if op == "**":
        return F.pow(l, r)
    if op == "<<":
        return F.when(r >= 0, l * F.pow(F.lit(2), r).cast("long"))
    if op == ">>":
        return F.when(r >= 0, F.floor(l / F.pow(F.lit(2), r)))
    plain = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}
    if op in plain:
        return plain[op](l, r)
    other = {"&": l.bitwiseAND, "|": l.bitwiseOR, "^": l.bitwiseXOR, "<": l.__lt__, ">": l.__gt__, "<=": l.__le__, ">=": l.__ge__, "==": l.__eq__, "!=": l.__ne__}
    return other[op](r)


def truth(value: Column, kind: str) -> Column:
    """Truthiness: zero, empty and none are false."""
    if kind in ("int", "float"):
        return F.coalesce(value != 0, F.lit(False))
    return F.coalesce(F.length(value) > 0, F.lit(False)) if kind == "str" else F.coalesce(value, F.lit(False)) if kind == "bool" else F.lit(False)


def identity(same_type: Column, both_known: Column, same: Column) -> Column:
    """The possible results of ``is``: none equal types, known objects, or either way."""
    return F.when(~same_type, F.array(F.lit(False))).when(both_known, F.array(same)).otherwise(F.array(F.lit(False), F.lit(True)))


def simplified(op: str, known: Column, other: Column) -> Column:
    """An operation with one constant side, where an identity gives its result: x*1, x*0, x+0. Null where none does."""
    if op == "*":
        return F.when(known == 1, other).when(known == 0, F.lit(0.0))
    return F.when(known == 0, other) if op == "+" else F.lit(None).cast("double")


def number_of_bits(n: Column) -> Column:
    return F.when(n > 1, F.ceil(F.log2(n))).otherwise(F.lit(0)).cast("int")
