"""Binding a value once inside an expression.

A Python variable that holds a Column is text that is pasted into every use: inside a lambda over an array it is evaluated for
every element. `let` evaluates it once a row and hands the lambda a bound variable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)
