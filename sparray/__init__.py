"""Typed array and tensor arithmetic on Spark DataFrames."""

from .operators.linalg import dequantize_matmul
from .operators.tensor import Tensor
from .plans.engine import Engine, compile, mode
from .plans.expr import Expr

__all__ = ["Engine", "Expr", "Tensor", "compile", "dequantize_matmul", "mode"]
