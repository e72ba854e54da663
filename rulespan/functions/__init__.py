"""Scalar functions as Column expressions, by name. Importing this fills the registry."""

from . import conversion, lsh, mathematics, quantize, strings, temporal, vectors  # noqa: F401
from .registry import REGISTRY, call, kind_of, register_function  # noqa: F401
