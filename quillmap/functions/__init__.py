"""Scalar functions: native column expressions and vectorised special functions."""
