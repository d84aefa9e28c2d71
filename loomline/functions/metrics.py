"""Pair metrics as column expressions over the features of two units.

The units' columns are prefixed ``a_`` and ``b_``: hash, norm_hash, signature,
sig_len, struct_sig, token_str, tok_len, stmt_kinds, line_count, has_body,
ret_binop. Everything is built in, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.config import Options

A, B = "a_", "b_"
SLACK = 1e-9


def pair_key(x: Column, y: Column) -> Column:
    return F.concat(F.least(x, y), F.lit("|"), F.greatest(x, y))


def identity_hash(name: Column, signature: Column, start: Column, end: Column, count: Column, statements: Column) -> Column:
    """First 16 hex digits of a SHA-256 over what identifies a unit; statements may be null."""
    text = F.concat_ws(" ", name, signature, F.concat(F.lit("lines:"), start, F.lit("-"), end), F.concat(F.lit("count:"), count), F.concat(F.lit("stmts:"), statements))
    return F.substring(F.sha2(F.concat(F.lit("["), text, F.lit("]")), 256), 1, 16)


def _both(name: str) -> tuple[Column, Column]:
    return F.col(A + name), F.col(B + name)


def tree_similarity() -> Column:
    """1 for two bodies, else 0: whole declarations never differ for this metric."""
    x, y = _both("has_body")
    return F.when(x & y, 1.0).otherwise(0.0)


def token_similarity(least: Column | None = None) -> Column:
    """1 - Levenshtein / longer length; with ``least``, null if it is below that."""
    (x, y), (m, n) = _both("token_str"), _both("tok_len")
    most = F.greatest(m, n)
    if least is None:
        distance = F.levenshtein(x, y)
    else:
        bound = F.least(most, F.ceil((1 - least) * most + SLACK)).cast("int")
        distance = F.call_function("levenshtein", x, y, F.greatest(bound, F.lit(0)))
    return F.when(x.isNull() | y.isNull(), 0.0).when(most == 0, 1.0).when((m == 0) | (n == 0), 0.0).when(distance >= 0, 1 - distance / most)


def body_structure(options: Options) -> Column:
    x, y = _both("stmt_kinds")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda z: z))
    return F.when(x.isNull() & y.isNull(), 1.0).when(x.isNull() | y.isNull(), 0.0).when(F.size(x) != F.size(y), options.count_penalty).when(F.size(x) == 0, 1.0).otherwise(same / F.size(x))


def structural_similarity(options: Options) -> Column:
    (x, y), (p, q) = _both("struct_sig"), _both("ret_binop")
    body = body_structure(options)
    return F.when(x == y, body).when((body > 0.7) & p & q, options.similar_operations).otherwise(body * options.weights.different_signature)


def signature_similarity() -> Column:
    """Compares lengths only, unless the texts are equal."""
    (x, y), (m, n) = _both("signature"), _both("sig_len")
    return F.when(x == y, 1.0).when((m == 0) | (n == 0), 0.0).otherwise(1 - F.abs(m - n) / F.greatest(m, n))


def may_be_similar(options: Options) -> Column:
    (m, n), (x, y), (p, q) = _both("sig_len"), _both("line_count"), _both("stmt_kinds")
    lines = (x == 0) | (y == 0) | (F.greatest(x, y) <= options.max_line_ratio * F.least(x, y))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    bodies = ~(((size(p) == 0) & (size(q) > options.max_empty_gap)) | ((size(q) == 0) & (size(p) > options.max_empty_gap)))
    return (F.abs(m - n) <= options.max_signature_gap) & lines & bodies


def category(score: Column) -> Column:
    return F.when(score >= 0.95, "near-duplicate").when(score >= 0.85, "refactoring-candidate").when(score >= 0.75, "similar-logic").otherwise("related-functionality")
