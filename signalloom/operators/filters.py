"""The read filter grammar: FIELD OP VALUE, joined by ';', as one Column."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "FLAGS^^1024;FLAGS^^512"
_TERM = re.compile(r"^\s*([A-Za-z0-9]+)\s*(<=|>=|!=|\^\^|&&|<|>|=)\s*(.*?)\s*$")
#: Fields of a read that are columns; any other name is an optional tag.
FIELDS = {"CHR": "ref", "MAPQ": "mapq", "FLAGS": "flag", "STRAND": "strand", "FOPSTRAND": "fop_strand"}


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def term(text: str, tags: str | None = "tags") -> Column | None:
    """One condition; a row without the tag is kept. None, with a warning, if it can't be read."""
    m = _TERM.match(text)
    if not m:
        warnings.warn(f"filter {text!r} can't be read and is ignored", stacklevel=2)
        return None
    field, op, value = m[1], m[2], _value(m[3])
    if field.upper() in FIELDS:
        col = F.col(FIELDS[field.upper()])
    elif tags is None:
        col = F.col(field)
    else:
        col = F.col(tags)[field]
    if op in ("^^", "&&"):
        bits = F.lit(int(value))
        got = col.cast("int").bitwiseAND(bits)
        test = got == 0 if op == "^^" else got == bits
    else:
        if isinstance(value, int | float):
            col = col.cast("double")
        v = F.lit(value)
        test = {"<": col < v, "<=": col <= v, "=": col == v, "!=": col != v, ">": col > v, ">=": col >= v}[op]
    return col.isNull() | test


def on_references(df: DataFrame, names: Sequence[str] = (), skip: Sequence[str] = (), ref: str = "ref") -> DataFrame:
    """Rows of these references (all, if none are named), without those to skip; a name with or without chr is the same."""
    bare = F.regexp_replace(ref, "^chr", "")
    cut = lambda names: [n.removeprefix("chr") for n in names]
    out = df.where(bare.isin(cut(names))) if names else df
    return out.where(~bare.isin(cut(skip))) if skip else out


def read_filter(text: str | None, tags: str | None = "tags") -> Column:
    """All conditions of a ';'-joined list; None is the default list, 'none' keeps every read."""
    text = DEFAULT if text is None else text
    out = F.lit(True)
    if text.strip().lower() in ("none", ""):
        return out
    for part in text.split(";"):
        if part.strip() and (c := term(part, tags)) is not None:
            out = out & c
    return out
