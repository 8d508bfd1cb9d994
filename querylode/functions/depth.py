"""What depends on how deep a token stands in parentheses: one walk over the tokens of each text, in Arrow batches.

Spark cuts the tokens; arrays that grow inside a Spark fold would be copied at every step, here each token costs the same.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

JOIN = "struct<left_table:string,right_table:string,join_type:string>"


def _outline(tokens) -> str:
    deep, kept = 0, []
    for tok in tokens:
        if deep == 0 or (tok == ")" and deep == 1):
            kept.append(tok)
        deep = deep + 1 if tok == "(" else max(deep - 1, 0) if tok == ")" else deep
    return "".join(kept)


def _conditions(tokens) -> list[str]:
    deep, begin, between, cuts = 0, None, False, []  # ``begin``: where the open condition starts
    for i, tok in enumerate(tokens):
        if tok == "(" or tok == ")":
            deep = max(deep + (1 if tok == "(" else -1), 0)
        elif deep == 0:
            word = tok.upper()
            if begin is None:
                if word == "WHERE":
                    begin, between = i + 1, False
            elif word in fv.WHERE_TERMINATORS:
                cuts.append((begin, i))
                begin = None
            elif word == "OR" or (word == "AND" and not between):
                cuts.append((begin, i))
                begin, between = i + 1, False
            elif word in ("AND", "BETWEEN"):
                between = word == "BETWEEN"
    if begin is not None:
        cuts.append((begin, len(tokens)))
    return ["".join(tokens[a:b]) for a, b in cuts]


def _selects(tokens) -> list[str]:
    open_, fresh, found = [], False, []  # open parentheses: place, and whether a SELECT follows
    for i, tok in enumerate(tokens):
        if tok == "(":
            open_.append([i, False])
        elif tok == ")":
            if open_:
                place, select = open_.pop()
                if select:
                    found.append("".join(tokens[place : i + 1]))
        elif fresh and tok.upper() == "SELECT":
            open_[-1][1] = True
        fresh = tok == "(" or (fresh and tok.isspace())
    return found


def _joins(text, verb, kind, target) -> list[dict]:
    last, found = [None], []  # the latest relation of each open level
    for step, word, how, relation in zip(text, verb, kind, target):
        if step == "(":
            last.append(None)
        elif step == ")":
            if len(last) > 1:
                inner = last.pop()
                last[-1] = inner if last[-1] is None else last[-1]
        elif relation:
            if not word and last[-1] is not None:
                found.append({"left_table": last[-1], "right_table": relation, "join_type": how.upper() or "INNER"})
            last[-1] = relation
    return found


def _none(value) -> bool:
    return value is None


def outline(tokens: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if _none(t) else _outline(t))

    return F.pandas_udf(run, "string")(tokens)


def conditions(tokens: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if _none(t) else _conditions(list(t)))

    return F.pandas_udf(run, "array<string>")(tokens)


def selects(tokens: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: None if _none(t) else _selects(list(t)))

    return F.pandas_udf(run, "array<string>")(tokens)


def joins(text: Column, verb: Column, kind: Column, target: Column) -> Column:
    """From the matches of parentheses and relations: their text, FROM, the kind of a join and the relation's name."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if _none(t) else _joins(t, v, k, r) for t, v, k, r in zip(a, b, c, d)])

    return F.pandas_udf(run, f"array<{JOIN}>")(text, verb, kind, target)
