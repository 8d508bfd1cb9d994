"""Which table a qualified column belongs to: aliases by nested scopes, one walk over the tokens of each text.

Every SELECT is a scope, one in parentheses lies inside the scope around it, and an alias belongs to the innermost scope
that declares it, before or after its use. A first walk notes scopes, declarations and references in order; a second keeps
a stack of tables per alias, so each reference costs the same however deep it stands.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

QUALIFIED = "array<struct<table_name:string,column_name:string>>"
_NAME = re.compile(r'[^\W\d]\w*|"[^"]+"')
# Names that decide where the walk goes on.
_DECIDING = {
    *fv.SET_OPERATORS, *fv.RELATION_FOLLOWS, *fv.LIST_ENDS, *fv.BEFORE_RELATION, *fv.AFTER_RELATION,
    "AS", "DISTINCT", "INTO", "SELECT", "USING", "WITH",
}
# Bits for the spellings of a name, in upper and lower case, that one text has.
_SPELLINGS = 6


class _Level:
    """One open parenthesis: 'query' has a scope of its own, 'group' holds relations of a FROM, 'other' neither."""

    def __init__(self, kind, scope, wants=False):
        self.kind, self.scope = kind, scope
        self.wants = wants  # a relation comes next: True, or 'using' or 'call', where a parenthesis is no group of relations
        self.listing = wants  # inside a FROM list, where a comma asks for the next relation
        self.unnamed = None  # the relation that an alias may follow


def _words(tokens):
    """(text, parts) of every token but blanks and backticks; a dotted name is one entry, other tokens have no parts."""
    kept = [t for t in tokens if t != "`" and not t.isspace()]
    i, out = 0, []
    while i < len(kept):
        if not _NAME.fullmatch(kept[i]):
            out.append((kept[i], None))
            i += 1
            continue
        parts = [kept[i].strip('"')]
        while i + 2 < len(kept) and kept[i + 1] == "." and _NAME.fullmatch(kept[i + 2]):
            i += 2
            parts.append(kept[i].strip('"'))
        out.append((kept[i], parts))
        i += 1
    return out


def _events(tokens):
    """The text's scopes as ('open' | 'close', number) and its references as ('use', parts); declarations per scope."""
    words = _words(tokens)
    declared: list[dict] = [{}]
    events, levels = [("open", 0)], [_Level("query", 0)]

    def renew(level):
        events.append(("close", level.scope))
        declared.append({})
        level.scope, level.wants, level.listing, level.unnamed = len(declared) - 1, False, False, None
        events.append(("open", level.scope))

    def name(level, alias=None):
        """Declare the relation read last, under its alias or its own names."""
        if level.unnamed is not None:
            table, level.unnamed = level.unnamed, None
            keys = {alias} if alias else {table, table.rsplit(".", 1)[-1]} - {""}
            declared[level.scope].update((key.lower(), table or None) for key in keys)

    for i, (text, parts) in enumerate(words):
        level = levels[-1]
        word = text.upper() if parts is None or len(parts) == 1 else ""
        follows = words[i + 1][0] if i + 1 < len(words) else ""
        if text == "(":
            name(level)
            inner = follows.upper()
            if inner in ("SELECT", "WITH"):
                declared.append({})
                levels.append(_Level("query", len(declared) - 1))
                events.append(("open", len(declared) - 1))
            elif level.wants is True:
                levels.append(_Level("group", level.scope, True))
            else:
                levels.append(_Level("other", level.scope))
        elif text == ")":
            name(level)
            if len(levels) > 1:
                levels.pop()
                if level.kind == "query":
                    events.append(("close", level.scope))
                outer = levels[-1]
                if outer.wants:  # a derived table, or a group that may have an alias
                    outer.wants, outer.unnamed = False, ""
        elif level.kind != "other" and (word in fv.SET_OPERATORS or text == ";"):
            name(level)
            if level.kind == "query":
                renew(level)
        elif level.kind != "other" and word in fv.RELATION_FOLLOWS and not (i and words[i - 1][0].upper() == "DISTINCT"):
            name(level)
            level.wants, level.listing = True, level.listing or word == "FROM"
        elif level.kind != "other" and word == "USING":
            name(level)
            level.wants = "using"  # parentheses after it are columns, unless they hold a query
        elif level.kind != "other" and text == "," and level.listing:
            name(level)
            level.wants = True
        elif word in fv.LIST_ENDS:
            name(level)
            level.wants = level.listing = False
        elif parts is None:
            name(level)
            level.wants = False
        elif level.wants and word not in fv.BEFORE_RELATION:
            if follows == "(" and words[i - 1][0].upper() != "INTO":  # a function that returns rows
                level.wants = "call"
            else:
                level.wants, level.unnamed = False, ".".join(parts)
        elif level.unnamed is not None and len(parts) == 1:
            if word != "AS":
                name(level, None if word in fv.AFTER_RELATION else parts[0])
        elif len(parts) > 1 and follows != "(":
            events.append(("use", parts))
    name(levels[-1])
    events += [("close", level.scope) for level in reversed(levels) if level.kind == "query"]
    return events, declared


def _qualified(tokens) -> set[tuple]:
    events, declared = _events(tokens)
    tables, found = {}, set()
    for what, item in events:
        if what == "open":
            for alias, table in declared[item].items():
                tables.setdefault(alias, []).append(table)
        elif what == "close":
            for alias in declared[item]:
                tables[alias].pop()
        else:
            whole, first = ".".join(item[:-1]).lower(), item[0].lower()
            if tables.get(whole):
                found.add((tables[whole][-1], item[-1]))
            elif tables.get(first):  # a field inside a column
                found.add((tables[first][-1], item[1]))
            else:
                found.add((None, item[-1]))
    return found


def _kind(token: str) -> str | None:
    """What stands for a token: '' for what the walk skips, '0' for a literal, None for a name that no keyword is and that may
    be called otherwise, '"' for one that may not, else the token."""
    if token == "`" or token.isspace():
        return ""
    if not _NAME.fullmatch(token):
        return "0" if token[0] == "'" or token[0].isdigit() else token
    if token[0] == '"' or not token.isascii():
        return '"'
    return token if token.upper() in _DECIDING else None


def _stand_in(number: int, spelling: int) -> str:
    """A name in place of the text's own: those of the same number are equal but for upper and lower case."""
    return f"x{number}" + "".join("aA"[spelling >> i & 1] for i in range(max(_SPELLINGS, spelling.bit_length())))


def _numbered(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The number, within its row, of each entry's value: 0 for the first one that comes, and so on."""
    _, first, which = np.unique(row * (int(value.max(initial=0)) + 1) + value, return_index=True, return_inverse=True)
    by_place = np.argsort(first, kind="stable")
    rows = row[first[by_place]]
    number = np.empty(len(first), np.int64)
    number[by_place] = np.arange(len(first)) - np.searchsorted(rows, rows)
    return number[which]


def _places(numbers: np.ndarray, kinds: list[str]) -> list[tuple] | None:
    """What the walk finds in a text of this shape: the places of the names in each (table_name, column_name).
    None if a name has too many spellings."""
    spellings, shape = {}, []
    for token in numbers.tolist():
        if token < 0:
            shape.append(kinds[-1 - token])
        else:
            same = spellings.setdefault(token >> 32, {})
            shape.append(_stand_in(token >> 32, same.setdefault(token, len(same))))
    if any(len(same) > 1 << _SPELLINGS for same in spellings.values()):
        return None
    place = {}
    for i, token in enumerate(shape):
        place.setdefault(token, i)
    return [(t and [place[p] for p in t.split(".")], place[c]) for t, c in _qualified(shape)]


def _distinct(rows: pa.Array) -> pa.Array:
    """The columns of each text. Texts that differ in literals, blanks and names alone are walked once in a batch, with other
    names in the place of theirs."""
    coded = rows.flatten().dictionary_encode()
    texts = coded.dictionary.to_pylist()
    kinds = [_kind(t) for t in texts]
    kept, lower, stands = {}, {}, []
    for text, kind in zip(texts, kinds):
        stands.append(lower.setdefault(text.lower(), len(lower)) if kind is None else -1 - kept.setdefault(kind, len(kept)))
    stands, fixed = np.array(stands, dtype=np.int64), list(kept)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(rows)), sizes)
    seen = stands[codes] != -1 - kept.get("", len(kept))
    row, codes = row[seen], codes[seen]
    numbers = stands[codes]
    own = np.flatnonzero(numbers >= 0)
    numbers[own] = (_numbered(row[own], numbers[own]) << 32) + _numbered(row[own], codes[own])
    bounds = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
    quoted = set(row[stands[codes] == -1 - kept.get('"', len(kept))].tolist())
    codes, walked = codes.tolist(), {}
    tables, columns, ends = [], [], [0]
    for i in range(len(rows)):
        at, end = bounds[i], bounds[i + 1]
        found = None
        if i not in quoted:
            key = numbers[at:end].tobytes()
            found = walked.get(key, False)
            if found is False:
                found = walked[key] = _places(numbers[at:end], fixed)
        if found is None:
            found = _qualified([texts[code] for code in codes[at:end]])
        else:
            found = [(t and ".".join([texts[codes[at + p]] for p in t]), texts[codes[at + c]]) for t, c in found]
        for table, column in sorted(found, key=lambda f: (f[0] or "", f[1])):
            tables.append(table)
            columns.append(column)
        ends.append(len(tables))
    pairs = pa.StructArray.from_arrays([pa.array(tables, pa.string()), pa.array(columns, pa.string())], ["table_name", "column_name"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, mask=rows.is_null())


def qualified(tokens: Column) -> Column:
    """Distinct (table_name, column_name) of the names written with a qualifier.

    ``table_name`` is the relation that the innermost scope declares for the qualifier; null where that is a derived table
    or the qualifier is declared nowhere. Names after which a parenthesis opens are calls, not columns.
    """

    def run(rows: pa.Array) -> pa.Array:
        return _distinct(rows)

    return F.arrow_udf(run, QUALIFIED)(tokens)
