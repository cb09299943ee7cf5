"""The bracket tree of a batch of texts, as arrays.

``tree`` is a vectorised function: a column of texts in, a column of node lists
out. It runs inside the task that holds the text, so the nodes of a text need no
exchange, no sort and no window. Regular expressions cut the texts; everything else is numpy over all the
pieces of a batch at once (running sums that start again at each text).
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from cwescope.session import ship

ship(__name__)

# Tokens of C-like text and the whitespace between them tile the text.
WS = r"[ \t\n\r\f]+"
PIECE_RE = (WS + r"|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?"
            r"|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
            r"|&&|\|\||==|!=|<=|>=|->|\+\+|--|[^ \t\n\r\f]")
OPENERS = {"(": "parenthesized_expression", "{": "compound_statement", "[": "subscript_expression"}
CLOSERS = [")", "}", "]"]
ROOT_TYPE = "translation_unit"

# C keywords (anonymous leaf nodes typed by their own text).
C_KEYWORDS = ["auto", "break", "case", "char", "const", "continue", "default", "do", "double",
              "else", "enum", "extern", "float", "for", "goto", "if", "inline", "int", "long",
              "register", "restrict", "return", "short", "signed", "sizeof", "static", "struct",
              "switch", "typedef", "union", "unsigned", "void", "volatile", "while"]
NAMED = ("identifier", "number_literal", "string_literal", "char_literal")

#: Java's dot leaves out more line ends than Python's.
PIECE = re.compile(PIECE_RE.replace(r"\\.", "\\\\[^\\n\\r\\x85\\u2028\\u2029]"))
BLANK = re.compile(WS)
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
KEYWORDS = frozenset(C_KEYWORDS)

NODE = pa.struct([
    ("node_id", pa.int64()), ("parent", pa.int64()), ("depth", pa.int32()), ("node_type", pa.string()),
    ("text", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_row", pa.int64()),
    ("start_col", pa.int64()), ("end_row", pa.int64()), ("end_col", pa.int64()), ("is_named", pa.bool_()),
    ("child_count", pa.int32()), ("has_error", pa.bool_()), ("sibling", pa.int32()), ("is_leaf", pa.bool_()),
    ("next_leaf", pa.int64()), ("parent_start", pa.int64()), ("parent_end", pa.int64()), ("next_start", pa.int64())])
#: Places of a node's parent and next leaf, only on request: its edges need no join then.
FAR = ["parent_start", "parent_end", "next_start"]
NODE_FIELDS = [n for n in NODE.names if n not in FAR]
#: Fields that need the pieces' places, and those that need parents.
PLACES = {"start_byte", "end_byte", "start_row", "start_col", "end_row", "end_col", *FAR}
LINKS = {"parent", "child_count", "has_error", "sibling", "is_leaf", "next_leaf"}
DDL_TYPES = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean"}


def leaf_type(piece: str) -> str:
    if IDENT.fullmatch(piece):
        return piece if piece in KEYWORDS else "identifier"
    if piece[0].isascii() and piece[0].isdigit():
        return "number_literal"
    if len(piece) > 1 and piece[0] == piece[-1] and piece[0] in "\"'":
        return "string_literal" if piece[0] == '"' else "char_literal"
    return piece if len(piece) == 1 and "!" <= piece <= "~" else "other"


def _facts(piece: str) -> tuple[int, int, int, int, bool]:
    """Bytes, line breaks, bytes behind the last of them, step of the level, blank."""
    size = len(piece.encode())
    breaks = piece.count("\n")
    after = len(piece.rsplit("\n", 1)[1].encode()) if breaks else 0
    return size, breaks, after, 1 if piece in OPENERS else -1 if piece in CLOSERS else 0, bool(BLANK.fullmatch(piece))


def _upto(values: np.ndarray, first: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Running sums that start again at each text."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[1:] - sums[first][owner]


def _before(values: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The value before each item, 0 at the first one of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[opens] = 0
    return out


def _tree(texts: pa.Array, group_text: bool, names: list[str] = NODE_FIELDS) -> pa.Array:
    """Node lists with the fields ``names``; what none of them needs is left out."""
    asked = set(names)
    placed = bool(asked & PLACES) or group_text and "text" in asked
    linked = placed or bool(asked & LINKS)
    codes = texts.to_pylist()
    found = [PIECE.findall(c) if c else [] for c in codes]
    count = np.fromiter(map(len, found), np.int64, len(codes))
    enc = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
    del found
    piece = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = enc.dictionary.to_pylist()
    facts = np.array([_facts(w) for w in words], np.int64).reshape(-1, 5)
    size, breaks, after, step, blank = facts[piece].T

    # pieces: end points
    owner = np.repeat(np.arange(len(codes)), count)
    first = np.cumsum(count) - count
    opens = first[count > 0]
    points, whole = [], None
    if placed:
        end, end_row = _upto(size, first, owner), _upto(breaks, first, owner)
        high = int(end.max(initial=0)) + 1
        line = np.maximum.accumulate(np.where(breaks > 0, end - after, 0) + owner * high) - owner * high
        points = [end - size, end, end_row - breaks, end - size - _before(line, opens), end_row, end - line]
        last = (first + count - 1)[count > 0]
        whole = np.zeros((3, len(codes)), np.int64)  # the end point of each text
        whole[:, count > 0] = points[1][last], points[4][last], points[5][last]

    # tokens: levels and places
    tok = np.flatnonzero(blank == 0)
    piece, step, owner = piece[tok], step[tok], owner[tok]
    count = np.bincount(owner, minlength=len(codes))
    first = np.cumsum(count) - count
    opens = first[count > 0]
    level = _upto(step, first, owner)
    high = len(tok) + 1
    low = np.minimum(0, np.minimum.accumulate(level - owner * 2 * high) + owner * 2 * high)
    level = _before(level - low, opens)
    group = step > 0
    places = _upto(1 + group, first, owner) - (1 + group)
    nodes = 1 + np.bincount(owner, weights=1 + group, minlength=len(codes)).astype(np.int64)
    starts = np.cumsum(nodes) - nodes
    total = int(nodes.sum())
    at = starts[owner] + 1 + places
    heads, leaves = at[group], at + group

    # nodes: the root, a group before its opener, a leaf for each token
    depth = np.zeros(total, np.int32)
    depth[leaves], depth[heads] = level + 1 + group, level[group] + 1
    is_group = np.zeros(total, bool)
    is_group[starts] = is_group[heads] = True
    closer = np.zeros(total, bool)
    closer[leaves] = (step < 0) & (level > 0)
    wrong = np.zeros(total, bool)
    wrong[leaves] = (step < 0) & (level == 0)
    pos = np.zeros((6, total if placed else 0), np.int64)
    for i, p in enumerate(points):
        pos[i, leaves] = p[tok]
        pos[i, heads] = p[tok][group]
    if placed:
        for i, k in ((1, 0), (4, 1), (5, 2)):
            pos[i, starts] = whole[k]

    text_of = np.repeat(np.arange(len(codes)), nodes)
    parent, follows = np.full(total, -1, np.int64), np.full(total, -1, np.int64)
    sibling, child_count = np.zeros(total, np.int32), np.zeros(total, np.int32)
    own = starts[text_of]
    if linked:
        # a parent is the last group before, one level above
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
        for k in range(len(bounds) - 2):
            above, kids = order[bounds[k]:bounds[k + 1]], order[bounds[k + 1]:bounds[k + 2]]
            above = above[is_group[above]]
            parent[kids] = above[np.searchsorted(above, kids) - 1]
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.argsort(parent[kids], kind="stable")]
        new = np.flatnonzero(np.diff(parent[kids], prepend=-1))
        runs = np.diff(np.append(new, len(kids)))
        sibling[kids] = np.arange(len(kids)) - np.repeat(new, runs)
        child_count[parent[kids[new]]] = runs

        # a group ends behind its closer, or with the text
        closing = np.zeros(total, np.int64)
        closing[parent[kids[new]]] = kids[new + runs - 1]
        closed = heads[closer[closing[heads]]]
        open_ = heads[~closer[closing[heads]]]
        if placed:
            for i, k in ((1, 0), (4, 1), (5, 2)):
                pos[i, closed] = pos[i, closing[closed]]
                pos[i, open_] = whole[k][text_of[open_]]
        wrong[open_] = True
        leaf = np.flatnonzero(child_count == 0)  # a leaf's next one in the same text
        same = text_of[leaf[1:]] == text_of[leaf[:-1]]
        follows[leaf[:-1][same]] = leaf[1:][same]

    kinds = [leaf_type(w) if not b else "" for w, b in zip(words, facts[:, 4])]
    types = pa.array([*kinds, *[OPENERS.get(w, "") for w in words], ROOT_TYPE], pa.string())
    kind = np.full(total, 2 * len(words), np.int64)
    kind[leaves], kind[heads] = piece, piece[group] + len(words)
    named = np.array([*[k in NAMED for k in kinds], *[True] * len(words), True])
    word = np.zeros(total, np.int64)
    word[leaves] = piece
    text = None
    if "text" in names:
        text = enc.dictionary.take(pa.array(word, mask=is_group)) if words else pa.nulls(total, pa.string())
    if group_text and text is not None:
        data = [c if c is None else c.encode() for c in codes]
        inner = np.flatnonzero(is_group)
        parts = [None if data[t] is None else data[t][a:b].decode()
                 for t, a, b in zip(text_of[inner], pos[0, inner], pos[1, inner])]
        text = pc.replace_with_mask(text, pa.array(is_group), pa.array(parts, pa.string()))
    made = dict(zip(NODE.names, [
        lambda: np.arange(total) - own, lambda: pa.array(parent - own, mask=parent < 0), lambda: depth,
        lambda: types.take(pa.array(kind)), lambda: text, *[lambda p=p: p for p in pos], lambda: named[kind],
        lambda: child_count, lambda: wrong, lambda: sibling, lambda: child_count == 0,
        lambda: pa.array(follows - own, mask=follows < 0), lambda: pa.array(pos[0, parent], mask=parent < 0),
        lambda: pa.array(pos[1, parent], mask=parent < 0), lambda: pa.array(pos[0, follows], mask=follows < 0)]))
    columns = [made[n]() for n in names]
    rows = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                      fields=[NODE.field(n) for n in names])
    return pa.ListArray.from_arrays(pa.array(np.append(starts, total), pa.int32()), rows)


def node_list(text: Column, group_text: bool = False, names: list[str] | None = None) -> Column:
    """The nodes of each text in pre-order; the root alone for an empty or null
    one. ``names``: the fields that are wanted, as each one costs its way out of Python."""
    names = list(names or NODE_FIELDS)
    ddl = ",".join(f"{n}:{DDL_TYPES[NODE.field(n).type]}" for n in names)

    @F.arrow_udf(f"array<struct<{ddl}>>")
    def nodes(texts: pa.Array) -> pa.Array:
        return _tree(texts, group_text, names)

    return nodes(text)
