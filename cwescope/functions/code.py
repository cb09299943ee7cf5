"""Column expressions over source text: comments, complexity, flags.

Every function here is a native Spark expression over a whole text column
(regex evaluation happens in the JVM, per row, inside codegen).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# String / char literals are matched first and kept (group 1), so comment
# markers inside literals survive; block and line comments are dropped.
COMMENT_OR_LITERAL = (r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
                      r"|/\*(?:[^*]|\*+[^*/])*\*+/|//[^\n]*")

# Branch tokens counted by the cyclomatic approximation and the
# tokenizer they are taken from.
BRANCH_TOKENS = ["if", "else", "while", "for", "case", "&&", "||", "catch"]
TOKEN_RE = r"(?U)\w+|&&|\|\|"

# The six danger patterns, searched in lower-cased text.
DANGER_PATTERNS = [
    ("unsafe_string", r"strcpy|strcat|gets|sprintf|vsprintf"),
    ("memory", r"malloc|free|realloc|calloc"),
    ("input", r"scanf|bscanf|bsscanf|fgets|read|getchar|getc|getc_unlocked"),
    ("command", r"system|exec|popen"),
    ("bounded_string", r"strncpy|strncat|snprintf|vsnprintf"),
    ("pointer_arith", r"\*\s*\([^)]*\+[^)]*\)"),
]

# Risky API calls and the validation hints looked for around them.
UNSAFE_APIS = ["strcpy", "gets", "sprintf", "malloc", "free"]
VALIDATION_KEYWORDS = ["if", "len", "sizeof", "check", "assert", "return"]
RISK_VALIDATED, RISK_UNVALIDATED = 0.2, 0.9


def strip_comments(text: Column) -> Column:
    """Remove every line and block comment; literals are kept verbatim."""
    return F.regexp_replace(text, COMMENT_OR_LITERAL, "$1")


def cyclomatic(text: Column) -> Column:
    """1 + number of branch tokens (comments are not removed first)."""
    toks = F.regexp_extract_all(text, F.lit(TOKEN_RE), 0)
    branch = F.array(*[F.lit(t) for t in BRANCH_TOKENS])
    return F.size(F.filter(toks, lambda t: F.array_contains(branch, t))) + 1


def loc(text: Column) -> Column:
    """Line count = newlines + 1 (an empty text has one line)."""
    return F.size(F.split(text, "\n", -1))


def danger_flags(text: Column) -> list[Column]:
    low = F.lower(text)
    return [low.rlike(p).cast("int").alias(f"flag_{name}") for name, p in DANGER_PATTERNS]


def api_call(line: Column, api: str) -> Column:
    return line.rlike(rf"\b{api}\s*\(")


def has_validation(context: Column) -> Column:
    cond = None
    for k in VALIDATION_KEYWORDS:
        c = context.contains(k)
        cond = c if cond is None else (cond | c)
    return cond


def scaled_count(x: Column, cap: float = 10.0) -> Column:
    return F.least(x / cap, F.lit(1.0))


def scaled_log(d: Column) -> Column:
    return F.least(F.log1p(d) / 10.0, F.lit(1.0))


LOG_SCALE_MAX = math.e ** 10
