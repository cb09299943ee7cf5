"""Column expressions for ids, file names, URLs, rules and label vectors.

All are built-in Spark expressions (no UDF): they run inside whole-stage
codegen and work unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commit-URL patterns (prefix match, trailing text allowed).
GITHUB_COMMIT = r"^https://github\.com/([^/]+)/([^/]+)/commit/([0-9a-fA-F]{7,})"
GITLAB_COMMIT = r"^https://gitlab\.com/((?:[^/]+/)*[^/]+)/-/commit/([0-9a-fA-F]{7,})"
# Fixed value: scanner result URL -> sample key.
URL_KEY = r"_([0-9]+)\.c"

# Ordered scanner-rule substrings -> CWE (first match wins).
RULE_TO_CWE = [
    (("path-manipulation",), "CWE-22"),
    (("unbounded-copy-to-stack-buffer", "unvalidated-array-index"), "CWE-120"),
    (("function-use-after-free", "local-variable-malloc-free", "null-library-function"), "CWE-416"),
    (("double-free",), "CWE-415"),
    (("info-leak-on-non-formated-string",), "CWE-532"),
    (("correctness.sizeof-pointer-type.sizeof-pointer-type",), "CWE-467"),
    (("insecure-hash",), "CWE-328"),
    (("snprintf-source-size",), "CWE-787"),
    (("alloc-strlen",), "CWE-131"),
    (("tainted-allocation-size",), "CWE-125"),
    (("world-writable-file",), "CWE-732"),
    (("insecure-use-strtok-fn",), "CWE-676"),
    (("command-injection-path",), "CWE-78"),
]


def _nz(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)


def parse_git_url(url: Column) -> Column:
    """struct(project, commit_id) from a GitHub or GitLab commit URL, else nulls."""
    gh_owner = F.regexp_extract(url, GITHUB_COMMIT, 1)
    gh = F.when(gh_owner != "", F.concat(gh_owner, F.lit("/"), F.regexp_extract(url, GITHUB_COMMIT, 2)))
    gh_commit = _nz(F.regexp_extract(url, GITHUB_COMMIT, 3))
    gl = _nz(F.regexp_extract(url, GITLAB_COMMIT, 1))
    gl_commit = _nz(F.regexp_extract(url, GITLAB_COMMIT, 2))
    return F.struct(F.coalesce(gh, gl).alias("project"),
                    F.when(gh.isNotNull(), gh_commit).otherwise(gl_commit).alias("commit_id"))


def file_stem(path: Column) -> Column:
    """Last path component without its last extension (``a/b.c.d`` -> ``b.c``)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)) \
        .otherwise(name)


def key_from_filename(path: Column) -> Column:
    """Last ``_`` part of the file stem; '' for an empty / null name."""
    return F.when(path.isNull() | (path == ""), F.lit("")).otherwise(
        F.element_at(F.split(file_stem(path), "_", -1), -1))


def key_from_url(url: Column) -> Column:
    """Digits of the first ``_<digits>.c`` in a URL, '' when absent."""
    return F.coalesce(F.regexp_extract(url, URL_KEY, 1), F.lit(""))


def project_fallback(looked_up: Column, path: Column) -> Column:
    """Looked-up project, else all name parts but the last two (>= 3 parts), else 'unknown'."""
    parts = F.split(file_stem(path), "_", -1)
    guess = F.when(F.size(parts) >= 3,
                   F.array_join(F.slice(parts, 1, F.size(parts) - 2), "_")).otherwise(F.lit("unknown"))
    return F.when(looked_up.isNull() | (looked_up == "") | (looked_up == "unknown"), guess) \
        .otherwise(looked_up)


def rule_to_cwe(rule: Column) -> Column:
    """Scanner rule name -> CWE by ordered substring rules; null when none matches."""
    out = None
    for subs, cwe in RULE_TO_CWE:
        cond = None
        for s in subs:
            c = F.coalesce(rule, F.lit("")).contains(s)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, F.lit(cwe)) if out is None else out.when(cond, F.lit(cwe))
    return out


def ensure_list(c: Column) -> Column:
    """string -> [string], '' -> [], null -> []."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))


def multi_hot(labels: Column, classes: list[str]) -> Column:
    """Label list -> 0/1 vector over ``classes``; unknown labels ignored, null -> zeros."""
    cls = F.array(*[F.lit(c) for c in classes])
    idx = F.transform(F.coalesce(labels, F.array().cast("array<string>")),
                      lambda x: F.array_position(cls, x) - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(len(classes) - 1)),
                       lambda i: F.array_contains(idx, i).cast("int"))
