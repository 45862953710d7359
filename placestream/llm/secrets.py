"""Operator 7: secrets in texts by patterns and sliding-window entropy (SQL functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run of 20 or more (24 or more) holds the pattern's leftmost match whole; shorter runs fail.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy method, and its window.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character that some window must reach, by the character class of the candidate.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Parts of candidates that are no secret: placeholders, runs of one character, file or site paths.
#: What stands on either side of them is judged on its own.
ALLOWED = r"(?i:example|sample|placeholder|changeme|dummy|1234567|abcdef)|(?:/[A-Za-z_-]+)+/|" + "|".join(f"{c if c.isalnum() or c == '/' else chr(92) + c}{{4,}}" for c in ALPHABET)
#: c * log2(c), in whole parts of this size, so that sums do not depend on the order of their terms.
_PARTS = 1 << 40
#: Matches whose places are summed up in one block.
_BLOCK = 256


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def spans(text: str, pattern: str, keep: str = "true") -> str:
    """SQL for array<struct<s, e, m>>: leftmost non-overlapping matches in code points, end exclusive.

    Matches and the gaps between them alternate, so their lengths add up to positions: within blocks
    of matches first, then over the blocks, so that the work stays near the number of matches.
    ``keep`` is a condition on x.m that drops matches after they have consumed their characters.
    """
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    gaps = f"split({text}, {_quoted(pattern)}, -1)"
    none = "cast(array() as array<struct<s: int, e: int, m: string>>)"
    blocks = f"transform(sequence(0, (size(z) - 1) div {_BLOCK}), b -> slice(z, b * {_BLOCK} + 1, {_BLOCK}))"
    inner = (
        f"transform({blocks}, b -> aggregate(b, named_struct('at', 0, 'out', {none}),"
        " (a, x) -> named_struct('at', a.at + length(x.`0`) + coalesce(length(x.`1`), 0), 'out',"
        " if(x.`1` is null, a.out, concat(a.out, array(named_struct('s', a.at + length(x.`0`), 'e', a.at + length(x.`0`) + length(x.`1`), 'm', x.`1`)))))))"
    )
    bases = "aggregate(l, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + x.at, 'out', concat(a.out, array(a.at))), a -> a.out)"
    placed = _let(inner, "l", f"flatten(zip_with(l, {bases}, (k, d) -> transform(k.out, y -> named_struct('s', y.s + d, 'e', y.e + d, 'm', y.m))))")
    walk = _let(f"arrays_zip({gaps}, {found})", "z", placed)
    return f"if({text} rlike {_quoted(pattern)}, filter({walk}, x -> {keep}), {none})"


def peak_entropy(candidate: str, enough: str = "1e9D", window: int = WINDOW) -> str:
    """SQL for the largest Shannon entropy, in bits a character, of any window of ``candidate``.

    Counts are kept as the window slides, as one character each of a string: one letter comes in and
    one goes out at each step, and the sum of c*log2(c) changes by their terms only. Windows after
    one that has ``enough`` bits are passed over. The work is linear in the candidate's length.
    """
    terms = "array(" + ", ".join(f"{round(c * math.log2(c) * _PARTS) if c else 0}L" for c in range(window + 2)) + ")"
    count = lambda at: f"(ascii(substring(a.c, {at}, 1)) - 48)"
    put = lambda into, at, n: f"overlay({into} placing chr({n} + 48) from {at} for 1)"
    grown = f"a.s + {terms}[{count('x.i')} + 1] - {terms}[{count('x.i')}] - if(x.o > 0, {terms}[{count('x.o')}] - {terms}[greatest({count('x.o')} - 1, 0)], 0L)"
    counts = put(f"if(x.o > 0, {put('a.c', 'x.o', count('x.o') + ' - 1')}, a.c)", "x.i", count("x.i") + " + 1")
    limit = f"({math.log2(window)!r}D - {enough}) * {float(window * _PARTS)!r}D"
    step = f"(a, x) -> if(a.low <= a.limit or (x.i = x.o and x.n > {window}), a, {_let(grown, 's', f'named_struct({chr(39)}c{chr(39)}, {counts}, {chr(39)}s{chr(39)}, s, {chr(39)}low{chr(39)}, if(x.n >= {window}, least(a.low, s), a.low), {chr(39)}limit{chr(39)}, a.limit)')})"
    moves = f"transform(v, (i, n) -> named_struct('i', i, 'o', if(n >= {window}, v[greatest(n - {window}, 0)], 0), 'n', n + 1))"
    start = f"named_struct('c', repeat('0', {len(ALPHABET)}), 's', 0L, 'low', {1 << 62}L, 'limit', {limit})"
    codes = f"transform(split({candidate}, ''), y -> locate(y, '{ALPHABET}'))"
    return _let(codes, "v", f"aggregate({moves}, {start}, {step}, a -> {math.log2(window)!r}D - least(a.low, a.s) / {float(window * _PARTS)!r}D)")


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _assign, _access, _hex and _entropy: arrays of spans (s, e, m) found in the text.

    Columns of these four names are replaced; all others stay. Null text counts as empty and has no
    spans. Texts of any length are scanned whole; repeated rows are scanned each. The four arrays are
    in text order and may overlap one another. A candidate of the entropy method is a secret if,
    outside its allowed parts, it has a run of WINDOW characters or more with a letter, a digit and
    a window of enough bits.
    """
    text = f"coalesce(`{text_col}`, '')"
    value = f"length(regexp_extract(x.m, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}"
    bits = f"if(p rlike '^[0-9a-fA-F]+$', {HEX_BITS}D, {MIXED_BITS}D)"
    part = f"length(p) >= {WINDOW} and p rlike '[0-9]' and p rlike '[A-Za-z]' and {_let(bits, 'bits', peak_entropy('p', 'bits') + ' >= bits')}"
    secret = f"x.m rlike '[0-9]' and x.m rlike '[A-Za-z]' and exists(split(x.m, {_quoted(ALLOWED)}, -1), p -> {part})"
    # all four from the one text column, before any of them is replaced
    found = {"_assign": spans(text, ASSIGN, value), "_access": spans(text, ACCESS), "_hex": spans(text, HEX), "_entropy": spans(text, CANDIDATE, secret)}
    return docs.withColumns({name: F.expr(sql) for name, sql in found.items()})


def _digest(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, then end."""
    each = ", ".join(f"transform(_{k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(kinds))
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return F.expr(f"array_join(transform(array_sort(concat({each})), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_digest(KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        _digest(KINDS).alias("spans"),
    )


def _duck_spans(pattern: str, keep: str = "true") -> str:
    """DuckDB for the spans of one kind, from matches and the gaps between them."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      's': list_sum(list_transform(g[1:i], lambda y: length(y)))::int + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0)::int,
      'm': m[i]}}), lambda x: {keep}) from (select regexp_extract_all(t, {quoted}) as m, string_split_regex(t, {quoted}) as g)"""


_DUCK_ASSIGN = ASSIGN.replace("((?i:password|passwd|secret|token|api_?key))", "((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))")
_DUCK_WINDOWS = f"list_max(list_transform(range(1, length(p) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(p, i, {WINDOW}), ''), 'entropy')))"
_DUCK_SECRET = (
    f"len(list_filter(string_split_regex(x.m, '{ALLOWED}'), lambda p: length(p) >= {WINDOW} and regexp_matches(p, '[0-9]') and regexp_matches(p, '[A-Za-z]')"
    f" and {_DUCK_WINDOWS} >= case when regexp_matches(p, '^[0-9a-fA-F]+$') then {HEX_BITS} else {MIXED_BITS} end)) > 0"
)
_DUCK_JOIN = "array_to_string(list_transform(list_sort(list_concat({parts})), lambda x: {names}[x.k] || ':' || x.s || ':' || x.e), ',')"


def _duck_digest(kinds: tuple[str, ...]) -> str:
    parts = [f"list_transform(a{i}, lambda x: {{'s': x.s, 'k': {i + 1}, 'e': x.s + length(x.m)}})" for i in range(len(kinds))]
    joined = parts[0]
    for p in parts[1:]:
        joined = f"list_concat({joined}, {p})"
    return f"array_to_string(list_transform(list_sort({joined}), lambda x: {list(kinds)}[x.k] || ':' || x.s || ':' || x.e), ',')"


OP7_SQL = f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as (select doc_id,
  (select {_duck_spans(_DUCK_ASSIGN, f"length(regexp_extract(x.m, '{_DUCK_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= {ASSIGN_LEAST}")}) as a0,
  (select {_duck_spans(ACCESS)}) as a1,
  (select {_duck_spans(HEX)}) as a2,
  (select {_duck_spans(CANDIDATE, _DUCK_SECRET)}) as a3
  from docs)
select doc_id, len(a0)::bigint as n_assign, len(a1)::bigint as n_access, len(a2)::bigint as n_hex, len(a3)::bigint as n_entropy,
  sha256({_duck_digest(KINDS[:3])}) as base_sha256, {_duck_digest(KINDS)} as spans
from found
"""
