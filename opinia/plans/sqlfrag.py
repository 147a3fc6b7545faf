"""DuckDB SQL fragments mirroring the Spark expressions, for oracle SQL."""

from __future__ import annotations

from opinia.functions.text import LETTER_OR_SPACE_NEGATED, PUNCTUATION, TOKEN_PATTERN, WHITESPACE_RUN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WS = q(WHITESPACE_RUN)
PUNCT = q(PUNCTUATION)
TOKEN = q(TOKEN_PATTERN)
NON_LETTER = q(LETTER_OR_SPACE_NEGATED)


def split_words(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, {WS}), lambda x: x <> '')"


def clean_word(expr: str) -> str:
    return f"lower(trim({expr}, {PUNCT}))"


def clean_words(expr: str) -> str:
    return f"list_filter(list_transform({split_words(expr)}, lambda x: {clean_word('x')}), lambda x: x <> '')"


def letters_only(expr: str) -> str:
    return f"lower(regexp_replace({expr}, {NON_LETTER}, '', 'g'))"


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {TOKEN})"


def ngrams(expr: str, lo: int, hi: int) -> str:
    parts = []
    for n in range(lo, hi + 1):
        if n == 1:
            parts.append(expr)
        else:
            parts.append(
                f"(CASE WHEN len({expr}) >= {n} THEN list_transform(range(1, len({expr}) - {n} + 2), "
                f"lambda i: array_to_string({expr}[i:i + {n - 1}], ' ')) ELSE []::VARCHAR[] END)"
            )
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")"


def char_count(expr: str, ch: str) -> str:
    return f"(length({expr}) - length(replace({expr}, {q(ch)}, '')))"


def upper_count(expr: str) -> str:
    return f"length(regexp_replace({expr}, '[^\\p{{Lu}}]', '', 'g'))"


def md5_unit(key_expr: str, seed: int) -> str:
    """Uniform [0,1) from md5 of ``key:seed`` — pairs with
    ``opinia.operators.prep.hash_unit``."""
    return f"(('0x' || substr(md5(CAST({key_expr} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


def strip_ws(expr: str) -> str:
    return f"regexp_replace({expr}, '^' || {WS} || '|' || {WS} || '$', '', 'g')"


def clean_output_inner(expr: str) -> str:
    return f"replace(replace({expr}, chr(10), ' '), '’', '''')"


def clean_output(expr: str) -> str:
    return strip_ws(clean_output_inner(expr))


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def tfidf_ctes(src: str, spec, p: str = "tf") -> str:
    """DuckDB CTEs computing the TF-IDF of ``src`` (a SELECT of ``id, text``)
    with the same semantics as ``opinia.operators.tfidf``; the final CTE
    ``{p}_w`` has ``(id, term, weight)`` and ``{p}_voc`` has ``(term, idf)``."""
    text = "coalesce(text, '')"
    if spec.letters_only:
        text = letters_only(text)
    tk = tokens(text)
    if spec.stop_words:
        tk = f"list_filter({tk}, lambda w: NOT list_contains({str_list(spec.stop_words)}, w))"
    min_count = spec.min_df if isinstance(spec.min_df, int) else f"{spec.min_df!r} * (SELECT n FROM {p}_n)"
    max_count = f"{spec.max_df!r} * (SELECT n FROM {p}_n)" if isinstance(spec.max_df, float) else spec.max_df
    limit = f"ORDER BY total DESC, term LIMIT {spec.max_features}" if spec.max_features else ""
    tfw = "(1 + ln(tf))" if spec.sublinear else "CAST(tf AS DOUBLE)"
    return f"""
{p}_src AS ({src}),
{p}_tk AS (SELECT id, {tk} AS tk FROM {p}_src),
{p}_g AS (SELECT id, unnest({ngrams('tk', spec.lo, spec.hi)}) AS term FROM {p}_tk),
{p}_tf AS (SELECT id, term, count(*) AS tf FROM {p}_g GROUP BY id, term),
{p}_n AS (SELECT count(*) AS n FROM {p}_src),
{p}_st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM {p}_tf GROUP BY term),
{p}_kept AS (SELECT * FROM {p}_st WHERE df >= {min_count} AND df <= {max_count} {limit}),
{p}_voc AS (SELECT term, ln((1.0 + (SELECT n FROM {p}_n)) / (1.0 + df)) + 1.0 AS idf FROM {p}_kept),
{p}_raw AS (SELECT id, term, {tfw} * idf AS w FROM {p}_tf JOIN {p}_voc USING (term)),
{p}_w AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {p}_raw)"""
