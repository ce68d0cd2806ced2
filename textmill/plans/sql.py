"""Building blocks of the DuckDB statements that check the queries."""

from __future__ import annotations

from textmill.functions.lexicon import STOPWORDS, accent_table
from textmill.functions.text import accent_pattern, build_matcher, query_terms

STOP_LIST = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def plain(x: str) -> str:
    source, target = accent_table()
    return f"translate(lower({x}), {lit(source)}, {lit(target)})"


def fold(x: str) -> str:
    t = plain(x)
    return f"""list_transform([{t}], lambda p: CASE
        WHEN length(p) > 4 AND suffix(p, 'ies') THEN left(p, length(p) - 3) || 'y'
        WHEN length(p) > 4 AND regexp_matches(p, '([sxz]|[cs]h)es$') THEN left(p, length(p) - 2)
        WHEN length(p) > 3 AND suffix(p, 's') AND NOT regexp_matches(p, '(ss|us|is)$') THEN left(p, length(p) - 1)
        ELSE p END)[1]"""


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({x}, ''), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2 AND lower(w) NOT IN {STOP_LIST})"


def terms(x: str) -> str:
    return f"list_filter(list_transform({words(x)}, lambda w: {fold('w')}), lambda t: length(t) >= 2)"


def bm25(question: str, tokens: str, source: str, keep: str) -> str:
    """``keep`` columns and ``score`` of every row of ``source``, which has a ``tokens`` list; proximity bonus included."""
    asked = query_terms(question)
    inside = "(" + ", ".join(lit(t) for t in asked) + ")"
    df = ", ".join(f"sum(CASE WHEN list_contains(tokens, {lit(t)}) THEN 1 ELSE 0 END) AS df{i}" for i, t in enumerate(asked))
    norm = "(1 - 0.75 + 0.75 * len(tokens) / avgdl)"
    parts = " + ".join(
        f"CASE WHEN n < 3 THEN 1.0 ELSE ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) END * f{i} * 2.2 / (f{i} + 1.2 * {norm})" for i in range(len(asked))
    )
    counts = ", ".join(f"len(list_filter(tokens, lambda t: t = {lit(t)}))::DOUBLE AS f{i}" for i, t in enumerate(asked))
    bonus = f"1 + least(0.1, 0.1 * close / {max(1, len(asked) - 1)})" if len(asked) > 1 else "1"
    return f"""
        WITH src AS ({source}),
        st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl, {df} FROM src),
        hit AS (SELECT *, list_filter(list_transform(tokens, lambda t, i: {{'i': i, 't': t}}), lambda h: h.t IN {inside}) AS hits FROM src),
        near AS (SELECT *, len(list_filter(range(2, len(hits) + 1), lambda k: hits[k].t <> hits[k - 1].t AND hits[k].i - hits[k - 1].i <= 6)) AS close, {counts} FROM hit)
        SELECT {keep}, CASE WHEN len(tokens) = 0 THEN 0 ELSE ({parts}) * ({bonus}) END AS score FROM near, st
    """


def n_hits(question: str, x: str) -> str:
    m = build_matcher(question)
    each = []
    for k in m.keywords:
        own = " OR ".join(f"regexp_matches({x}, {lit('(?i)' + accent_pattern(t))})" for t, _ in k.variants)
        each.append(f"CASE WHEN {own} THEN 1 ELSE 0 END")
    return "(" + " + ".join(each) + ")"


def fnv_value(x: str) -> str:
    """The 64-bit FNV-1a of a text's code points, as HUGEINT."""
    return f"""list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::HUGEINT)),
        lambda h, c: (xor(h, c) * 1099511628211) % 18446744073709551616)"""


def fnv(x: str) -> str:
    return f"format('{{:016x}}', {fnv_value(x)})"


def simhash(source: str, key: str) -> str:
    """``key`` and ``h`` (HUGEINT) of every row of ``source``, which has the terms as list ``t``: three-term shingles, the majority of each bit."""
    shingles = "CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END"
    each = f"SELECT {key}, {fnv_value('x')}::UBIGINT AS u FROM (SELECT {key}, unnest({shingles}) AS x FROM {source})"
    bits = " + ".join(f"CASE WHEN 2 * sum((u >> {b}) & 1) > count(*) THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64))
    return f"SELECT {key}, coalesce(h, 0::HUGEINT) AS h FROM (SELECT {key} FROM {source}) LEFT JOIN (SELECT {key}, {bits} AS h FROM ({each}) GROUP BY {key}) USING ({key})"


#: White space as ``functions.text.SPACE`` has it.
SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def headed_lines(source: str, key: str) -> str:
    """``key, lines, i, line, heading``: every line of ``text`` with the markdown heading at or above it, fenced code aside."""
    found = rf"nullif(trim(regexp_extract(line, '^#{{1,6}}{SPACE}+(.+?){SPACE}*#*{SPACE}*$', 1)), '')"
    return rf"""
        SELECT {key}, lines, i, line, last_value(own IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY i) AS heading FROM (
            SELECT *, CASE WHEN fence = 0 AND fences % 2 = 0 THEN {found} END AS own FROM (
                SELECT *, sum(fence) OVER (PARTITION BY {key} ORDER BY i) AS fences FROM (
                    SELECT *, CASE WHEN regexp_matches(line, '^{SPACE}*(```|~~~)') THEN 1 ELSE 0 END AS fence FROM (
                        SELECT {key}, lines, unnest(range(len(lines)))::INT AS i, unnest(lines) AS line FROM (SELECT {key}, string_split(coalesce(text, ''), chr(10)) AS lines FROM {source})))))
    """
