"""Terms and matching, as Columns.

One definition of a term serves every scorer: split at everything but letters,
digits and underscores, drop one-letter words and stopwords, lower-case, remove
accents, fold plurals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.batched import per_value
from textmill.functions.lexicon import STOPWORDS, accent_table, class_of

NOT_WORD = r"[^\p{L}\p{N}_]+"
#: White space as regular expressions of the web have it, NBSP included.
SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"^{SPACE}+|{SPACE}+$", "")


def collapse_space(c: Column | str) -> Column:
    """White space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), rf"{SPACE}+", " "))


def is_stopword(c: Column | str, extra: Iterable[str] = ()) -> Column:
    return F.lower(_col(c)).isin(*STOPWORDS, *[w.lower() for w in extra])


def deaccent(c: Column | str) -> Column:
    source, target = accent_table()
    return F.translate(_col(c), source, target)


def fold_plural(c: Column | str) -> Column:
    t, n = _col(c), F.length(_col(c))
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 4) & t.rlike("([sxz]|[cs]h)es$"), cut(2))
        .when((n > 3) & t.endswith("s") & ~t.rlike("(ss|us|is)$"), cut(1))
        .otherwise(t)
    )


def fold_term(c: Column | str) -> Column:
    """Lower case, no accents, singular."""
    return fold_plural(deaccent(F.lower(_col(c))))


_WORD = re.compile(r"\w+")
_STOP = frozenset(STOPWORDS)
_FOLDED: dict[str, str] = {}
#: Many a word comes once only: what is remembered is a small part of a large vocabulary.
REMEMBERED_WORDS = 1 << 16


def _term(word: str) -> str:
    """The canonical term of a word, '' for a word that is none."""
    if len(word) < 2 or word.lower() in _STOP:
        return ""
    term = py_fold_term(word)
    return term if len(term) >= 2 else ""


def text_terms(text: str, extra: frozenset[str] = frozenset()) -> list[str]:
    """``terms`` of a plain text. A worker folds each distinct word once."""
    out = []
    for word in _WORD.findall(text):
        term = _FOLDED.get(word)
        if term is None:
            if len(_FOLDED) >= REMEMBERED_WORDS:
                _FOLDED.clear()
            term = _FOLDED[word] = _term(word)
        if term and not (extra and word.lower() in extra):
            out.append(term)
    return out


_terms_udf = per_value("array<string>", text_terms)


def terms(c: Column | str, extra_stopwords: Iterable[str] = ()) -> Column:
    """Canonical terms of a text, in order, with repetition. Null texts have none.

    In Arrow batches: a chain of array expressions takes every word through a
    list of stopwords and five patterns again, at several times the cost.
    """
    extra = frozenset(w.lower() for w in extra_stopwords)
    udf = per_value("array<string>", lambda text: text_terms(text, extra)) if extra else _terms_udf
    return udf(F.coalesce(_col(c), F.lit("")))


def keywords(c: Column | str, extra_stopwords: Iterable[str] = ()) -> Column:
    """Distinct content words in their first spelling, in order."""
    words = F.filter(F.split(F.coalesce(_col(c), F.lit("")), NOT_WORD), lambda w: (F.length(w) >= 2) & ~is_stopword(w, extra_stopwords))
    lowered = F.transform(words, F.lower)
    return F.filter(words, lambda w, i: F.array_position(lowered, F.lower(w)) == i + 1)


def keyword_weight(w: Column | str) -> Column:
    """How distinctive a keyword looks: digits, inner capitals, underscores, length."""
    w = _col(w)
    long_ = F.when(F.length(w) >= 8, F.lit(1.5)).when(F.length(w) >= 5, F.lit(0.5)).otherwise(F.lit(0.0))
    flag = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    return flag(w.rlike("[0-9]"), 3.0) + flag(w.rlike("[A-Z]") & ~w.rlike("^[A-Z0-9]+$"), 2.0) + flag(w.contains("_"), 2.0) + long_


def ranked_keywords(c: Column | str) -> Column:
    """``keywords``, most distinctive first; ties in order."""
    scored = F.transform(keywords(c), lambda w, i: F.struct((-keyword_weight(w)).alias("s"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(scored), lambda x: x["w"])


def subtokens(c: Column | str) -> Column:
    """Parts of a camelCase, snake_case or digit-joined identifier: distinct, of 3 letters or more, 4 at most."""
    spaced = _col(c)
    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    parts = F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda p: p != "")
    good = F.array_distinct(F.filter(F.transform(parts, F.lower), lambda p: (F.length(p) >= 3) & ~is_stopword(p)))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.slice(good, 1, 4))


def slugify(c: Column | str, max_length: int = 120, fallback: str = "") -> Column:
    s = F.lower(_col(c))
    for pattern, to in ((r"^https?://", ""), (r"^git@", ""), (r"\.git$", ""), (r"[^a-z0-9._-]+", "-"), (r"^-+|-+$", "")):
        s = F.regexp_replace(s, pattern, to)
    s = F.substring(s, 1, max_length)
    return F.when(s == "", F.lit(fallback)).otherwise(s)


# -- question side: one literal question, compiled on the driver --------------------------------


@cache
def _plain_letters() -> dict[int, int]:
    return str.maketrans(*accent_table())


def _py_lower_plain(s: str) -> str:
    return s if s.isascii() else s.translate(_plain_letters())


def py_fold_term(raw: str) -> str:
    """``fold_term`` of a literal."""
    t = _py_lower_plain(raw.lower())
    if not t.endswith(("s", "s\n")):  # ``$`` below also stands before a last line end
        return t
    if len(t) > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if len(t) > 4 and re.search("(?:[sxz]|[cs]h)es$", t):
        return t[:-2]
    if len(t) > 3 and t.endswith("s") and not re.search("(?:ss|us|is)$", t):
        return t[:-1]
    return t


def _words(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(NOT_WORD, text) if len(w) >= 2 and w.lower() not in STOPWORDS]


def query_terms(question: str) -> list[str]:
    """Distinct terms of a literal question."""
    folded = (py_fold_term(w) for w in _words(question))
    return list(dict.fromkeys(t for t in folded if len(t) >= 2))


def py_keywords(question: str) -> list[str]:
    seen: dict[str, str] = {}
    for w in _words(question):
        seen.setdefault(w.lower(), w)
    return list(seen.values())


def plain_text(text: str) -> str:
    """A text in lower case and without accents, the form in which spellings are compared."""
    return _py_lower_plain(text.lower())


def py_subtokens(raw: str) -> list[str]:
    import regex

    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        raw = regex.sub(pattern, r"\1 \2", raw)
    parts = [p for p in regex.split(r"[^\p{L}\p{N}]+", raw) if p]
    good = [p.lower() for p in parts if len(p) >= 3 and p.lower() not in STOPWORDS]
    return list(dict.fromkeys(good))[:4] if len(parts) > 1 else []


def accent_pattern(text: str) -> str:
    """A regular expression for the text in any accents; case is the matcher's business."""
    source, target = accent_table()
    base = str.maketrans(source, target)
    out = []
    for ch in text:
        letters = class_of().get(ch.translate(base))
        out.append(f"[{letters}]" if letters else re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", ch))
    return "".join(out)


@dataclass(frozen=True)
class Keyword:
    canonical: str
    original: str
    variants: tuple[tuple[str, str], ...]  # (text, kind)


@dataclass(frozen=True)
class Matcher:
    """What a question looks for: keywords, each with the spellings that count as it."""

    keywords: tuple[Keyword, ...]
    patterns: tuple[tuple[str, str], ...] = field(default=())  # (regular expression, canonical)

    @property
    def canonicals(self) -> list[str]:
        return [k.canonical for k in self.keywords]

    def hits(self, c: Column | str) -> Column:
        """Canonicals that occur in a text, in order."""
        text = _col(c)
        found = []
        for k in self.keywords:
            own = [p for p, canonical in self.patterns if canonical == k.canonical]
            seen = reduce(or_, [text.rlike(f"(?iu){p}") for p in own], F.lit(False))
            found.append(F.when(seen, F.lit(k.canonical)))
        none = F.array().cast("array<string>")
        if not self.patterns:
            return none
        # most texts have none: one look for any of them comes first
        some = text.rlike("(?iu)" + "|".join(f"(?:{p})" for p, _ in self.patterns))
        return F.when(some, F.filter(F.array(*found), lambda x: x.isNotNull())).otherwise(none)

    def n_hits(self, c: Column | str) -> Column:
        return F.coalesce(F.size(self.hits(c)), F.lit(0)) if self.keywords else F.lit(0)

    def coverage(self, c: Column | str) -> Column:
        """The share of the question's keywords that a text mentions. Null and empty texts: 0."""
        if not self.keywords:
            return F.lit(0.0)
        return self.n_hits(F.coalesce(_col(c), F.lit(""))) / F.lit(float(len(self.keywords)))

    def canonical_of(self, c: Column | str) -> Column:
        """The keyword whose spelling a whole span is, null if none."""
        return F.coalesce(*[F.when(_col(c).rlike(f"(?iu)^(?:{p})$"), F.lit(k)) for p, k in self.patterns], F.lit(None).cast("string"))


def expand(tokens: Sequence[str], limit: int = 8, max_patterns: int = 24) -> tuple[Keyword, ...]:
    """Keywords with their spellings: as written, folded, and parts of identifiers; spellings are kept in that priority."""
    found: dict[str, tuple[str, list[tuple[str, str]]]] = {}
    for raw in tokens:
        if len(found) >= limit:
            break
        canonical = py_fold_term(raw)
        if not canonical or canonical in found:
            continue
        plain = _py_lower_plain(raw.lower())
        forms = [(raw.lower(), "original")]
        if canonical != plain:
            forms.append((canonical, "folded"))
        if len(plain) > 4 and plain.endswith("ies"):
            forms.append((plain[:-1], "folded"))
        found[canonical] = (raw, forms + [(s, "subtoken") for s in py_subtokens(raw)])
    rank = {"original": 0, "folded": 1, "subtoken": 2}
    every = [(rank[kind], i, j, text) for i, (_, forms) in enumerate(found.values()) for j, (text, kind) in enumerate(forms)]
    kept, seen = set(), set()
    for _, i, j, text in sorted(every, key=lambda x: x[:2]):
        if len(kept) < max_patterns and _py_lower_plain(text) not in seen:
            seen.add(_py_lower_plain(text))
            kept.add((i, j))
    return tuple(
        Keyword(canonical, raw, tuple(f for j, f in enumerate(forms) if (i, j) in kept)) for i, (canonical, (raw, forms)) in enumerate(found.items())
    )


def matcher_of(tokens: Sequence[str], limit: int = 8) -> Matcher:
    """A matcher over raw tokens, with no stopword removal."""
    keys = expand([t for t in tokens if t], limit)
    return Matcher(keys, tuple((accent_pattern(text), k.canonical) for k in keys for text, _ in k.variants))


def build_matcher(question: str, limit: int = 8) -> Matcher:
    """A matcher for a literal question."""
    return matcher_of(py_keywords(question), limit)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


# -- lines and headings -------------------------------------------------------------------------


def line_rows(c: Column | str) -> Column:
    return F.split(_col(c), "\n")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: an expression named twice is worked out twice inside a function over arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nearest_headings(lines: Column) -> Column:
    """For each line the last markdown heading at or above it, fenced code aside; null if none.

    A fold over the lines with the fence state and the current heading.
    """
    start = F.struct(F.lit(False).alias("fence"), F.lit(None).cast("string").alias("now"), F.array().cast("array<struct<i:int,h:string>>").alias("all"))

    def told_of(line: Column, i: Column) -> Column:
        found = F.nullif(F.regexp_extract(line, rf"^#{{1,6}}{SPACE}+(.+?){SPACE}*#*{SPACE}*$", 1), F.lit(""))
        return F.struct(i.alias("i"), line.rlike(rf"^{SPACE}*(```|~~~)").alias("toggles"), F.trim(found).alias("found"))

    def step(acc, line):
        """Only lines that change something come here, so what is carried grows with the headings and not with the lines."""
        new = ~line["toggles"] & ~acc["fence"] & line["found"].isNotNull()
        return F.struct(
            (acc["fence"] != line["toggles"]).alias("fence"),
            F.when(new, line["found"]).otherwise(acc["now"]).alias("now"),
            F.when(new, F.concat(acc["all"], F.array(F.struct(line["i"].alias("i"), line["found"].alias("h"))))).otherwise(acc["all"]).alias("all"),
        )

    def spread(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, told_of), lambda x: x["toggles"] | x["found"].isNotNull())
        changes = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("h"))), F.aggregate(marked, start, step)["all"])
        until = lambda every, k: F.coalesce(F.get(every, k + 1)["i"], F.size(lines))
        return bound(changes, lambda every: F.flatten(F.transform(every, lambda c, k: F.array_repeat(c["h"], until(every, k) - c["i"]))))

    return F.when(lines.isNotNull(), bound(lines, spread))


def excerpt_windows(c: Column | str, questions: Sequence[str], per_doc: int = 2, before: int = 3, after: int = 12, max_chars: int = 1500) -> Column:
    """The passages of a text that answer one of the questions best.

    ``ARRAY<STRUCT<start, end, anchor, score, heading, snippet>>``: lines scored
    by their best coverage of a single question, widened, without overlaps; the
    top of the text at score 0 when nothing matches.
    """
    matchers = [build_matcher(q) for q in questions if q.strip()]
    score = lambda line: F.greatest(F.lit(0), F.lit(0), *[m.n_hits(line) for m in matchers])
    kind = "array<struct<start:int,end:int,anchor:int,score:int,heading:string,snippet:string>>"

    def windows(lines: Column, headings: Column, hits: Column) -> Column:
        nothing = F.array(F.struct(F.lit(0).alias("neg"), F.lit(0).alias("anchor")))
        ordered = F.array_sort(F.when(F.size(hits) > 0, hits).otherwise(nothing))

        def step(acc, h):
            lo = F.greatest(F.lit(0), h["anchor"] - before)
            hi = F.least(F.size(lines), h["anchor"] + after)
            snippet = F.substring(F.array_join(F.slice(lines, lo + 1, hi - lo), "\n"), 1, max_chars)
            clash = F.exists(acc, lambda w: (lo < w["end"]) & (hi > w["start"]))
            window = F.struct(
                lo.alias("start"), hi.alias("end"), h["anchor"].alias("anchor"), (-h["neg"]).alias("score"), F.get(headings, h["anchor"]).alias("heading"), snippet.alias("snippet")
            )
            full = F.size(acc) >= per_doc
            return F.when(full | clash | (trim_space(snippet) == ""), acc).otherwise(F.concat(acc, F.array(window)).cast(kind))

        return F.aggregate(ordered, F.array().cast(kind), step)

    def scored(lines: Column) -> Column:
        hits = F.filter(F.transform(lines, lambda line, i: F.struct((-score(line)).alias("neg"), i.alias("anchor"))), lambda h: h["neg"] < 0)
        return bound(hits, lambda hits: bound(nearest_headings(lines), lambda headings: windows(lines, headings, hits)))

    return bound(line_rows(F.coalesce(_col(c), F.lit(""))), scored)


# -- small formats ------------------------------------------------------------------------------


def shell_quote(c: Column | str) -> Column:
    """A POSIX single-quoted word; line ends become blanks."""
    flat = F.regexp_replace(_col(c), r"\r?\n", " ")
    return F.concat(F.lit("'"), F.replace(flat, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def run_id(ts: Column | str) -> Column:
    """``run-YYYYMMDD-HHMMSS`` in the session's time zone."""
    return F.date_format(_col(ts), "'run-'yyyyMMdd-HHmmss")


def regexp_escape(c: Column | str) -> Column:
    """The text as a regular expression for itself."""
    return F.regexp_replace(_col(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def documented_flags(c: Column | str) -> Column:
    """Distinct ``--flags`` that a help text names, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(r"(?<![\w-])(--[a-z][a-z0-9-]*)"), F.lit(1)))


def _mentions(help_text: Column, flag: Column) -> Column:
    """What follows each ``--flag`` of a help text, in order, be it the end of a longer name or not."""
    return F.slice(F.split(help_text, F.concat(F.lit("--"), regexp_escape(flag))), 2, 1 << 30)


def help_covers_flag(help_text: Column | str, flag: Column | str) -> Column:
    """Whether a help text names ``--flag`` as a whole, not as the head of a longer name."""
    return F.exists(_mentions(F.coalesce(_col(help_text), F.lit("")), _col(flag)), lambda rest: ~rest.rlike("^[a-z0-9-]"))


def missing_from_help(help_text: Column | str, flags: Column | str) -> Column:
    """Those of an array of flags that a help text never names, in order."""
    return F.filter(_col(flags), lambda f: ~help_covers_flag(help_text, f))


def piped_enum(line: Column | str, flag: Column | str) -> Column:
    """The values ``a | b | c`` that a line lists after ``--flag``, letters in between aside; null without such a list."""
    plain = F.replace(F.replace(_col(line), F.lit("`"), F.lit("")), F.lit("\\|"), F.lit("|"))
    lists = F.transform(_mentions(plain, _col(flag)), lambda rest: F.regexp_extract(rest, r"^[^a-z|]*([a-z][a-z0-9-]*(?:\s*\|\s*[a-z][a-z0-9-]*)+)", 1))
    found = F.get(F.filter(lists, lambda x: x != ""), F.lit(0))
    return F.transform(F.split(found, r"\|"), lambda v: F.trim(v))
