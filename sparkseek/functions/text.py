"""Column expressions over text: tokens, keywords, snippets and path mining."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .paths import contains_any


# Every character that counts as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def find_all(text, pattern: str, group: int = 0) -> Column:
    """All matches in order. Word classes and word bounds cover every script, not only ASCII."""
    return F.regexp_extract_all(_col(text), F.lit("(?U)" + pattern), F.lit(group))


def strip(text) -> Column:
    """Trim white space of every kind from both ends."""
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def is_blank(text) -> Column:
    return strip(text) == ""


def code_tokens(text) -> Column:
    """Lower-cased identifier-like tokens in order of appearance, repeats included."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(fv.TOKEN_PATTERN), F.lit(0))


def split_lines(text) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    t = F.regexp_replace(_col(text), r"\r\n?", "\n")
    return F.split(F.regexp_replace(t, r"\n\z", ""), "\n")


def first_wins_casefold(words: Column) -> Column:
    """Distinct words ignoring case; the first spelling stays."""
    return F.filter(
        words,
        lambda w, i: F.array_position(F.transform(words, lambda x: F.lower(x)), F.lower(w)) == (i + 1),
    )


def code_keywords(query) -> Column:
    """Search words of a query, strongest first: identifiers, domain words, then a few plain words."""
    q = _col(query)
    strong = F.concat(
        find_all(q, fv.CONST_ID_PATTERN),
        find_all(q, fv.INTERFACE_ID_PATTERN),
        find_all(q, fv.TYPE_ID_PATTERN),
        find_all(q, fv.DOTTED_ID_PATTERN),
        F.transform(find_all(q, fv.FRAME_PATTERN, 1), lambda f: F.regexp_replace(f, r"\.[^.]*$", "")),
    )
    words = find_all(q, fv.WORD_PATTERN)
    domain = F.filter(
        words, lambda w: F.exists(F.array(*[F.lit(p) for p in fv.KEYWORD_DOMAIN_PARTS]), lambda p: F.contains(F.lower(w), p))
    )
    plain = F.filter(words, lambda w: ~F.lower(w).isin(*fv.KEYWORD_STOP_WORDS))
    few = F.when((F.size(strong) == 0) & (F.size(domain) == 0), F.slice(plain, 1, 10)).otherwise(F.slice(plain, 1, 4))
    return F.filter(F.array_distinct(F.concat(strong, domain, few)), lambda w: w != "")


def mentions_legacy(query) -> Column:
    return contains_any(F.lower(_col(query)), fv.LEGACY_QUERY_WORDS)


def snippet(content, chars: int) -> Column:
    return F.translate(F.substring(F.coalesce(_col(content), F.lit("")), 1, chars), "\n", " ")


def cut(text, chars: int | None, marker: str = "") -> Column:
    """The first `chars` characters, with a marker when something was left out; the whole text without a number."""
    t = _col(text)
    if chars is None:
        return t
    return F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit(marker))).otherwise(t)


def mined_paths(text) -> Column:
    """Distinct relative paths standing after white space, in order of first appearance."""
    return F.array_distinct(find_all(text, fv.PATH_TOKEN_PATTERN, 1))


def ranked_paths(answer) -> Column:
    """Paths of a numbered list; without one, every distinct path in the text."""
    numbered = F.filter(
        F.transform(split_lines(answer), lambda l: F.regexp_extract(l, r"(?U)^\s*\d+\.\s+([^\s\[]+)", 1)),
        lambda p: F.contains(p, F.lit("/")),
    )
    return F.when(F.size(numbered) > 0, numbered).otherwise(F.array_distinct(find_all(answer, fv.ANY_PATH_PATTERN, 1)))


def diff_targets(text) -> Column:
    return find_all(text, fv.DIFF_TARGET_PATTERN, 1)


def added_lines(patch) -> Column:
    """Text of the added lines of a diff."""
    lines = F.filter(split_lines(patch), lambda l: l.startswith("+") & ~l.startswith("+++"))
    return F.array_join(F.transform(lines, lambda l: F.substring(l, 2, 2**31 - 1)), "\n")


def first_diff(answer) -> Column:
    """The unified diff inside an answer; the whole answer when only hunk marks are found."""
    a = _col(answer)
    pattern = r"(?s)(--- [ab]?/?\S+.*?)(?:\n```|\z)"
    found = strip(F.regexp_extract(a, pattern, 1))
    return F.when(a.rlike(pattern), found).when(F.contains(a, F.lit("@@")), a).otherwise(F.lit(""))


def section(text, *needles: str) -> Column:
    """Body of the first `## ` section whose header holds one of the needles, ignoring case."""
    is_header = lambda l: F.ltrim(l).startswith("## ")
    wanted = lambda l: is_header(l) & F.exists(
        F.array(*[F.lit(n.lower()) for n in needles]), lambda n: F.contains(F.lower(l), n)
    )
    lines = split_lines(text)
    start = F.array_position(F.transform(lines, wanted), True)
    rest = F.slice(lines, start + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, is_header), True)
    body = F.when(stop > 0, F.slice(rest, F.lit(1), (stop - 1).cast("int"))).otherwise(rest)
    return F.when(start > 0, F.array_join(body, "\n")).otherwise(F.lit(""))


def relocation_hints(notes_text, rejected_file=None) -> Column:
    """Type and path names mentioned in objections, without the rejected file's own name."""
    t = _col(notes_text)
    hints = first_wins_casefold(F.concat(find_all(t, fv.HINT_TYPE_PATTERN), find_all(t, fv.HINT_PATH_PATTERN)))
    if rejected_file is None:
        return hints
    name = F.element_at(F.split(F.coalesce(_col(rejected_file), F.lit("")), "/"), -1)
    own = F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.filter(hints, lambda h: (own == "") | ~F.contains(F.lower(h), own))


def framed_task(report, log) -> Column:
    """The task text handed to a reasoning backend."""
    return F.format_string(
        "Full-stack bug.\n\nBug report:\n%s\n\nLogcat (optional):\n%s\n\nTasks:\n"
        "1) Gather evidence (customer paths first, then services, interfaces, hardware layer, signals, UI).\n"
        "2) Rank candidate files by layer.\n3) State a root-cause hypothesis.\n"
        "4) If confident, propose minimal unified diffs.\n",
        F.coalesce(_col(report), F.lit("")),
        F.coalesce(_col(log), F.lit("")),
    )
