"""Text rules as column expressions: output cleaning, validators, identifiers, Markdown clean-up.

Patterns keep to what both Java and the oracle's engine read alike where they can; `(?d)` makes only a line feed a
line end, and quantified groups are possessive so that texts of any length stay within the regex engine's stack.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .repeats import looked

#: Fixed values of the cleaning rules, in the order in which they apply.
BOILERPLATE = [
    ("（注：[^）]*+）", ""),
    ("\\(注：[^)]*+\\)", ""),
    ("【修正后的译文】[:：]?(?U)\\s*+", ""),
    ("\\[修正后的译文\\][:：]?(?U)\\s*+", ""),
    ("(?iU)^Here is the translation[:：]?\\s*+", ""),
    ("(?iU)^Translation[:：]?\\s*+", ""),
    ("(?U)^```markdown\\s*+", ""),
    ("(?dU)\\s*```$", ""),
]


def _clean(step: int, gram: int, longest: int, group: int) -> str:
    """Matches `step` characters among which no loop begins; `group` is the number of its own group.

    A phrase of p characters (5 to `longest`) said n times or more in a row covers n * p of them. If it began among the step characters, the last
    of these would lie in it, and the `gram` characters from there on would come again p later, as long as step - 1 + gram <= (n - 1) * 5. So one
    look per step tells, where the loop's own pattern would try every length at every character.
    """
    return f"(?s:.{{{step - 1}}})(?!(?=(.{{{gram}}})).{{5,{longest}}}?\\{group})(?s:.)"


LOOPS = [
    (f"(?d)((?:{_clean(25, 20, 50, 2)})++)|(.{{5,50}}?)\\3{{9,}}+", "$1$3"),
    ("([\\u4e00-\\u9fa5]{2,10})\\1{9,}+", "$1"),
    ("(?iuU)\\b(\\w{3,})\\s+(?:\\1\\s+){9,}+", "$1 "),
    ("([。，！？；：])\\1{3,}+", "$1$1$1"),
]


def _unlooped(said: int, gram: int, tiers: list[tuple[int, int, int]]) -> str:
    """Matches texts of which it is sure that no phrase is said `said` times or more in a row; others may or may not have one.

    tiers: (shortest phrase, longest, how many of the steps of the tier before make one of its own), from short phrases on. A loop of phrases of p
    characters has the `gram` characters from any place in it on again p later, until (said - 1) * p after its beginning, less the gram. So the longer
    the phrases of a tier, the wider its steps may be; what is left behind the last whole step of a tier is too short for its loops.
    """
    steps, group = [], 0
    for least, most, times in tiers:
        if not steps:
            steps.append(((said - 1) * least - gram, lambda n, least=least, most=most, size=(said - 1) * least - gram: f"(?s:.{{{size}}})(?!(?=(.{{{gram}}})).{{{least},{most}}}?\\{n()})"))
        else:
            size, inner = steps[-1]
            if times * size > (said - 1) * least - gram:
                raise ValueError("steps too wide for their phrases")
            steps.append((times * size, lambda n, least=least, most=most, times=times, inner=inner: "".join(inner(n) for _ in range(times)) + f"(?!(?=(.{{{gram}}})).{{{least},{most}}}?\\{n()})"))

    def number() -> int:
        nonlocal group
        group += 1
        return group

    return "(?d)\\A" + "".join(f"(?:{of(number)})*+(?=(?s:.{{0,{size - 1}}})\\z)" for size, of in reversed(steps))


#: Tell most texts without a loop of LOOPS[0], and without one of REPEATED, several times faster than these.
NO_LOOP, NO_REPEAT = _unlooped(10, 12, [(5, 9, 1), (10, 24, 2), (25, 50, 3)]), _unlooped(5, 7, [(5, 9, 1), (10, 19, 2), (20, 30, 2)])
#: White space up to U+00FF.
BLANK = "\\t-\\r \\u0085\\u00a0"


def _again(times: int) -> str:
    """Matches a word of three characters or more that is said `times` times more, between white space."""
    return f"[{BLANK}]([^{BLANK}]{{3,}}+)" + f"[{BLANK}]++(?iu:\\1)" * times + f"[{BLANK}]"


def _has(mark: str) -> Callable[[Column], Column]:
    return lambda t: F.contains(t, F.lit(mark))


#: What a text has where a rule's pattern matches, and is looked for faster than the pattern.
MAY: dict[str, Callable[[Column], Column]] = {
    BOILERPLATE[0][0]: _has("（注："),
    BOILERPLATE[1][0]: _has("(注："),
    BOILERPLATE[2][0]: _has("【修正后的译文】"),
    BOILERPLATE[3][0]: _has("[修正后的译文]"),
    BOILERPLATE[4][0]: lambda t: F.substring(t, 1, 23).rlike("(?iU)^Here is the translation"),
    BOILERPLATE[5][0]: lambda t: F.substring(t, 1, 11).rlike("(?iU)^Translation"),
    BOILERPLATE[6][0]: lambda t: F.startswith(t, F.lit("```markdown")),
    BOILERPLATE[7][0]: _has("```"),
    LOOPS[0][0]: lambda t: ~t.rlike(NO_LOOP),
    LOOPS[1][0]: lambda t: t.rlike("[\\u4e00-\\u9fa5]{20}"),
    # All words of a loop but its first stand between white space; the rarer kinds of it are left to the pattern. Most texts have no word twice in a row.
    LOOPS[2][0]: lambda t: t.rlike("[\\u1680-\\u3000]") | (t.rlike(_again(1)) & t.rlike(_again(4))),
    LOOPS[3][0]: lambda t: reduce(Column.__or__, (F.contains(t, F.lit(mark * 4)) for mark in "。，！？；：")),
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """White space of any script off both ends (trim knows the plain space only)."""
    blank = lambda c: c.rlike("(?U)\\s")
    left = let(text, lambda t: F.when(blank(F.substring(t, 1, 1)), F.regexp_replace(t, "(?U)^\\s++", "")).otherwise(t))
    return let(left, lambda t: F.when(blank(F.substring(t, -1, 1)), F.regexp_replace(t, "(?U)(?<!\\s)\\s++$", "")).otherwise(t))


def _ruled(text: Column, pattern: str, new: str) -> Column:
    return let(text, lambda t: F.when(MAY[pattern](t), F.regexp_replace(t, pattern, new)).otherwise(t))


def _chain(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, rule: _ruled(t, *rule), rules, text)


def collapse_loops(text: Column) -> Column:
    """Phrases said ten times or more in a row, once; runs of one punctuation mark, at most three."""
    return _chain(text, LOOPS)


def clean_output(text: Column) -> Column:
    """A model's answer without notes, introductions, fences and loops."""
    return strip(collapse_loops(_chain(text, BOILERPLATE)))


ISSUE = "struct<kind:string,severity:string,message:string>"


def issue(when: Column, kind: str, severity: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message")))


def untranslated_span(text: Column, words: int = 12) -> Column:
    """The first run of at least `words` Latin words; empty if there is none. Shorter runs and what is between runs are passed whole, so each character is met about once."""
    more = "\\s++[A-Za-z]++"
    shorter = f"|[A-Za-z]++(?:{more}){{0,{words - 2}}}+(?!{more})" if words > 1 else ""
    return F.regexp_extract(text, f"(?U)\\A(?:[^A-Za-z]++{shorter})*+([A-Za-z]++(?:{more}){{{words - 1},}}+)", 1)


def untranslated_issue(text: Column, words: int = 12) -> Column:
    return let(untranslated_span(text, words), lambda span: issue(span != "", "untranslated", "high", F.substring(span, 1, 80)))


#: Markdown counters: name, pattern, severity of a difference (fixed values); and what a text has where the pattern matches.
COUNTED = {"headings": "#", "images": "![", "links": "](", "fences": "```"}
COUNTERS = [("headings", "(?dm)^#{1,6}\\s+", "medium"), ("images", "!\\[[^\\]]*\\]\\([^)]+\\)", "high"), ("links", "\\[[^\\]]+\\]\\([^)]+\\)", "medium"), ("fences", "```", "high")]


def markdown_issues(original: Column, translation: Column) -> Column:
    """One issue for each counter that differs. Few texts have a mark that any counter needs."""
    found = []
    for name, pattern, severity in COUNTERS:
        a, b = (F.when(~F.contains(t, F.lit(COUNTED[name])), F.lit(0)).otherwise(F.regexp_count(t, F.lit(pattern))) for t in (original, translation))
        found.append(issue(a != b, "markdown", severity, F.concat(F.lit(f"{name}: "), a.cast("string"), F.lit(" -> "), b.cast("string"))))
    marked = reduce(Column.__or__, (F.contains(t, F.lit(mark)) for t in (original, translation) for mark in "#[`"))
    return F.when(marked, F.filter(F.array(*found), lambda i: i.isNotNull())).otherwise(F.array().cast(f"array<{ISSUE}>"))


#: A phrase said five times or more in a row: steps without one, and characters at which none begins, are passed by.
REPEATED = f"(?d)\\A(?:{_clean(10, 11, 30, 1)}|(?!(.{{5,30}}?)\\2{{4,}}+)(?s:.))*+(.{{5,30}}?)\\3{{4,}}+"


def repetition_issue(text: Column) -> Column:
    return issue(looked(text, 5, 5, 30) & ~text.rlike(NO_REPEAT) & text.rlike(REPEATED), "repetition", "low", F.lit("a phrase is repeated"))


def should_repair(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["kind"].isin("untranslated", "terminology", "markdown"))


def severity_score(issues: Column) -> Column:
    return F.aggregate(issues, F.lit(0), lambda a, i: a + F.when(i["severity"] == "high", 3).when(i["severity"] == "medium", 2).otherwise(1))


def is_better(candidate: Column, baseline: Column) -> Column:
    """Not worse; ties are accepted."""
    return severity_score(candidate) <= severity_score(baseline)


def section_title(path: Column) -> Column:
    return F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("Document Root"))


def breadcrumb(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(section_title(path))


def chunk_id(index: Column, path: Column, text: Column) -> Column:
    digest = F.sha1(F.concat_ws("|", index.cast("string"), F.array_join(path, " > "), text))
    return F.format_string("chunk-%04d-%s", index, F.substring(digest, 1, 12))


def context_text(path: Column, previous_title: Column, title: Column, previous_text: Column, window: int) -> Column:
    """Section, previous section (within a section only if another), and the end of the previous chunk (all of it for a window of 0)."""
    tail = F.when(F.lit(window) == 0, previous_text).otherwise(F.right(previous_text, F.lit(window)))
    return F.concat_ws(
        "\n\n",
        F.when(F.size(path) > 0, F.concat(F.lit("当前章节: "), F.array_join(path, " > "))),
        F.when((previous_title != "") & ((F.size(path) == 0) | (previous_title != title)), F.concat(F.lit("上一块章节: "), previous_title)),
        F.when(previous_text != "", F.concat(F.lit("上一块末尾:\n"), tail)),
    )


def profile_fingerprint(summary: Column, notes: Column, hints: Column, sections: Column) -> Column:
    text = [F.coalesce(summary, F.lit("")), *[F.coalesce(F.array_join(c, "\n"), F.lit("")) for c in (notes, hints, sections)]]
    return F.substring(F.sha1(F.concat_ws("|", *text)), 1, 12)


def cache_key(version: str, prompt: str, model: str, chunk: Column, profile: Column, glossary_pairs: Column) -> Column:
    """glossary_pairs: array<struct<term, rendering>> of the relevant terms, in any order."""
    lines = F.array_join(F.transform(F.array_sort(glossary_pairs), lambda p: F.concat(p["term"], F.lit(":"), p["rendering"])), "\n")
    return F.sha1(F.concat_ws("|", F.lit(version), F.lit(prompt), F.lit(model), chunk, profile, F.coalesce(lines, F.lit(""))))


def image_paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("!\\[[^\\]]*\\]\\(([^)]+)\\)"), F.lit(1))


def fix_image_paths(text: Column) -> Column:
    """Only what follows the last /images/ of an image's path stays."""
    return F.regexp_replace(text, "(!\\[[^\\]]*\\]\\()[^)]*/images/([^)]*\\))", "$1images/$2")


def unescape_brackets(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\["), F.lit("[")), F.lit("\\]"), F.lit("]"))
    return F.replace(out, F.lit("[ ]"), F.lit("[]"))


def normalize_whitespace(text: Column) -> Column:
    """List escapes undone, three or more line feeds to two, no blanks at line ends."""
    out = F.regexp_replace(text, "(?dm)^(\\s*\\d+)\\\\([.)])", "$1$2")
    return F.regexp_replace(F.regexp_replace(out, "\\n{3,}+", "\n\n"), "(?dm)(?<![ \\t])[ \\t]++$", "")


def quote_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")


def quote_nonblank(lines: Column) -> Column:
    return F.transform(lines, lambda line: F.when(F.trim(line) == "", line).otherwise(F.concat(F.lit("> "), line)))


def markdown_to_html(text: Column) -> Column:
    """Escapes, headers from h6 to h1, emphasis, images, links, inline code, paragraphs and line breaks."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for level in range(6, 0, -1):
        out = F.regexp_replace(out, f"(?dm)^{'#' * level} (.+)$", f"<h{level}>$1</h{level}>")
    for pattern, new in (("\\*\\*\\*(.+?)\\*\\*\\*", "<strong><em>$1</em></strong>"), ("\\*\\*(.+?)\\*\\*", "<strong>$1</strong>"), ("\\*(.+?)\\*", "<em>$1</em>"), ("!\\[\\]\\(((?:[^()]*/)?([^()/]+?)(?:\\.[^.()/]+)?)\\)", '<img src="$1" alt="$2">'), ("!\\[([^\\]]*)\\]\\(([^)]+)\\)", '<img src="$2" alt="$1">'), ("\\[([^\\]]+)\\]\\(([^)]+)\\)", '<a href="$2">$1</a>'), ("`([^`]+)`", "<code>$1</code>")):
        out = F.regexp_replace(out, pattern, new)
    parts = F.filter(F.transform(F.split(out, "\\n\\n"), lambda p: strip(p)), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<h"), p).otherwise(F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))), "\n")


def json_object(text: Column) -> Column:
    """The outermost {...} of an answer, or null."""
    return F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))


def score(text: Column, name: str) -> Column:
    """A dimension's score: 1 to 5, 3 where it is missing or no number; null where the answer has no object."""
    value = F.get_json_object(json_object(text), f"$.{name}").try_cast("double")
    value = F.when(F.isnan(value), None).otherwise(value)
    return F.when(json_object(text).isNotNull(), F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.coalesce(value, F.lit(3.0)))))


def rationale(text: Column) -> Column:
    return F.coalesce(F.get_json_object(json_object(text), "$.rationale"), F.lit(""))


def heading_paths(headings: Column) -> Column:
    """array<struct<level int, title string, ...>> in order -> array<array<string>>: the stack at each heading.

    A heading of level n replaces what the stack holds from its n-th place on, however deep those before it were.
    """
    step = lambda paths, h: F.concat(paths, F.array(F.concat(F.slice(F.coalesce(F.try_element_at(paths, F.lit(-1)), F.array().cast("array<string>")), F.lit(1), h["level"] - 1), F.array(h["title"]))))
    return F.aggregate(headings, F.array().cast("array<array<string>>"), step)
