"""Text functions on columns. All of them are native expressions; patterns are Unicode-aware."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A question's number at the start of a line, marks, a number, a word, letters that may be words joined, how a question starts, what tells an exam, and a part of a question.
QUESTION_PREFIX = (
    r"(?iU)^\s*(?:(?:question|q)\s*)?(\d{1,3}(?:\s*[.(]\s*[a-zA-ZivxIVX]{1,6}\s*\))?|\d{1,3}(?:\s*[.(]\s*\d{1,3}\s*\))?|[a-zA-Z]\s*\))\s*(?:[.:)\-–—]\s*)?"
)
MARKS = r"(?iU)(?:\(\s*(\d{1,3})\s*(?:marks?|m)\s*\)|\[\s*(\d{1,3})\s*\]|(\d{1,3})\s*(?:marks?|m)\b)"
NUMBER = r"(?U)\b\d+(?:[.,]\d+)?\b"
WORD = r"(?U)[^\W_]+"
FUSED_WORD = r"[A-Za-z]{12,}"
QUESTION_START = r"(?i)^(?:\d{1,3}\s*[.)]|\(?[a-z]\)|\([ivxlcdm]+\))\s*"
EXAM_SIGNAL = r"(?i)(?:subject\s*code|full\s*marks|examination|answer\s+any|\b\d+\s*[.)]\s*\(?[a-z]\)?)"
SUBQUESTION = r"(?i)(?:^|\s)\([a-z]\)\s"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case, with ß as ss."""
    return F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss"))


def clean(c: Column | str) -> Column:
    """White space collapsed to single blanks, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def question_number(c: Column | str) -> Column:
    """The number that a cleaned line starts with, or null (20 characters at most)."""
    found = clean(F.regexp_extract(_col(c), QUESTION_PREFIX, 1))
    return F.when((found != "") & (F.length(found) <= 20), found)


def after_number(c: Column | str) -> Column:
    """What follows the number of a cleaned line."""
    c = _col(c)
    return F.trim(F.substring(c, F.length(F.regexp_extract(c, QUESTION_PREFIX, 0)) + 1, F.length(c)))


def marks(c: Column | str) -> Column:
    """Explicit marks, 1 to 100, of the first place that names any."""
    c = _col(c)
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, MARKS, g), F.lit("")) for g in (1, 2, 3)]).cast("int")
    return F.when(found.between(1, 100), found)


def slug(c: Column | str) -> Column:
    """A question's id from its number."""
    return F.concat(F.lit("q-"), F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def normalise_question(c: Column | str) -> Column:
    """Folded words without punctuation, joined by blanks."""
    return F.array_join(F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0)), " ")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once; inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(c: Column | str, width: int = 3) -> Column:
    """Distinct runs of ``width`` normalised words; a shorter text is one run."""
    none = F.array().cast("array<string>")

    def runs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(width)), " "))
        return F.when(F.size(words) == 0, none).otherwise(F.array_distinct(each))

    return bound(F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0)), runs)


def words(c: Column | str) -> Column:
    """Folded words without punctuation."""
    return F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0))


def shingle_hashes(normal_words: Column, width: int = 3) -> Column:
    """Distinct 64-bit hashes of the runs of ``width`` words of an array of words; fewer words are one run, none are none."""
    run = lambda i: F.xxhash64(*[F.get(normal_words, i + j) for j in range(width)])
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(normal_words) - width, F.lit(0))), run)
    return F.when(F.size(normal_words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(each))


def numbers(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(NUMBER), F.lit(0))


def tokens(c: Column | str, pattern: str = r"(?U)\w+") -> Column:
    return F.regexp_extract_all(fold(c), F.lit(pattern), F.lit(0))


def character_error_rate(expected: Column | str, actual: Column | str) -> Column:
    """Edits by expected characters, six places; null where nothing is expected."""
    e, a = _col(expected), F.coalesce(_col(actual), F.lit(""))
    return F.when(F.length(e) > 0, F.round(F.levenshtein(e, a) / F.length(e), 6))


#: Words of a pair up to which each distinct one becomes a character; longer pairs go to ``edits``.
FEW_WORDS = 2000


def edits(one: Sequence, other: Sequence) -> int:
    """Fewest insertions, deletions and exchanges between two sequences: a column of the table of distances is the bits of two whole numbers (one that rises, one that falls), so that a step takes all its rows at once."""
    start = 0
    while start < min(len(one), len(other)) and one[start] == other[start]:
        start += 1
    end = 0
    while end < min(len(one), len(other)) - start and one[-1 - end] == other[-1 - end]:
        end += 1
    one, other = one[start : len(one) - end], other[start : len(other) - end]
    if not one or not other:
        return len(one) + len(other)
    places: dict = {}
    for i, item in enumerate(one):
        places[item] = places.get(item, 0) | 1 << i
    every, last = (1 << len(one)) - 1, 1 << len(one) - 1
    rises, falls, distance = every, 0, len(one)
    for item in other:
        same = places.get(item, 0) | falls
        level = ((rises + (same & rises)) ^ rises) | same
        up, down = falls | (every & ~(rises | level)), rises & level
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        falls, rises = up & level, down | (every & ~(up | level))
    return distance


@F.pandas_udf(T.LongType())
def _word_edits(e: pd.Series, a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else edits(x.split(), (y or "").split()) for x, y in zip(e, a, strict=True)], dtype="Int64")


def word_error_rate(expected: Column | str, actual: Column | str) -> Column:
    """Word edits by expected words, six places, of texts of any length; null where nothing is expected.

    Up to ``FEW_WORDS`` words each distinct word of the pair becomes one
    character and Spark counts the edits; the words of longer pairs alone go to
    Python, in Arrow batches.
    """
    listed = lambda c: F.filter(F.split(clean(c), " "), lambda w: w != "")
    e, a = listed(expected), listed(actual)
    few = F.size(e) + F.size(a) <= FEW_WORDS

    def distance(pair: Column) -> Column:
        def coded(words: Column, known: Column) -> Column:
            return F.concat_ws("", F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0x4E00), 4, "0")), "UTF-16BE")))

        return bound(F.array_distinct(F.concat(pair["e"], pair["a"])), lambda known: F.levenshtein(coded(pair["e"], known), coded(pair["a"], known)))

    native = F.when(few, bound(F.struct(e.alias("e"), a.alias("a")), distance))
    long = _word_edits(F.when(~few, clean(expected)), F.when(~few, clean(actual)))
    return F.when(F.size(e) > 0, F.round(F.coalesce(native, long) / F.size(e), 6))


def positional_accuracy(expected: Column, actual: Column) -> Column:
    """Share of the expected items that stand at their place."""
    same = F.zip_with(expected, F.slice(actual, 1, F.greatest(F.size(expected), F.lit(1))), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.size(expected) > 0, F.round(F.size(F.filter(F.slice(same, F.lit(1), F.size(expected)), lambda s: s)) / F.size(expected), 6))


def handling_accuracy(expected: Column, actual: Column) -> Column:
    """How many of the expected features were found; none expected: whether none was found."""
    return F.when(expected == 0, F.when(actual == 0, 1.0).otherwise(0.0)).when(expected > 0, F.round(F.least(expected, actual) / expected, 6))


def removal_terms(c: Column | str) -> Column:
    """Distinct terms of a list separated by commas, semicolons or line ends; of two that differ in case the first stays."""
    parts = F.filter(F.transform(F.split(_col(c), r"[,;\n]"), clean), lambda t: t != "")
    first = lambda both: F.filter(both["parts"], lambda t, i: F.array_position(both["folded"], fold(t)) == i + 1)
    return bound(F.struct(parts.alias("parts"), F.transform(parts, fold).alias("folded")), first)


def _term(terms: Sequence[str]) -> str:
    quoted = "|".join(r"\Q" + t.replace(r"\E", "") + r"\E" for t in sorted(terms, key=lambda t: (-len(t), t)))
    return rf"(?iuU)(?<!\w)(?:{quoted})(?!\w)"


def count_terms(c: Column | str, terms: Sequence[str]) -> Column:
    return F.regexp_count(_col(c), F.lit(_term(terms)))


def remove_terms(c: Column | str, terms: Sequence[str]) -> Column:
    """Literal terms on word edges, in any case, removed; the blanks they leave are tidied line by line."""
    bare = F.regexp_replace(_col(c), _term(terms), "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r"(?m)[ \t]+([,.;:!?])", "$1"), r"(?m)^[ \t]+|[ \t]+$", "")


def without_terms(c: Column | str, terms: Sequence[str]) -> Column:
    """Literal terms on word edges, in any case, cut out; nothing else changes."""
    return F.regexp_replace(_col(c), _term(terms), "")


#: Marks before which, and brackets after which, no blank stands; a line of which nothing is left but a list sign and marks.
MARKS_AFTER, BRACKETS_BEFORE = ",.;:!?", "([{"
BARE_LINE = r"^\s*(?:#{1,6}|>|[-*+]|\d+[.)])?\s*[.,;:!?-]*\s*$"


def tidy_line(c: Column | str) -> Column:
    """A line after words were cut out: blanks and marks closed up, and empty if no more than a list sign and marks are left.

    The line is taken as words and the blanks between them. Blanks go where the
    word before opens a bracket or the word after begins with a mark; of several
    one stays.
    """
    lead = F.regexp_extract(_col(c), r"^[ \t]*", 0)
    body = F.substring(_col(c), F.length(lead) + 1, F.length(_col(c)))

    def closed_up(line: Column) -> Column:
        words, blanks = line["words"], line["blanks"]
        begins = lambda w: (w != "") & F.contains(F.lit(MARKS_AFTER), F.left(w, F.lit(1)))
        opens = lambda w: (w != "") & F.contains(F.lit(BRACKETS_BEFORE), F.right(w, F.lit(1)))

        def after(word: Column, i: Column) -> Column:
            blank, following = F.coalesce(F.get(blanks, i), F.lit("")), F.coalesce(F.get(words, i + 1), F.lit(""))
            return F.concat(word, F.when(opens(word) | begins(following), "").when(F.length(blank) > 1, " ").otherwise(blank))

        return F.array_join(F.transform(words, after), "")

    parted = F.struct(F.split(body, r"[ \t]+", -1).alias("words"), F.regexp_extract_all(body, F.lit(r"[ \t]+"), F.lit(0)).alias("blanks"))
    whole = F.rtrim(F.concat(lead, bound(parted, closed_up)))
    return F.when(whole.rlike(BARE_LINE), F.lit("")).otherwise(whole)


def escape_markdown(c: Column | str) -> Column:
    """Text that Markdown shows as it is: HTML signs and Markdown marks as entities."""
    c = _col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\\", "&#92;"), ("`", "&#96;"), ("*", "&#42;"), ("_", "&#95;"), ("[", "&#91;"), ("]", "&#93;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def composed(c: Column | str) -> Column:
    """Text in Unicode's composed form (NFC); only texts with characters beyond ASCII go through Python."""

    @F.pandas_udf(T.StringType())
    def nfc(x: pd.Series) -> pd.Series:
        return x.str.normalize("NFC")

    c = _col(c)
    return F.when(c.rlike(r"[^\x00-\x7F]"), nfc(c)).otherwise(c)


#: Names that file systems keep to themselves, signs that they refuse, and the greatest length of a stem.
RESERVED_NAMES = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
REFUSED_SIGNS = r'[<>:"/\\|?*\x00-\x1F]|\.\.'
MOST_STEM = 120


def safe_stem(c: Column | str, fallback: str = "document", most: int = MOST_STEM) -> Column:
    """A file name's stem: the last part of its path in composed characters, without its ending or what file systems refuse, no reserved name, bounded."""

    def trimmed(x: Column) -> Column:
        return F.btrim(x, F.lit(" ."))

    def named(leaf: Column) -> Column:
        dot = F.length(leaf) - F.instr(F.reverse(leaf), ".")  # characters before the last dot
        bare = F.when((F.instr(leaf, ".") > 0) & (dot > 0) & (dot < F.length(leaf) - 1), F.substring(leaf, F.lit(1), dot)).otherwise(leaf)
        plain = trimmed(F.regexp_replace(F.regexp_replace(bare, REFUSED_SIGNS, "_"), r"(?U)\s+", " "))
        own = F.when(plain.rlike(RESERVED_NAMES), F.concat(F.lit("_"), plain)).otherwise(plain)
        cut = F.rtrim(F.regexp_replace(F.substring(own, 1, most), r"[ .]+$", ""))
        return F.when(cut == "", F.lit(fallback)).otherwise(cut)

    return bound(composed(F.element_at(F.split(_col(c), r"[/\\]"), -1)), named)


#: Specks around a whole number in a table's cell, all cut out.
NUMBER_SPECKS = (r"^[.。·](?=\d{3,}$)", r"(?<=\d{3})[.。·]$", r"(?<=\d)\s+[。·]$")


def tidy_table_number(c: Column | str) -> Column:
    """A cell without the specks around a whole number."""
    c = clean(c)
    for speck in NUMBER_SPECKS:
        c = F.regexp_replace(c, speck, "")
    return c


#: What punctuation is tidied, and what takes its place.
PUNCTUATION = ((r"[ \t]+([,;:!?])", "$1"), (r"([,;:!?])(?=[A-Za-z])", "$1 "), (r"(?<=[a-z])\.(?=[A-Z])", ". "), (r"([,;:])\1+", "$1"), (r"[ \t]{2,}", " "))


def tidy_punctuation(c: Column | str) -> Column:
    """No blank before a mark, one after it, marks not doubled, blanks not doubled."""
    c = _col(c)
    for found, instead in PUNCTUATION:
        c = F.regexp_replace(c, found, instead)
    return c


def grammar_hints(c: Column | str) -> Column:
    """Array of original and suggestion: a slip after ``short``, and a word said twice."""
    c = _col(c)
    pair = lambda original, new: F.struct(original.alias("original"), new.alias("suggested"))
    slip = F.when(c.rlike(r"(?i)\bshort not on\b"), pair(F.regexp_extract(c, r"(?i)\bshort not on\b", 0), F.lit("short note on")))
    twice = r"(?i)\b([A-Za-z]+)\s+\1\b"
    again = F.when(c.rlike(twice), pair(F.regexp_extract(c, twice, 0), F.regexp_extract(c, twice, 1)))
    return F.array_compact(F.array(slip, again))


#: What is cut out of HTML.
HTML_REMOVED = (r"(?is)<(script|style)\b.*?</\1\s*>", r"(?is)<img\b[^>]*>", r"""(?is)\s+on\w+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")


def sanitise_html(c: Column | str) -> Column:
    """A fragment without scripts, styles, images and event attributes."""
    c = _col(c)
    for pattern in HTML_REMOVED:
        c = F.regexp_replace(c, pattern, "")
    return c


#: Commands that a formula must not hold, in any case.
UNSAFE_COMMANDS = (
    "class", "clearpage", "def", "documentclass", "href", "htmlclass", "htmlid", "htmlstyle", "id", "include", "includegraphics", "input",
    "newcommand", "newpage", "openout", "pagebreak", "read", "renewcommand", "require", "style", "url", "usepackage", "write",
)


#: Environments that a formula may use.
MATH_ENVIRONMENTS = ("aligned", "alignedat", "array", "matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "cases", "gathered", "split")
#: Pairs of delimiters around a formula.
DELIMITERS = (r"(?s)^\$\$(.*)\$\$$", r"(?s)^\\\[(.*)\\\]$", r"(?s)^\\\((.*)\\\)$", r"(?s)^\$(.*)\$$")


def strip_formula(c: Column | str) -> Column:
    """A formula without its delimiters, however many are nested: no more than stand at its start."""
    c = F.btrim(F.regexp_replace(_col(c), r"\r\n?", "\n"), F.lit(" \t\n\x0b\x0c"))
    first = F.regexp_extract(c, r"^(?:\s|\$|\\\[|\\\()*", 0)
    layers = F.filter(F.sequence(F.lit(0), F.regexp_count(first, F.lit(r"\$|\\\[|\\\("))), lambda i: i > 0)

    def peel(formula: Column, _: Column) -> Column:
        for pattern in DELIMITERS:
            formula = F.btrim(F.regexp_replace(formula, pattern, "$1"), F.lit(" \t\n\x0b\x0c"))
        return formula

    return F.aggregate(layers, c, peel)


def formula_verdict(c: Column | str, commands: Sequence[str] | None = None, environments: Sequence[str] | None = None) -> Column:
    """Why a bare formula is refused, or null: empty, control_character, math_delimiter, brackets, environments, unsupported_environment, unsafe_command, unsupported_command, line_break, alignment, comment, incomplete_script.

    One pass cuts the formula into tokens: an environment's begin or end, a
    command, an escaped sign, or a sign of its own. A fold over them keeps what is
    open; all other rules ask which tokens there are. ``commands`` and
    ``environments`` (such as ``MATH_ENVIRONMENTS``) name all that is allowed; without them only the unsafe are refused.
    """
    c = _col(c)
    tokens = F.regexp_extract_all(c, F.lit(r"\\(?:begin|end)\s*\{[^{}]*\}|\\[A-Za-z]+|\\[\s\S]|[{}()\[\]$&%#]"), F.lit(0))
    none = F.array().cast("array<string>")

    def verdict(all_tokens: Column) -> Column:
        inside = lambda t: F.trim(F.regexp_extract(t, r"\{([^{}]*)\}", 1))
        begins, ends = (lambda t: t.rlike(r"^\\begin\s*\{")), (lambda t: t.rlike(r"^\\end\s*\{"))
        names = F.transform(F.filter(all_tokens, lambda t: t.rlike(r"^\\[A-Za-z]+$")), lambda t: F.substring(t, F.lit(2), F.length(t)))
        framed = F.filter(all_tokens, lambda t: begins(t) | ends(t))
        has = lambda *signs: F.exists(all_tokens, lambda t: t.isin(*signs))

        def nest(opened: Column, t: Column) -> Column:
            """The stack after a token; what closes nothing stays on it."""
            top = F.try_element_at(opened, F.lit(-1))
            closes = ((t == "}") & (top == "{")) | ((t == "]") & (top == "[")) | ((t == ")") & (top == "("))
            return F.when(F.coalesce(closes, F.lit(False)), F.slice(opened, F.lit(1), F.size(opened) - 1)).otherwise(F.concat(opened, F.array(t)))

        def frame(opened: Column, t: Column) -> Column:
            top = F.try_element_at(opened, F.lit(-1))
            closes = ends(t) & F.coalesce(top == inside(t), F.lit(False))
            return F.when(begins(t), F.concat(opened, F.array(inside(t)))).when(closes, F.slice(opened, F.lit(1), F.size(opened) - 1)).otherwise(F.concat(opened, F.array(F.lit("?"))))

        open_signs = F.aggregate(F.filter(all_tokens, lambda t: t.rlike(r"^[{}()\[\]]$")), none, nest)
        open_frames = F.aggregate(framed, none, frame)
        strange = lambda items, known: F.exists(items, lambda n: ~n.isin(*known)) if known is not None else F.lit(False)
        return (
            F.when(F.coalesce(F.trim(c), F.lit("")) == "", "empty").when(c.rlike(r"[\x00-\x08\x0B-\x1F]"), "control_character").when(has("$", r"\(", r"\)", r"\[", r"\]"), "math_delimiter")
            .when(F.size(open_signs) > 0, "brackets").when(strange(F.transform(framed, inside), environments), "unsupported_environment").when(F.size(open_frames) > 0, "environments")
            .when(F.exists(names, lambda n: F.lower(n).isin(*UNSAFE_COMMANDS)), "unsafe_command").when(strange(names, commands), "unsupported_command")
            .when((F.size(framed) == 0) & has("\\\\"), "line_break").when((F.size(framed) == 0) & has("&"), "alignment").when(has("%", "#"), "comment").when(c.rlike(r"(?<!\\)[_^]\s*$"), "incomplete_script")
        )

    return bound(tokens, verdict)


def safe_csv_cell(c: Column | str) -> Column:
    """A cell that a spreadsheet would read as a formula gets a quote before it."""
    c = _col(c)
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def search_text(*candidates: Column | str, most: int = 100_000) -> Column:
    """The first candidate that is not blank, cut to a bound."""
    return F.substring(F.coalesce(*[F.nullif(F.trim(_col(c)), F.lit("")) for c in candidates], F.lit("")), 1, most)


#: What a log line shows in place of its message, and in place of itself where it has no known form.
WITHHELD_MESSAGE, WITHHELD_LINE = "<message redacted>", "<non-structured log line redacted>"


def redact_log(c: Column | str) -> Column:
    """A log line's time, level and logger; its message goes."""
    c = _col(c)
    head = F.regexp_extract(c, r"^\d{4}-\d{2}-\d{2}[^ ]* [^ ]+\s+(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+[^ ]+", 0)
    return F.when(head != "", F.concat_ws(" ", F.regexp_replace(head, r"\s+", " "), F.lit(WITHHELD_MESSAGE))).otherwise(F.lit(WITHHELD_LINE))


def first_words(c: Column | str, most: int = 50) -> Column:
    return F.array_join(F.slice(F.split(clean(c), " "), 1, most), " ")


#: How sure a draft is, by the figure's kind, and its sentences, %s for what is known.
DRAFT_CONFIDENCE = {"decorative": 0.95, "chart": 0.62, "table": 0.68, "equation": 0.55}
OTHER_CONFIDENCE = 0.5
SENTENCES = {
    "chart": "A %s.", "axes": "Axes or measures: %s.", "trend": "Reported pattern: %s.", "seen": "Visible text includes: %s.", "table": "A table.", "sized table": "A table with %s rows and %s columns.",
    "equation": "An equation: %s.", "near": "It appears near content about: %s.", "diagram": "A diagram.", "figure": "A figure.", "no text": "no reliable OCR text", "no formula": "the mathematical expression needs specialist review",
}


def alternative_text(kind: Column | str, visible: Column | str, context: Column | str, data: Column | str) -> Column:
    """A draft description (text, confidence) of a figure by kind, from what is read on and around it and its structured data (a map of strings)."""
    kind, data = _col(kind), _col(data)
    known = lambda c: F.nullif(F.trim(c), F.lit(""))
    given = lambda f: known(F.try_element_at(data, F.lit(f)))
    seen, near = known(first_words(visible)), known(first_words(context, 25))

    def say(name: str, *what: Column) -> Column:
        """The sentence, or null where something that it tells is not known."""
        there = F.lit(True)
        for w in what:
            there = there & w.isNotNull()
        return F.when(there, F.format_string(SENTENCES[name], *what)) if what else F.lit(SENTENCES[name])

    text = lambda *sentences: F.concat_ws(" ", *sentences)
    drafts = {
        "decorative": F.lit(""),
        "chart": text(say("chart", F.coalesce(given("chart_type"), F.lit("chart"))), say("axes", given("axes")), say("trend", given("trend")), say("seen", seen)),
        "table": text(F.coalesce(say("sized table", given("rows"), given("columns")), say("table")), say("seen", F.coalesce(seen, F.lit(SENTENCES["no text"])))),
        "equation": say("equation", F.coalesce(seen, F.lit(SENTENCES["no formula"]))),
    }
    draft = text(F.when(kind == "diagram", say("diagram")).otherwise(say("figure")), say("seen", seen), say("near", near))
    sure = F.lit(OTHER_CONFIDENCE)
    for name, own in drafts.items():
        draft, sure = F.when(kind == name, own).otherwise(draft), F.when(kind == name, DRAFT_CONFIDENCE[name]).otherwise(sure)
    return F.struct(draft.alias("text"), sure.alias("confidence"))
