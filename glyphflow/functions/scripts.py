"""Script transforms as column expressions: text in, text out, inside whole-stage code generation."""

from __future__ import annotations

import unicodedata

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphflow import tables as t

LETTER = r"[\p{L}\p{N}_:]"
#: Letters whose capital is several letters, and the one letter that stands for it: the title letter, a sharp s, or the letter itself.
LONG_CAPITALS = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0xFB18)) if len(c.upper()) > 1}


def replaced(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for a, b in pairs:
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a column named several times inside a lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_line(col: Column, f) -> Column:
    """``f`` applied to each line."""
    return F.array_join(F.transform(F.split(col, "\n", -1), f), "\n")


def detect_script(col: Column) -> Column:
    """todo, cyrillic, translit or unknown, by any letter of the script, in this order."""
    return (
        F.when(col.rlike("[᠀-᢯]"), "todo").when(col.rlike(f"[{t.CYRILLIC}]"), "cyrillic").when(col.rlike(f"[{t.LATIN}]"), "translit").otherwise("unknown")
    )


def check_input(col: Column, limit: int = 10_000) -> Column:
    """Reason to turn a text down: empty, too_long, or null."""
    n = F.char_length(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(col.isNull() | (n == 0), "empty").when(n > limit, "too_long")


def dashes(col: Column) -> Column:
    """Dashes, and hyphens between spaces, become vertical dashes between single spaces."""
    return F.regexp_replace(col, rf"[ \t]*(?:[{t.DASHES}]|(?<=\s)-(?=\s))[ \t]*", f" {t.VERTICAL_DASH} ")


#: Letters of the tables that may come as a letter and its marks, the longest first.
COMPOSED = sorted(((unicodedata.normalize("NFD", c), c) for c in {c for a, _ in t.LATIN_TO_ASCII for c in a} if unicodedata.normalize("NFD", c) != c), key=lambda x: (-len(x[0]), x))


def composed(col: Column) -> Column:
    """Letter and marks as the one letter that the tables know; texts without marks are only searched for them."""
    whole = replaced(col, [*COMPOSED, *((unicodedata.normalize("NFC", d[:-1]) + d[-1], c) for d, c in COMPOSED if len(d) > 2)])
    return F.when(col.rlike("[\u0300-\u036f]"), whole).otherwise(col)


def latin_to_ascii(col: Column) -> Column:
    col = composed(col)
    for a, b in t.LATIN_TO_ASCII:
        if a[0] == "^" or a[-1] == "+":
            before = rf"(?<!{LETTER})" if a[0] == "^" else ""
            after = "(?=[aou])" if a[-1] == "+" else ""
            col = F.regexp_replace(col, f"{before}{a.strip('^+')}{after}", b)
        else:
            col = F.replace(col, F.lit(a), F.lit(b))
    return col


def ascii_to_todo(col: Column) -> Column:
    col = replaced(col, t.ASCII_PAIRS)
    return F.translate(col, t.ASCII_LETTERS + t.ASCII_MARKS, t.TODO_LETTERS + t.TODO_MARKS)


def translit_to_todo(col: Column) -> Column:
    """Latin transliteration to Todo, lower-cased first; line breaks stay."""
    return ascii_to_todo(latin_to_ascii(F.lower(dashes(col))))


def todo_to_ascii(col: Column) -> Column:
    """Todo to the ASCII scheme; some letters look at the vowel after them."""
    for letter, front, back, alone in t.TODO_BY_VOWEL:
        col = F.regexp_replace(col, f"{letter}(?=[{t.TODO_FRONT}])", front)
        col = F.regexp_replace(col, f"{letter}(?=[{t.TODO_BACK}])", back)
        col = F.replace(col, F.lit(letter), F.lit(alone))
    col = F.regexp_replace(col, "ᠴ(?=ᡅ)", "j")
    return F.translate(replaced(col, t.TODO_TO_ASCII_LONG), t.TODO_TO_ASCII_FROM, t.TODO_TO_ASCII_TO)


def ascii_to_latin(line: Column) -> Column:
    """One line of the ASCII scheme; an h that is left follows the line's first vowel."""
    first = F.regexp_extract(line, f"[{t.HARMONY_BACK}{t.HARMONY_FRONT}]", 0)
    front = first.isin(*t.HARMONY_FRONT)
    return F.replace(replaced(line, t.ASCII_TO_LATIN), F.lit("h"), F.when(front, F.lit("k")).otherwise(F.lit("x")))


def todo_to_translit(col: Column) -> Column:
    return by_line(todo_to_ascii(col), ascii_to_latin)


def normalize_j(col: Column) -> Column:
    col = F.regexp_replace(col, "ᡓ(?=ᡅ)", "ᠴ")
    return F.regexp_replace(col, f"(?<![\u180b-\u180fᠠ-ᢪ])ᡓ(?=[{t.TODO_BACK}])", "ᡚ")


def normalize_yi(col: Column) -> Column:
    col = F.regexp_replace(col, f"(?<=[{t.TODO_VOWELS}{t.TODO_LONG}])ᡅ(?=[{t.TODO_CONSONANTS}])", "ᡕᡅ")
    return F.regexp_replace(col, "(?<![ᠠ-ᢪ])(?=ᡅ(?:ᠨ|ᡎᡅ)(?![ᠠ-ᢪ]))", "ᡕ")


def fix_misreads(col: Column) -> Column:
    """Readings that correct text never has, except the harmony after b and p."""
    c, v, mark = t.TODO_CONSONANTS, t.TODO_VOWELS, t.TODO_LONG
    col = F.regexp_replace(col, f"(?<=[{c}]){mark}([{v}]){mark}?", f"$1{mark}")
    col = F.regexp_replace(col, f"(?<=[{c}]){mark}", "")
    col = F.regexp_replace(col, "ᡅᡅᠠ(?![ᠠ-ᢪ])", "ᡅᡕᡅᠨ")
    col = F.regexp_replace(col, "ᡅᡅ(?=[︕︖])", "ᡅ")
    finals = "".join(x for x in c if x not in "ᠨᠱᡕᡊᡖ")
    return F.regexp_replace(col, f"(?<=[{finals}])ᠨ(?![\u180b-\u180fᠠ-ᢪ])", "ᠠ")


def round_vowels(col: Column) -> Column:
    """After b and p, o or ü by the majority of the word's other vowels; a tie keeps what is there. Words are runs of Todo letters."""
    marked = F.split(F.regexp_replace(col, "[\u180b-\u180fᠠ-ᢪ]+", "\u0001$0\u0001"), "\u0001", -1)

    def word(w: Column) -> Column:
        rest = F.regexp_replace(w, "([ᡋᡌ][\u180b-\u180f]?)[ᡆᡉ]", "$1")
        size = lambda letters: F.char_length(rest) - F.char_length(F.translate(rest, letters, ""))
        back, front = size("ᠠᡆᡇ"), size("ᡄᡈᡉ")
        put = lambda vowel: F.regexp_replace(w, "([ᡋᡌ][\u180b-\u180f]?)[ᡆᡉ]", f"$1{vowel}")
        return F.when(back > front, put("ᡆ")).when(back < front, put("ᡉ")).otherwise(w)

    return F.array_join(F.transform(marked, word), "")


def normalize_ocr(col: Column) -> Column:
    return normalize_yi(round_vowels(fix_misreads(normalize_j(col))))


def strip_marks(col: Column) -> Column:
    """Runs of marks become spaces; spaces collapse; lines are trimmed."""
    marks = "".join("\\" + m if m in "()[]" else m for m in t.MARKS)
    return by_line(col, lambda line: F.regexp_replace(F.regexp_replace(F.regexp_replace(line, f"[{marks}]+", " "), " {2,}", " "), "^ +| +$", ""))


def frame(col: Column) -> Column:
    """Birga before the first line with text; four dots after the last, for its final stop if it has one."""

    def ended(x: Column) -> Column:
        return F.concat(F.regexp_replace(F.regexp_replace(x, r"\s+$", ""), f"[{t.SOURCE_STOP}{t.FULL_STOP}]$", ""), F.lit(t.FOUR_DOTS))

    def framed(lines: Column) -> Column:
        filled = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())

        def between(ends: Column) -> Column:
            def line(x: Column, i: Column) -> Column:
                last = F.when(i == ends["last"], ended(x)).otherwise(x)
                return F.when(i == ends["first"], F.concat(F.lit(t.BIRGA), F.regexp_replace(last, "^ +", ""))).otherwise(last)

            return F.array_join(F.transform(lines, line), "\n")

        return let(F.struct(F.array_min(filled).alias("first"), F.array_max(filled).alias("last")), between)

    return let(F.split(col, "\n", -1), framed)


def punctuation(col: Column, mode: str) -> Column:
    """off, frame or all."""

    def marked(text: Column) -> Column:
        if mode == "all":
            trimmed = by_line(text, lambda line: F.regexp_replace(line, "^ +| +$", ""))
            out = F.replace(frame(F.replace(trimmed, F.lit(t.SOURCE_COMMA), F.lit(t.COMMA))), F.lit(t.SOURCE_STOP), F.lit(t.FULL_STOP))
        else:
            out = frame(strip_marks(text)) if mode == "frame" else strip_marks(text)
        return F.when(text == "", text).otherwise(out)

    return let(col, marked)


def russian_to_translit(col: Column) -> Column:
    """Russian by the letter; what isn't Cyrillic stays. Iotated vowels look at the letter before."""
    w = F.replace(F.lower(col), F.lit("дж"), F.lit("ж"))
    start = r"(?<![бвгджзйклмнпрстфхцчшщ])"
    for letter, initial, inner in (("е", "ye", "e"), ("ё", "yo", "yo"), ("ю", "yu", "yu"), ("я", "ya", "ya")):
        w = F.regexp_replace(w, start + letter, initial) if initial != inner else w
        w = F.replace(w, F.lit(letter), F.lit(inner))
    w = F.replace(w, F.lit("ц"), F.lit("ts"))
    return F.translate(F.translate(w, "ъь", ""), t.RUSSIAN_FROM, t.RUSSIAN_TO)


def case_like(col: Column, model: Column) -> Column:
    """The case of ``model``: all capitals (of more than one letter), a first capital, or as is."""
    capital = F.upper(F.left(model, F.lit(1)))
    return (
        F.when((F.char_length(model) > 1) & (F.upper(model) == model) & (F.lower(model) != model), F.upper(col))
        .when((F.left(model, F.lit(1)) == capital) & (F.lower(F.left(model, F.lit(1))) != capital), F.concat(F.upper(F.left(col, F.lit(1))), F.substr(col, F.lit(2))))
        .otherwise(col)
    )


def split_macrons(col: Column) -> Column:
    """Lower case, white space to hyphens, long vowels to vowel and macron."""
    return replaced(F.regexp_replace(F.lower(col), r"\s+", "-"), [(a, b[0].lower() + "ˉ") for a, b in zip("āēīōū", "aeiou")] + [("ȫ", "öˉ"), ("ǖ", "üˉ")])


def gap_insert(col: Column, gaps: dict[str, int]) -> Column:
    """Between two letters as many low lines as the font's gap table says; spaces doubled."""
    table = F.create_map(*[F.lit(x) for kv in gaps.items() for x in kv])
    spaced = lambda chars: F.array_join(
        F.transform(chars, lambda c, i: F.concat(c, F.coalesce(F.repeat(F.lit("_"), F.element_at(table, F.concat(c, F.get(chars, i + 1)))), F.lit("")))), ""
    )
    return F.replace(let(F.split(col, ""), spaced), F.lit(" "), F.lit("  "))


def segment_normalize(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[\\s\u202f-]+", " "))


def small(col: Column) -> Column:
    """Lower case by the letter: one letter for one, wherever it stands."""
    return F.lower(F.translate(col, "İΣ", "iσ"))


def first_capital(col: Column) -> Column:
    """The first letter as a capital, one letter for one."""
    first = F.left(col, F.lit(1))
    return F.when(first.isin(*LONG_CAPITALS), F.translate(first, "".join(LONG_CAPITALS), "".join(LONG_CAPITALS.values()))).otherwise(F.upper(first))


def tidy_spaces(col: Column) -> Column:
    """No space before a sign of punctuation."""
    return F.regexp_replace(col, r"[ \t\n\f\r]+([,.!?])", "$1")


def capitalise(col: Column) -> Column:
    """A capital at the start and after each .!?"""
    parts = F.split(F.regexp_replace(col, r"([.!?][ \t\n\f\r]*)", "$1\u0001"), "\u0001", -1)
    return F.array_join(F.transform(parts, lambda p: F.concat(first_capital(p), F.substr(p, F.lit(2)))), "")


def ocr_tidy(col: Column, vowels: str = "aeiouāēīōūöüȫǖ") -> Column:
    """Words of one or two letters without a vowel go; loose narrow spaces go; spaces collapse."""
    kept = F.filter(F.split(F.replace(col, F.lit("\u202f"), F.lit(" ")), " +"), lambda w: (F.char_length(w) > 2) | w.rlike(f"[{vowels}]"))
    return F.array_join(kept, " ")


def ocr_to_translit(col: Column) -> Column:
    """Every gap a space, letters read, punctuation made Latin."""
    return F.translate(todo_to_translit(F.replace(col, F.lit("\u202f"), F.lit(" "))), t.BIRGA + t.COMMA + t.FULL_STOP + t.FOUR_DOTS, " ,..")


def drop_birga(columns: Column) -> Column:
    """In the first of an array of columns, a lone i at the start was a birga."""
    return F.transform(columns, lambda c, i: F.when(i == 0, F.regexp_replace(c, "^ᡅ ", "")).otherwise(c))


def diff_words(a: Column, b: Column) -> Column:
    """Pairs of different tokens at equal places; one pair of whole texts if the numbers of tokens differ."""
    x, y = F.split(a, r"\s+"), F.split(b, r"\s+")
    pairs = F.filter(F.zip_with(x, y, lambda p, q: F.struct(p.alias("a"), q.alias("b"))), lambda z: z["a"] != z["b"])
    return F.when(F.size(x) == F.size(y), pairs).otherwise(F.array(F.struct(a.alias("a"), b.alias("b"))))


def html_escape(col: Column) -> Column:
    return replaced(col, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")))


def milliseconds(col: Column) -> Column:
    """Whole milliseconds below a second, else seconds with two places and a comma."""
    seconds = F.replace(F.format_string("%.2f", (col / 1000).cast("double")), F.lit("."), F.lit(","))
    return F.when(col < 1000, F.concat(F.round(col).cast("long").cast("string"), F.lit(" мс"))).otherwise(F.concat(seconds, F.lit(" с")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic plural: 1 column, 2-4 columns, 5-20 columns."""
    last, two = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((last == 1) & (two != 11), one).when(last.between(2, 4) & ~two.between(12, 14), few).otherwise(many)


def deep_link(col: Column) -> Column:
    """c<number>[_l<line>] as (chapter, line); hyphens of the line were points."""
    rule = r"^c(\d+)(?:_l([\w-]+))?$"
    found = F.regexp_extract(col, rule, 1)
    return F.when(
        found != "", F.struct(found.cast("int").alias("chapter"), F.nullif(F.replace(F.regexp_extract(col, rule, 2), F.lit("-"), F.lit(".")), F.lit("")).alias("line"))
    )


def clean_entry(col: Column) -> Column:
    """Joiners removed, white space collapsed, trailing cross-reference note cut."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(col, "[\u200c\u200d]", ""), r"\s+", " "), r"\s*\((?:see|см\.?) [^()]*\)$", ""))


def resolve_colour(fg: Column, bg: Column, palette: dict[str, str]) -> Column:
    """Names to colours, unknown ones to the defaults; equal ones to black on white, flagged."""
    table = F.create_map(*[F.lit(x) for kv in palette.items() for x in kv])
    f, b = F.coalesce(F.element_at(table, F.lower(fg)), F.lit("#000000")), F.coalesce(F.element_at(table, F.lower(bg)), F.lit("#ffffff"))
    same = f == b
    return F.struct(F.when(same, "#000000").otherwise(f).alias("fg"), F.when(same, "#ffffff").otherwise(b).alias("bg"), same.alias("fallback"))
