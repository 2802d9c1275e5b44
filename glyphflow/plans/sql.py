"""Pieces of SQL for the oracles. They read the fixed values, and nothing of the column expressions."""

from __future__ import annotations

from glyphflow import tables as t


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def tr(x: str, a: str, b: str) -> str:
    return f"translate({x}, {q(a)}, {q(b)})"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def lines(x: str, f) -> str:
    return f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: {f('l')}), chr(10))"


def dashes(x: str) -> str:
    x = sub(x, rf"[ \t]*[{t.DASHES}][ \t]*", " ︱ ")
    return sub(x, r"[ \t]+-[ \t]+", " ︱ ")


def latin_to_ascii(x: str) -> str:
    for a, b in t.LATIN_TO_ASCII:
        if a == "^ǰ+":
            x = sub(x, r"(^|[^\p{L}\p{N}_:])ǰ([aou])", r"\1J\2")
        elif a.endswith("+"):
            x = sub(x, a[:-1] + "([aou])", b + r"\1")
        else:
            x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def to_todo(x: str) -> str:
    return tr(chain(latin_to_ascii(f"lower({dashes(x)})"), t.ASCII_PAIRS), t.ASCII_LETTERS + t.ASCII_MARKS, t.TODO_LETTERS + t.TODO_MARKS)


def todo_to_ascii(x: str) -> str:
    for letter, front, back, alone in t.TODO_BY_VOWEL:
        x = sub(x, f"{letter}([{t.TODO_FRONT}])", front + r"\1")
        x = sub(x, f"{letter}([{t.TODO_BACK}])", back + r"\1")
        x = f"replace({x}, {q(letter)}, {q(alone)})"
    x = sub(x, "ᠴ(ᡅ)", r"j\1")
    return tr(chain(x, t.TODO_TO_ASCII_LONG), t.TODO_TO_ASCII_FROM, t.TODO_TO_ASCII_TO)


def to_translit(x: str) -> str:
    first = f"regexp_extract(l, '[{t.HARMONY_BACK}{t.HARMONY_FRONT}]')"
    front = ", ".join(map(q, t.HARMONY_FRONT))
    return lines(todo_to_ascii(x), lambda l: f"replace({chain(l, t.ASCII_TO_LATIN)}, 'h', CASE WHEN {first} IN ({front}) THEN 'k' ELSE 'x' END)")


def normalize_j(x: str) -> str:
    return sub(sub(x, "ᡓ(ᡅ)", r"ᠴ\1"), r"(^|[^\x{180B}-\x{180F}\x{1820}-\x{18AA}])ᡓ([ᠠᡆᡇ])", r"\1ᡚ\2")


def normalize_yi(x: str) -> str:
    x = sub(x, f"([{t.TODO_VOWELS}{t.TODO_LONG}])ᡅ([{t.TODO_CONSONANTS}])", r"\1ᡕᡅ\2")
    for _ in range(2):  # the boundary that one match takes is needed by the next
        x = sub(x, r"(^|[^\x{1820}-\x{18AA}])(ᡅᠨ|ᡅᡎᡅ)([^\x{1820}-\x{18AA}]|$)", r"\1ᡕ\2\3")
    return x


def fix_misreads(x: str) -> str:
    c = t.TODO_CONSONANTS
    x = sub(x, f"([{c}])ᡃ([{t.TODO_VOWELS}])ᡃ?", r"\1\2ᡃ")
    x = sub(x, f"([{c}])ᡃ", r"\1")
    x = sub(x, r"ᡅᡅᠠ([^\x{1820}-\x{18AA}]|$)", r"ᡅᡕᡅᠨ\1")
    x = sub(x, "ᡅᡅ([︕︖])", r"ᡅ\1")
    finals = "".join(k for k in c if k not in "ᠨᠱᡕᡊᡖ")
    return sub(x, rf"([{finals}])ᠨ([^\x{{180B}}-\x{{180F}}\x{{1820}}-\x{{18AA}}]|$)", r"\1ᠠ\2")


def strip_marks(x: str) -> str:
    marks = "".join("\\" + m if m in "()[]" else m for m in t.MARKS)
    return lines(x, lambda l: f"trim({sub(sub(l, f'[{marks}]+', ' '), ' {2,}', ' ')}, ' ')")


def framed(x: str) -> str:
    """Lines numbered; the first and last with text changed."""
    a = f"string_split({x}, chr(10))"
    filled = f"list_filter(range(1, len({a}) + 1), lambda i: regexp_matches({a}[i], '\\S'))"
    end = lambda l: f"regexp_replace(rtrim({l}, ' ' || chr(9) || chr(13)), '[{t.SOURCE_STOP}{t.FULL_STOP}]$', '') || {q(t.FOUR_DOTS)}"
    ended = f"CASE WHEN i = list_max({filled}) THEN {end(a + '[i]')} ELSE {a}[i] END"
    one = f"CASE WHEN i = list_min({filled}) THEN {q(t.BIRGA)} || ltrim({ended}, ' ') ELSE {ended} END"
    return f"CASE WHEN len({filled}) = 0 THEN {x} ELSE array_to_string(list_transform(range(1, len({a}) + 1), lambda i: {one}), chr(10)) END"


def ngrams(word: str, alias: str = "g") -> str:
    """SELECT list item: letter sequences of ^word$ of two to four letters."""
    w = f"('^' || {word} || '$')"
    each = [f"list_transform(range(1, length{w} - {n - 2}), lambda i: substr({w}, i, {n}))" for n in (2, 3, 4)]
    return f"unnest(list_concat({', '.join(each)})) AS {alias}"


def values(rows, columns: str, alias: str = "v") -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else q(x)

    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS {alias}({columns})"
