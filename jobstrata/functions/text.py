"""Text normalisation as Column expressions.

Spark has no Unicode normaliser, so folding is a ``translate`` over a character map
computed once on the driver from ``unicodedata``; the same pass deletes combining marks.
"""

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware and case-insensitive; "d" restricts line ends to \n
ICASE = "(?iUd)"
UNICODE = "(?Ud)"

_DECOMPOSABLE = range(0x80, 0x30000)
# what Python's str.strip() removes
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _letter_map(form: str, drop) -> tuple:
    """Decomposition without marks: (one-to-one pairs, one-to-many pairs, marks to delete)."""
    single, multi, marks = [], [], []
    for code in _DECOMPOSABLE:
        # surrogates are no characters; Hangul syllables decompose into letters, not marks
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        flat = "".join(c for c in unicodedata.normalize(form, ch) if not drop(c))
        if not flat:
            marks.append(ch)
        elif flat != ch:
            (single if len(flat) == 1 else multi).append((ch, flat))
    return tuple(single), tuple(multi), "".join(marks)


@lru_cache(maxsize=None)
def fold_map():
    return _letter_map("NFD", lambda c: unicodedata.category(c) == "Mn")


@lru_cache(maxsize=None)
def compat_map():
    return _letter_map("NFKD", lambda c: unicodedata.combining(c) != 0)


def _char_class(chars) -> str:
    """Regex class of the characters, written as ranges so matching stays cheap."""
    codes, out = sorted(ord(c) for c in chars), []
    start = previous = codes[0]
    for code in [*codes[1:], None]:
        if code is None or code != previous + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{previous:X}}}")
            start = code
        previous = code
    return "[" + "".join(out) + "]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def is_ascii(col: Column) -> Column:
    """True when every character takes one byte; costs no regex."""
    return F.octet_length(col) == F.length(col)


def _apply_map(col: Column, letters) -> Column:
    single, multi, marks = letters
    # only the rare rows that still hold a character with a longer form are taken apart
    table = F.create_map(*[F.lit(x) for pair in multi for x in pair])

    def expand(out):
        # every such character lies beyond ASCII: that settles most characters before the many ranges are tried
        holds = out.rlike(rf"[\x{{80}}-\x{{10FFFF}}&&{_char_class(a for a, _ in multi)}]")
        pieces = F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
        return F.when(holds, F.array_join(pieces, "")).otherwise(out)

    # translate deletes the characters that have no counterpart: the marks
    mapped = F.translate(col, "".join(a for a, _ in single) + marks, "".join(b for _, b in single))
    return let(mapped, expand)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(col, F.lit(WHITESPACE))


def fold(col: Column) -> Column:
    """Lower-case and drop diacritics (canonical decomposition)."""
    low = F.lower(col)
    return F.when(is_ascii(col), low).otherwise(_apply_map(low, fold_map()))


def repair_mojibake(col: Column) -> Column:
    """Undo UTF-8 text that was read as Latin-1; anything else is only trimmed."""
    def repair(text):
        marked = text.rlike("[ÃÂ]|â€")
        latin1 = text.rlike(r"^[\x{0}-\x{FF}]*$")
        repaired = F.try_validate_utf8(F.encode(F.when(latin1, text), "ISO-8859-1").cast("string"))
        return strip(F.when(~is_ascii(text) & marked & latin1, F.coalesce(repaired, text)).otherwise(text))

    return let(col, repair)


def is_blank_repaired(col: Column) -> Column:
    """True where ``repair_mojibake`` leaves nothing; a letter or digit near the start settles it without a repair."""
    return ~F.substring(col, 1, 100).rlike("[0-9A-Za-z]") & (repair_mojibake(col) == "")


def normalize_text(col: Column) -> Column:
    """Repair, compatibility-decompose, drop marks, lower-case; null becomes empty."""
    def normal(text):
        full = F.lower(_apply_map(repair_mojibake(text), compat_map()))
        return F.coalesce(F.when(is_ascii(text), F.lower(strip(text))).otherwise(full), F.lit(""))

    return let(col, normal)


#: What separates words in the normal form of the search side.
SEPARATORS = "[^a-z0-9+#.-]+"


def search_fold(col: Column) -> Column:
    """The normal form of the search side before its separators become single spaces."""
    def flat(text):
        full = F.lower(_apply_map(repair_mojibake(text), fold_map()))
        return F.when(is_ascii(text), F.lower(text)).otherwise(full)

    return let(col, flat)


def search_normalize(col: Column) -> Column:
    """Normal form of titles, categories and queries on the search side."""
    return F.btrim(F.regexp_replace(search_fold(col), SEPARATORS, " "))


def heal_lost_bytes(col: Column, repairs) -> Column:
    """Ordered pattern replacements for titles whose bytes are already gone."""
    for pattern, replacement in repairs:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def repair_byte_pairs(col: Column, pairs) -> Column:
    """UTF-8 read as Latin-1 is decoded as a whole; where that fails, known byte pairs are replaced in order."""
    latin1 = col.rlike(r"^[\x{0}-\x{FF}]*$")
    whole = F.try_validate_utf8(F.encode(F.when(latin1, col), "ISO-8859-1").cast("string"))
    replaced = col
    for pair, letter in pairs:
        replaced = F.replace(replaced, F.lit(pair), F.lit(letter))
    return F.when(is_ascii(col), col).otherwise(
        F.when(whole.isNotNull() & (whole != col) & ~F.contains(whole, F.lit("\ufffd")), whole).otherwise(replaced))


def title_case(col: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the rest."""
    words = F.split(F.regexp_replace(F.lower(col), r"(?<=\P{L})(?=\p{L})", "\u0000"), "\u0000")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))),
        "",
    )


def tokens(col: Column, stopwords) -> Column:
    """Array of kept title tokens, found by one pattern.

    A token is a whole run of two or more of ``a-z0-9+#.`` that is neither a stopword nor
    all digits; dropping those here keeps them out of every later explode and shuffle.
    """
    run = "[a-z0-9+#.]"
    listed = [re.escape(w) for w in dict.fromkeys(stopwords) if re.fullmatch(run + "{2,}", w)]
    dropped = "|".join([*listed, "[0-9]+"])
    pattern = f"((?<!{run})(?!(?:{dropped})(?!{run})){run}{{2,}})"
    return F.regexp_extract_all(normalize_text(col), F.lit(pattern), 1)


def bigrams(token_array: Column) -> Column:
    """Adjacent pairs of a token array, as 'a b'."""
    def pairs(t):
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))

    return let(token_array, pairs)


def word_count(col: Column) -> Column:
    s = strip(col)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+")))
