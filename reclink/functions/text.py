"""Column expressions that normalise names and addresses; all of them stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from reclink.functions import constants as K


def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b != a]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Letters that decompose to nothing, spelled out.
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "þ": "th", "Þ": "Th", "ı": "i"}


# Cyrillic and Greek letters in Latin ones.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "e", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "i", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}
# Vowels and signs of Indic scripts by the end of their Unicode names.
INDIC = {
    "A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "E": "e", "EE": "e", "AI": "ai", "O": "o", "OO": "o", "AU": "au", "VOCALIC R": "r", "VOCALIC L": "l",
    "CANDRA E": "e", "CANDRA O": "o", "SHORT E": "e", "SHORT O": "o", "ANUSVARA": "m", "CANDRABINDU": "m", "VISARGA": "h", "VIRAMA": "", "NUKTA": "",
}


def other_scripts() -> dict[str, str]:
    """Latin spellings of Cyrillic, Greek and Indic characters.

    Indic consonants are spelled as Unicode names them, without the vowel that they carry unless another sign follows, and doubled letters once.
    """
    out = {}
    for small, latin in (CYRILLIC | GREEK).items():
        out |= {small: latin, small.upper(): latin}
    for c in (chr(k) for k in (*range(0x386, 0x3CF), *range(0x900, 0xE00))):
        name = unicodedata.name(c, "")
        kind, _, end = name.partition(" LETTER ") if " LETTER " in name else name.partition(" SIGN ")
        if (digit := unicodedata.digit(c, None)) is not None:
            out[c] = str(digit)
        elif c < "\u0900":
            base = unicodedata.normalize("NFD", c)[0]
            if base in out and c not in out:
                out[c] = out[base]
        elif end in INDIC:
            out[c] = INDIC[end]
        elif " LETTER " in name and end.isalpha():
            out[c] = re.sub(r"(.)\1", r"\1", end.lower().removesuffix("a"))
    return out


def fold(text: Column) -> Column:
    """ASCII letters for accented Latin ones, and Latin spellings for Cyrillic, Greek and Indic letters; other scripts stay."""
    out = F.translate(text, *accent_table())
    for a, b in SPELLED.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    spelled = F.create_map(*[F.lit(x) for kv in other_scripts().items() for x in kv])
    each = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(spelled, c), c)), "")
    # The long look-up is for texts that need it.
    out = F.when(text.rlike("[\u0370-\u03ff\u0400-\u04ff\u0900-\u0dff]"), each).otherwise(out)
    return F.when(text.rlike(r"[^\x00-\x7F]"), out).otherwise(text)


def canonical(mapping: dict[str, str]):
    """A function from a token to its canonical form."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return lambda x: F.coalesce(F.try_element_at(table, x), x)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def deleet(x: Column) -> Column:
    """Letters for look-alike digits, in tokens that mix both and are no ordinals."""
    mixed = x.rlike("[a-z]") & x.rlike(r"\d") & ~x.rlike(K.ORDINAL)
    return F.when(mixed, F.translate(x, *K.LEET)).otherwise(x)


def clean_name(raw: Column) -> Column:
    """Lower-case words, with `|` between alternative names."""
    s = F.lower(fold(raw))
    for pattern, put in K.NAME_STEPS:
        s = F.regexp_replace(s, pattern, put)
    return F.trim(s)


def without(values: tuple[str, ...]):
    return lambda x: ~x.isin(*values)


def name_columns(raw: Column) -> dict[str, Column]:
    """``nm, nm_parts, nm_tok`` from a name; ``nm_core`` and ``nm_concat`` are ``nm_tok`` joined by a blank and by nothing."""
    clean, canon = clean_name(raw), canonical(K.NAME_CANON)
    full = F.transform(tokens(F.replace(clean, F.lit("|"), F.lit(" "))), lambda x: deleet(canon(x)))
    core = lambda part: F.array_join(F.filter(F.transform(tokens(part), lambda x: deleet(canon(x))), without(K.NAME_STOP)), " ")
    return {
        "nm": F.array_join(full, " "),
        "nm_parts": F.filter(F.transform(F.split(clean, r"\|"), core), lambda x: x != ""),
        "nm_tok": F.array_distinct(F.filter(full, without(K.NAME_STOP))),
    }


def address_columns(raw: Column, old: bool = False) -> dict[str, Column]:
    """``ad, ad_comp, ad_tok, ad_code, ad_nums`` from an address.

    ``old``: an older rule of codes, by which ``#`` parts them, ``null`` does not leave them and their digits alone are no code, and one token less is without identity.
    """
    whole = F.lower(fold(raw))
    s = F.regexp_replace(whole, K.NULL_WORD, " ")
    canon = canonical(K.ADDRESS_CANON)
    lead = lambda x: F.regexp_replace(x, K.LEADING_ZEROS, "")
    coded = F.regexp_replace(whole, "#", " ") if old else F.regexp_replace(s, "#", "")
    codes = F.transform(F.filter(F.regexp_extract_all(coded, F.lit(K.CODE), 0), lambda x: x.rlike(r"\d")), lambda x: lead(F.regexp_replace(x, K.CODE_MARKS, "")))
    if not old:
        codes = F.concat(codes, F.transform(codes, lambda x: lead(F.regexp_replace(x, "[a-z]", ""))))
    stop = [x for x in K.ADDRESS_STOP if not old or x != K.LATER_STOP]
    split = s
    for seam in K.SEAMS:
        split = F.regexp_replace(split, seam, "$1 $2")
    plain = lambda x: F.regexp_replace(x, "[^a-z0-9]+", " ")
    toks = tokens(plain(split))
    number = lambda x: F.regexp_replace(x, r"^0+(\d)", "$1")
    words = F.transform(F.filter(toks, lambda x: ~x.rlike(r"\d")), canon)
    return {
        "ad": F.array_join(F.transform(toks, lambda x: canon(number(x))), " "),
        "ad_comp": F.filter(F.transform(F.split(split, ","), lambda x: F.trim(plain(x))), lambda x: x != ""),
        "ad_tok": F.array_distinct(F.filter(words, lambda x: ~x.isin(*stop) & (F.length(x) > 1))),
        "ad_code": F.array_distinct(F.filter(codes, lambda x: F.length(x) > 1)),
        "ad_nums": F.transform(F.filter(toks, lambda x: x.rlike(K.WHOLE_NUMBER)), number),
    }


def bucket(seed: int, key: Column, of: int) -> Column:
    """A deterministic bucket of a text key, the same in other engines."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long"), F.lit(of))
