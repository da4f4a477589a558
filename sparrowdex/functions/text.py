"""Text functions as Column expressions; pandas UDFs only where Spark has no expression for the work."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A token is a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
def _folds() -> tuple[str, str]:
    """Lower-case letters with marks of the Latin, Greek and Cyrillic blocks and what is left of them without; letters with a stroke or the like; combining marks, which go."""
    pairs: dict[str, str] = {}
    for k in (*range(0xDF, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        c = chr(k)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and c == c.lower() and c.isalpha():
            pairs[c] = base
    pairs |= dict(zip("øłđħŧıŋſ", "oldhtins", strict=True))
    return "".join(pairs) + "".join(chr(k) for k in range(0x300, 0x370)), "".join(pairs.values())


ACCENTED, PLAIN = _folds()
# Letters that fold to two.
DOUBLE = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"))
_FOLD = dict(zip(ACCENTED, (*PLAIN, *[""] * (len(ACCENTED) - len(PLAIN))), strict=True))
# Control and format characters that cleaning drops.
DROPPED = r"[\x00-\x08\x0B\x0C\x0E-\x1F​-‍﻿�]"


def fold(c: Column) -> Column:
    """Lower case without accents. ASCII text, of as many bytes as characters, has none: that is told before each character is looked up."""
    out = F.lower(c)
    for a, b in DOUBLE:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(out, ACCENTED, PLAIN))


def fold_str(s: str) -> str:
    out = s.lower()
    for a, b in DOUBLE:
        out = out.replace(a, b)
    return out.translate(str.maketrans(_FOLD))


def tokens(c: Column) -> Column:
    """Folded tokens in order; null text gives no tokens."""
    return F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"))


def reversed_tokens(c: Column) -> Column:
    return F.transform(tokens(c), F.reverse)


def digraph_tokens(c: Column) -> Column:
    """Tokens with ae, oe and ue read as umlauts, then folded: both spellings meet in one form."""
    out = F.coalesce(c, F.lit(""))
    # Digraphs and umlauts.
    for a, b in (("ae", "ä"), ("oe", "ö"), ("ue", "ü"), ("Ae", "Ä"), ("Oe", "Ö"), ("Ue", "Ü"), ("AE", "Ä"), ("OE", "Ö"), ("UE", "Ü")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return tokens(out)


def digraph_str(folded: str) -> str:
    """What digraph_tokens makes of a folded term."""
    return folded.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def clean(c: Column) -> Column:
    """Without control and zero-width characters; runs of two or more spaces are one space; trimmed."""
    return F.trim(F.regexp_replace(clean_keep_space(c), r"\s{2,}", " "))


def clean_keep_space(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), DROPPED, "")


def content_hash(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def file_extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the base name, if the dot is neither first nor last; else null."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def mime_base(c: Column) -> Column:
    return F.trim(F.substring_index(c, ";", 1))


def chunk_split(c: Column, n: int) -> Column:
    """n pieces of equal length in characters; the last takes the rest; short texts are padded with empty pieces."""
    text = F.coalesce(c, F.lit(""))
    size = F.floor(F.length(text) / n).cast("int")
    cut = lambda i: F.when(i == n - 1, F.substr(text, i * size + 1)).otherwise(F.substr(text, i * size + 1, size))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cut)


def chunk_position(i: Column, n: Column) -> Column:
    return F.when(n <= 1, F.lit(0.0)).otherwise(i / (n - 1)).cast("float")


# -- normalisation of extracted content -------------------------------------------------------------------------------------------

_ENTITY = re.compile(r"&(#[xX]?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
# Named entities that are decoded: those of HTML 4, from the standard library's table, and apos.
ENTITIES = {name: chr(code) for name, code in html.entities.name2codepoint.items()} | {"apos": "'"}
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f‌‍�]")
_BLANKS = re.compile("[   -​  　﻿]")


def decode_entities(text: str) -> str:
    """Named, decimal and hexadecimal character references of up to ten characters; unknown ones stay."""

    def one(m: re.Match) -> str:
        body = m[1]
        if len(body) > 9:
            return m[0]
        if not body.startswith("#"):
            return ENTITIES.get(body, m[0])
        digits = body[1:]
        for base, form in ((10, digits), (16, digits.lstrip("xX"))):
            try:
                code = int(form, base)
            except ValueError:
                continue
            if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF:
                return chr(code)
        return m[0]

    return _ENTITY.sub(one, text)


def decode_percent(text: str) -> str:
    """%XX runs that are valid UTF-8; others stay."""

    def one(m: re.Match) -> str:
        try:
            return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _PERCENT.sub(one, text)


def normalize_str(text: str | None) -> str:
    """Entities, %XX, NFKC, control characters, odd spaces, runs of blanks and of line ends, trim; null gives an empty text."""
    t = unicodedata.normalize("NFKC", decode_percent(decode_entities(text or "")))
    t = _BLANKS.sub(" ", _CONTROL.sub("", t))
    return re.sub(r"\n(?:[ \t]*\n)*", "\n", re.sub(r"[\t ]+", " ", t)).strip()


@F.pandas_udf(T.StringType())
def normalize_content(text: pd.Series) -> pd.Series:
    return text.map(normalize_str)


@F.pandas_udf(T.StringType())
def html_entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: decode_entities(t or ""))


@F.pandas_udf(T.StringType())
def url_decode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: decode_percent(t or ""))


_TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I)


def html_text(page: str | None) -> str:
    """Readable text of an HTML page, normalised."""
    return normalize_str(html.unescape(_TAG.sub("\n", page or "")))


def html_title(page: str | None) -> str | None:
    m = _TITLE.search(page or "")
    return normalize_str(html.unescape(m[1])) if m else None


# -- languages --------------------------------------------------------------------------------------------------------------------

# Words that tell languages apart, four languages with as many words each.
PROFILE = {
    "en": "the of and to in is that it was for with as are this by from be not",
    "de": "der die und das den von mit ist des im nicht ein eine auf für sich dem zu",
    "fr": "le la les des et du une que qui dans pour sur est au par ne pas elle",
    "es": "el los las de que y en un por con una su para del al lo se como",
}


def language(c: Column) -> Column:
    """Language of the first 10,000 characters by its common words; null where no language leads clearly."""
    words = F.regexp_extract_all(F.lower(F.substring(c, 1, 10_000)), F.lit(r"([\p{L}]+)"))
    count = lambda lang: F.size(F.filter(words, lambda w: w.isin(*PROFILE[lang].split())))
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(count(k).alias("n"), F.lit(k).alias("lang")) for k in PROFILE])))
    top, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    return F.when((top["n"] >= 3) & (top["n"] * 2 >= second["n"] * 3), top["lang"])


# -- lemmas ----------------------------------------------------------------------------------------------------------------------

# Irregular forms and suffix rules.
IRREGULAR = {
    "en": {"ran": "run", "running": "run", "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "went": "go", "gone": "go", "better": "good", "best": "good", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "feet": "foot", "wrote": "write", "written": "write", "bought": "buy", "houses": "house", "contracts": "contract"},
    "de": {"häuser": "haus", "hauser": "haus", "verträge": "vertrag", "vertrage": "vertrag", "ging": "gehen", "gegangen": "gehen", "war": "sein", "ist": "sein", "sind": "sein", "gärten": "garten", "kinder": "kind", "männer": "mann", "bücher": "buch", "lief": "laufen", "gelaufen": "laufen"},
}
SUFFIXES = {
    "en": (("ies", "y", 5), ("sses", "ss", 5), ("ing", "", 6), ("ed", "", 5), ("es", "e", 5), ("s", "", 4)),
    "de": (("ungen", "ung", 7), ("heiten", "heit", 8), ("keiten", "keit", 8), ("ern", "er", 6), ("en", "", 6), ("es", "", 5), ("e", "", 5), ("n", "", 6)),
}


def lemma(word: str, lang: str) -> str:
    """Lemma of a lower-cased word by the irregular forms and suffix rules of its language, folded."""
    word = word.lower()
    if word in IRREGULAR.get(lang, {}):
        return fold_str(IRREGULAR[lang][word])
    for end, put, least in SUFFIXES.get(lang, ()):
        if word.endswith(end) and len(word) >= least and not (end == "s" and word.endswith("ss")):
            stem = word[: -len(end)] + put
            if end in ("ing", "ed") and len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                stem = stem[:-1]
            return fold_str(stem)
    return fold_str(word)


def lemma_column(term: Column, lang: str) -> Column:
    """What lemma returns, as an expression: filters on lemmas reach below it, and no token goes through Python."""
    word = F.lower(term)
    size = F.length(word)
    cuts, other = [], []  # characters that a rule takes from the end; rules that put others there
    for end, put, least in SUFFIXES.get(lang, ()):
        ok = F.endswith(word, F.lit(end)) & (size >= least)
        if end == "s":
            ok = ok & ~F.endswith(word, F.lit("ss"))
        cut = F.lit(len(end) - len(put))
        if not end.startswith(put):
            other.append((ok, F.concat(F.substr(word, F.lit(1), size - len(end)), F.lit(put))))
        elif end in ("ing", "ed"):
            pair = F.substr(word, size - len(end) - 1, F.lit(2))
            cut = cut + F.when((size > len(end) + 3) & (F.left(pair, F.lit(1)) == F.right(pair, F.lit(1))) & ~F.right(pair, F.lit(1)).isin(*"lsz"), 1).otherwise(0)
        cuts.append((ok, cut))
    if lang in IRREGULAR:
        forms = F.create_map(*[F.lit(x) for pair in IRREGULAR[lang].items() for x in pair])
        other.insert(0, (word.isin(*IRREGULAR[lang]), F.element_at(forms, word)))

    def first(rules: list, out: Column) -> Column:
        for ok, found in reversed(rules):
            out = F.when(ok, found).otherwise(out)
        return out

    # the rules that put other characters come first in every language's list
    out = first(other, F.substr(word, F.lit(1), size - first(cuts, F.lit(0))))
    return fold(out)


def split_compound_lemmas(words: Column) -> Column:
    """Lemmas joined by + fall apart into their parts; one of plus signs alone stays as it is."""
    return F.flatten(F.transform(words, lambda w: F.when(F.regexp_like(w, F.lit(r"^\++$")), F.array(w)).otherwise(F.filter(F.split(w, r"\+"), lambda x: x != ""))))
