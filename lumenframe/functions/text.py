"""Text expressions: tokens, normal forms, character tests, extraction."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cues


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def tokens(s: Column, most: int = 20) -> Column:
    """Distinct lower-cased words of two characters or more, in order, at most ``most``."""
    found = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) > 1)), 1, most)


def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is a base and one mark fold to the base.

    Letters with two marks or more, and four pairs with a macron or acute over a ligature or
    variant letter, do not (fixed values of the text index whose results are matched).
    """
    kept = set("ǢǣǮǯǼǽǾǿ")
    pairs = {"ſ": "s"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        d = unicodedata.normalize("NFD", c)
        if len(d) == 2 and unicodedata.combining(d[1]) and c not in kept:
            pairs[c] = d[0].lower()
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()


def folded(s: Column) -> Column:
    """Lower case with single-mark letters folded, as the text index stores its terms."""
    return F.translate(F.lower(F.translate(s, FOLD_FROM, FOLD_TO)), FOLD_FROM, FOLD_TO)


def index_terms(s: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(s, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words_only(s: Column) -> Column:
    """Lower case, with runs of all but letters, digits, ``_`` and ``%`` as one blank."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_%]+", " "))


def signature(s: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def answer_form(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", " "))


def visible_length(s: Column) -> Column:
    return F.length(F.regexp_replace(s, r"\s", ""))


def noise_ratio(s: Column) -> Column:
    """Share of visible characters that are no letter, number, punctuation, symbol or mark; 0 without any."""
    noise = F.length(F.regexp_replace(s, r"[\s\p{L}\p{N}\p{P}\p{S}\p{M}]", ""))
    return F.when(visible_length(s) > 0, noise / visible_length(s)).otherwise(0.0)


#: Letters with marks that Vietnamese uses, lower case (fixed values).
VIETNAMESE = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"


def has_vietnamese_marks(s: Column) -> Column:
    return F.lower(s).rlike(f"[{VIETNAMESE}]")


def has_ascii_word(s: Column) -> Column:
    return s.rlike("[A-Za-z]{3,}")


def frame_language(marks: Column, ascii_word: Column, mixed: Column | None = None) -> Column:
    """mixed if a frame says so or its regions have both Vietnamese marks and ASCII words, else vi with marks, else en."""
    said = F.lit(False) if mixed is None else F.coalesce(mixed, F.lit(False))
    return F.when(said | (marks & ascii_word), "mixed").when(marks, "vi").otherwise("en")


_ANY_CASE = "(?iu)"


def scenes(s: Column, most: int = cues.MOST_SCENES) -> Column:
    """What lies between line breaks, sentence ends and connectives, from three characters on, at most ``most``; the whole text if that is nothing."""
    parts = F.transform(F.split(s, _ANY_CASE + cues.BREAK), lambda x: F.btrim(x, F.lit(" ,-:\t")))
    found = F.slice(F.filter(parts, lambda x: F.length(x) >= 3), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.trim(s)))


def quoted(s: Column) -> Column:
    """Distinct quoted literals of 2 to 100 characters, whitespace collapsed, in order."""
    found = F.regexp_extract_all(s, F.lit(cues.QUOTED), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, collapse), lambda x: x != ""))


def literals(s: Column) -> Column:
    """Texts that a frame may show: quoted ones, then what is said to be displayed."""
    shown = F.transform(F.regexp_extract_all(s, F.lit(_ANY_CASE + cues.DISPLAYED), F.lit(1)), lambda x: F.btrim(collapse(x), F.lit(" ,.:;?-")))
    shown = F.filter(shown, lambda x: (x != "") & ~F.lower(x).isin(*cues.GENERIC))
    return F.array_distinct(F.concat(quoted(s), shown))


def question(s: Column) -> Column:
    """The last sentence with a question mark, else the last sentence."""
    parts = F.filter(F.transform(F.split(s, cues.SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")
    asked = F.filter(parts, lambda x: F.contains(x, F.lit("?")))
    return F.coalesce(F.try_element_at(asked, F.lit(-1)), F.try_element_at(parts, F.lit(-1)))


def value_type(s: Column) -> Column:
    """What kind of value a question asks for, by cue words."""
    out = None
    for name, cue in cues.VALUES:
        hit = s.rlike(_ANY_CASE + cue)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("free_text")


def answer_source(s: Column) -> Column:
    """Where an answer can be found, by what the cue words speak of."""
    seen, heard = s.rlike(_ANY_CASE + cues.VISIBLE), s.rlike(_ANY_CASE + cues.SPOKEN)
    return F.when(seen & heard, "mixed").when(seen, "ocr").when(heard, "asr").otherwise("visual")


def events(s: Column) -> Column:
    """Events ``E1: ...`` as structs of number and text; the mark after the number may be missing, and an event runs on to the next one."""
    found = F.regexp_extract_all(s, F.lit(r"(?ims)^\s*E\d+\s*[:.\-]?\s*\S.*?(?=\r?\n\s*E\d+|\z)"), F.lit(0))
    parse = lambda x: F.struct(F.regexp_extract(x, r"(?i)^\s*E(\d+)", 1).cast("int").alias("n"), F.btrim(collapse(F.regexp_extract(x, r"(?is)^\s*E\d+\s*[:.\-]?(.*)$", 1)), F.lit(" .")).alias("text"))
    return F.transform(found, parse)


def contiguous(es: Column) -> Column:
    """Whether the numbers of events are 1 to the greatest, in any order."""
    n = F.array_distinct(F.transform(es, lambda e: e["n"]))
    return F.coalesce((F.array_min(n) == 1) & (F.array_max(n) == F.size(n)), F.lit(False))


def numbers(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))


def best_number(texts: Column) -> Column:
    """Of the numbers in an array of texts the one with most digits, then of the earliest text, then the greatest as text."""
    found = F.flatten(F.transform(texts, lambda t, i: F.transform(numbers(t), lambda x: F.struct(F.length(F.regexp_replace(x, r"\D", "")).alias("digits"), (-i).alias("row"), x.alias("value")))))
    return F.array_max(found)["value"]


def low_information(s: Column) -> Column:
    """Empty text, clock faces and broadcaster marks, alone or mixed: text that tells nothing about a scene."""
    t = F.trim(F.coalesce(s, F.lit("")))
    clock = lambda x: x.rlike(rf"^\s*{cues.CLOCK}\s*$")
    mark = lambda x: signature(x).rlike(f"^{cues.BROADCASTER}$")
    rest = F.regexp_replace(t, cues.LOOSE_CLOCK, " ")
    return (t == "") | clock(t) | mark(t) | mark(rest) | F.forall(F.split(t, r"\s+"), lambda x: clock(x) | mark(x))


def safe_component(s: Column, fallback: str = "query") -> Column:
    """A file name part: runs of other characters as ``-``, no ``.`` or ``-`` at the ends, 80 characters at most."""
    t = F.btrim(F.regexp_replace(F.trim(s), r"[^A-Za-z0-9._-]+", "-"), F.lit(".-"))
    return F.substring(F.coalesce(F.nullif(t, F.lit("")), F.lit(fallback)), 1, 80)


def safe_zip_name(s: Column) -> Column:
    """An archive's name: the letters and digits of its stem, 80 at most, and ``.zip``."""
    stem = F.regexp_replace(F.element_at(F.split(s, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.substring(F.coalesce(F.nullif(F.regexp_replace(stem, "[^A-Za-z0-9]+", ""), F.lit("")), F.lit("submission")), 1, 80), F.lit(".zip"))


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    """``prefix`` and the number with zeros ahead; a longer number is not cut."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def zoned_time(s: Column) -> Column:
    """An ISO time as a timestamp; null if it is none or names no zone."""
    return F.when(s.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(s, "[Zz]$", "+00:00")))


def compact_utc(t: Column) -> Column:
    """A timestamp as ``yyyyMMddTHHmmssZ``, for a session whose zone is UTC."""
    return F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")


def is_sha256(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_identifier(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False))


def is_relative_path(s: Column) -> Column:
    return F.coalesce((s != "") & ~s.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)"), F.lit(False))


def natural_key(s: Column) -> Column:
    """Sorts digits by value: each run of digits is padded to 20 places, the rest lower-cased."""
    parts = F.regexp_extract_all(F.lower(s), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 20, "0")).otherwise(x)), "")


def first_json(s: Column) -> Column:
    """The outermost ``{...}`` of a text that may be fenced."""
    return F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))


def nfc(s: Column) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))

    return F.pandas_udf(run, "string")(s)


def normal_form(s: Column) -> Column:
    """Composed, case-folded and whitespace collapsed: the form in which two readings are equal."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFC", v).casefold())

    return collapse(F.pandas_udf(run, "string")(s))


def json_texts(s: Column) -> Column:
    """Texts of a JSON value that may be a list, one text, or null: trimmed, without blanks and repeats, in order."""
    listed = F.from_json(s, "array<string>")
    one = F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")
    every = F.coalesce(F.when(s.rlike(r"^\s*\["), listed).otherwise(one), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(every, lambda x: collapse(x)), lambda x: x.isNotNull() & (x != "")))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two texts; no built-in has it."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")(a, b)
