"""Text functions as Spark columns; only compatibility normalisation leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Limits, markers and phrases that results depend on.
TEXT_CHARS = (180, 32_000)
CHAT_CHARS = (40, 12_000)
DOCUMENT, END_OF_TEXT = "<|document|>", "<|endoftext|>"
INST, END_INST = "[INST]", "[/INST]"
SYSTEM, END_SYSTEM = "<<SYS>>", "<</SYS>>"
JUNK_PHRASES = ("enable javascript", "cookie policy", "all rights reserved", "subscribe to our newsletter", "click here")
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "assistant": "assistant", "system": "system"}
LEAST_LETTERS, LEAST_WORDS, MANY_WORDS, LEAST_DISTINCT = 0.45, 35, 80, 0.18

#: Characters beyond this class may change under NFKC; rows without them skip Python.
_MAY_NORMALISE = r"[^\u0000-\u009FÀ-ı]"


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatibility_form(text: Column) -> Column:
    """NFKC; only rows that hold a character that may change are sent to Python."""
    normalise = F.pandas_udf(_nfkc, StringType())
    return F.coalesce(normalise(F.when(text.rlike(_MAY_NORMALISE), text)), text)


def strip(text: Column) -> Column:
    """Without white space, in the sense of Unicode, at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


#: White space other than the space and the line end that may be left once control characters are gone.
_ODD_SPACE = r"[\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def _trimmed_lines(text: Column) -> Column:
    """Lines trimmed and blank lines limited, for text in which spaces are single; plain searches where no odd space occurs."""
    plain = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    plain = F.btrim(F.regexp_replace(plain, r"\n{3,}", "\n\n"), F.lit(" \n"))
    odd = F.regexp_replace(text, r"(?Umd)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    odd = strip(F.regexp_replace(odd, r"\n{3,}", "\n\n"))
    return F.when(text.rlike(_ODD_SPACE), odd).otherwise(plain)


def _cut(text: Column, most: int) -> Column:
    head = F.substring(text, 1, most)
    at_word = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*\z", "")).otherwise(head)
    return F.when(F.char_length(text) > most, strip(at_word)).otherwise(text)


def clean_text(text: Column, most: int = TEXT_CHARS[1], normalise: bool = True) -> Column:
    """Normalised, without control characters, lines trimmed, blank lines limited, cut at a word to ``most`` characters.

    Null gives the empty text.  Carriage returns go with the control characters, so one that stands
    alone joins two lines.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    if normalise:
        text = compatibility_form(text)
    text = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]+", "")
    text = F.regexp_replace(text, r"\t[ \t]*| [ \t]+", " ")
    return let(let(text, _trimmed_lines), lambda t: _cut(t, most))


def words(text: Column) -> Column:
    """Words between white space of any kind; none for a blank text."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def junk_hits(text: Column) -> Column:
    return let(F.lower(text), lambda low: sum((low.contains(p).cast("int") for p in JUNK_PHRASES[1:]), low.contains(JUNK_PHRASES[0]).cast("int")))


def quality_reason(text: Column, split: Column, least_chars: int = TEXT_CHARS[0]) -> Column:
    """Why a cleaned text is rejected, or ``keep``; ``split`` holds its words.  Cheap tests come first."""
    n = F.size(split)
    return (
        F.when(F.char_length(text) < least_chars, "short")
        .when(letters(text) / F.greatest(F.lit(1), F.char_length(text)) < LEAST_LETTERS, "letters")
        .when(n < LEAST_WORDS, "words")
        .when((n > MANY_WORDS) & (F.size(F.array_distinct(split)) / F.greatest(F.lit(1), n) < LEAST_DISTINCT), "repeats")
        .when(junk_hits(text) >= 2, "junk")
        .otherwise("keep")
    )


def render_document(text: Column) -> Column:
    return F.concat(F.lit(DOCUMENT + "\n"), text, F.lit("\n" + END_OF_TEXT + "\n"))


def normalise_role(role: Column) -> Column:
    low = F.coalesce(strip(F.lower(role.cast("string"))), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(known, low), low)


def render_pair(user: Column, assistant: Column, system: Column | None = None, end: bool = False) -> Column:
    """An instruction and its answer, both clean; empty if either is, or if the whole is too short or too long."""
    if system is not None:
        user_part = F.when(system != "", F.concat(F.lit(SYSTEM + "\n"), system, F.lit("\n" + END_SYSTEM + "\n\n"), user)).otherwise(user)
    else:
        user_part = user
    whole = F.concat(F.lit(INST + " "), user_part, F.lit(" " + END_INST + " "), assistant, F.lit(f"\n{END_OF_TEXT}\n" if end else ""))
    good = (user != "") & (assistant != "") & F.char_length(whole).between(*CHAT_CHARS)
    return F.when(good, whole).otherwise(F.lit(""))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\n", " ")


def elapsed(seconds: Column) -> Column:
    """Hours, minutes, seconds and milliseconds, from the first that is not zero on."""
    hours = F.floor(seconds / 3600)
    rest = seconds - hours * 3600
    minutes = F.floor(rest / 60)
    rest = rest - minutes * 60
    secs = F.floor(rest)
    ms = (rest - secs) * 1000
    show_m, show_s = (hours > 0) | (minutes > 0), (hours > 0) | (minutes > 0) | (secs > 0)
    text = lambda x: x.cast("long").cast("string")
    return F.concat_ws(
        " ",
        F.when(hours > 0, F.concat(text(hours), F.lit("h"))),
        F.when(show_m, F.concat(text(minutes), F.lit("m"))),
        F.when(show_s, F.concat(text(secs), F.lit("s"))),
        F.concat(F.format_string("%.2f", ms.cast("double")), F.lit("ms")),
    )


def chars_for_tokens(tokens: Column, chars_per_token: float = 4.0) -> Column:
    return (tokens * chars_per_token).cast("bigint")


def new_suffix(text: Column, before: Column) -> Column:
    """What ``text`` adds to ``before``, by length."""
    return F.substring(text, F.char_length(F.coalesce(before, F.lit(""))) + 1, F.char_length(text))
